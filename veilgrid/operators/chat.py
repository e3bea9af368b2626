"""Conversation tables as training strings and message arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Style:
    """How a conversation is written. {r} is the role, {m} the message, {s} the separator: sep at even places, sep2 at
    odd ones where alternating. `closed` writes a message, `open` a turn that is yet to be said; odd_* stand in at odd places."""

    head: str = "{system}"
    closed: str = "{r}: {m}{s}"
    open: str = "{r}:"
    alternating: bool = False
    head_if_empty: str | None = None
    odd_closed: str | None = None
    odd_open: str | None = None
    even_prefix: str = ""
    first_closed: str | None = None
    last_turns: int | None = None
    strip: bool = False
    single_lines: bool = False
    tail: str = ""


# The formats of the styles.
STYLES = {
    "add_colon_single": Style(head="{system}{sep}"),
    "add_colon_two": Style(head="{system}{sep}", alternating=True),
    "add_colon_space_single": Style(head="{system}{sep}", open="{r}: "),
    "add_new_line_single": Style(head="{system}{sep}", head_if_empty="", closed="{r}\n{m}{s}", open="{r}\n"),
    "no_colon_single": Style(closed="{r}{m}{s}", open="{r}"),
    "no_colon_two": Style(closed="{r}{m}{s}", open="{r}", alternating=True),
    "rwkv": Style(closed="{r}: {m}\n\n", single_lines=True),
    "llama2": Style(head_if_empty="[INST] ", first_closed="{m} ", closed="{r} {m}{s}", open="{r}", alternating=True),
    "llama3": Style(head="<|begin_of_text|>{system}", closed="<|start_header_id|>{r}<|end_header_id|>\n\n{m}<|eot_id|>", open="<|start_header_id|>{r}<|end_header_id|>\n\n", strip=True),
    "chatglm": Style(head="{system}{sep}", head_if_empty="", even_prefix="[Round {round}]{sep}", closed="{r}：{m}{sep}", open="{r}："),
    "chatml": Style(head="{system}{sep}\n", head_if_empty="", closed="{r}\n{m}{s}\n", open="{r}\n"),
    "chatglm3": Style(closed="{r}\n{m}", open="{r}"),
    "chatintern": Style(even_prefix="<s>", closed="{r}:{m}{s}\n", alternating=True),
    "dolly": Style(closed="{r}:\n{m}{s}", odd_closed="{r}:\n{m}{s}\n\n", open="{r}:\n", alternating=True),
    "phoenix": Style(closed="{r}: <s>{m}</s>", open="{r}: <s>"),
    "robin": Style(head="{system}{sep}", closed="{r}:\n{m}{s}", open="{r}:\n"),
    "falcon_chat": Style(head="{system}{sep}", head_if_empty=""),
    "metamath": Style(head="{system}{sep}", head_if_empty="", closed="{r}:\n{m}{sep}", open="{r}:\n", odd_closed="{r}: {sep2}{m}", odd_open="{r}: {sep2}"),
    "deepseek_chat": Style(alternating=True),
    "yuan2": Style(head="{system}{sep2}", head_if_empty="", closed="{m}<n>", open="", tail="{sep}"),
    "gemma": Style(head="<bos>", closed="<start_of_turn>{r}\n{m}{s}", open="<start_of_turn>{r}\n"),
    "cllm": Style(head="{system}{sep}", alternating=True, last_turns=2),
    "default": Style(head="{system}\n", closed="{r}: {m}\n"),
}


def filled(pattern: str, parts: dict[str, Column]) -> Column:
    """A pattern with its {names} filled in by columns."""
    out, rest = [], pattern
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        out += [F.lit(before), parts[name]] if before else [parts[name]]
    return F.concat(*out, *([F.lit(rest)] if rest or not out else []))


def render(messages: Column, system: Column, style: str, sep: str = " ", sep2: str = "</s>", first_round: int = 0) -> Column:
    """The training string of an array of (turn, role, text), in order; a null or empty text is a turn yet to be said."""
    s = STYLES[style]
    ordered = F.array_sort(messages)
    if s.last_turns:
        ordered = F.slice(ordered, F.greatest(F.size(ordered) - s.last_turns + 1, F.lit(1)), s.last_turns)

    def turn(x: Column, i: Column) -> Column:
        odd = i % 2 == 1
        text = F.trim(x["text"]) if s.strip else x["text"]
        if s.single_lines:
            text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n"))
        parts = {"r": x["role"], "m": text, "sep": F.lit(sep), "sep2": F.lit(sep2), "s": F.when(odd, sep2).otherwise(sep) if s.alternating else F.lit(sep), "round": (F.floor(i / 2) + first_round).cast("string")}
        said = filled(s.closed, parts) if s.odd_closed is None else F.when(odd, filled(s.odd_closed, parts)).otherwise(filled(s.closed, parts))
        if s.first_closed is not None:
            said = F.when(i == 0, filled(s.first_closed, parts)).otherwise(said)
        unsaid = filled(s.open, parts) if s.odd_open is None else F.when(odd, filled(s.odd_open, parts)).otherwise(filled(s.open, parts))
        body = F.when(F.coalesce(F.length(x["text"]), F.lit(0)) > 0, said).otherwise(unsaid)
        return F.concat(F.when(odd, "").otherwise(filled(s.even_prefix, parts)), body) if s.even_prefix else body

    parts = {"system": F.coalesce(system, F.lit("")), "sep": F.lit(sep), "sep2": F.lit(sep2)}
    head = filled(s.head, parts)
    if s.head_if_empty is not None:
        head = F.when(parts["system"] == "", s.head_if_empty).otherwise(head)
    body = F.array_join(F.transform(ordered, turn), "")
    if style == "yuan2":  # its trailing <, n and > characters all go
        body = F.regexp_replace(body, "[<n>]+$", "")
    return F.concat(head, body, filled(s.tail, parts)) if s.tail else F.concat(head, body)


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, system, messages): one row per conversation; system is the first system text or empty."""
    message = F.struct("turn", "role", "text")
    said = F.col("role") != "system"
    return turns.groupBy(key).agg(
        F.coalesce(F.min_by(F.when(~said, F.col("text")), F.when(~said, F.col("turn"))), F.lit("")).alias("system"),
        F.array_sort(F.collect_list(F.when(said, message))).alias("messages"),
    )


def api_messages(messages: Column, system: Column, assistant: str = "assistant", offset: int = 0) -> Column:
    """(role, content): the system message first if there is one; even places are the user's; unsaid answers are left out."""
    body = F.slice(messages, offset + 1, 1_000_000)
    turns = F.transform(body, lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise(assistant).alias("role"), x["text"].alias("content")))
    said = F.filter(turns, lambda x: (x["role"] == "user") | x["content"].isNotNull())
    first = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.when(F.coalesce(system, F.lit("")) != "", F.concat(first, said)).otherwise(said)


def pairs(messages: Column) -> Column:
    """(user, answer) for every second message and the one after it."""
    starts = F.filter(F.transform(messages, lambda x, i: F.struct(i.alias("i"), x["text"].alias("user"))), lambda x: x["i"] % 2 == 0)
    return F.transform(starts, lambda x: F.struct(x["user"].alias("user"), F.get(messages, x["i"] + 1)["text"].alias("answer")))


def with_system(conversations_: DataFrame, message: Column) -> DataFrame:
    return conversations_.withColumn("system", message)


def appended(messages: Column, role: str, text: Column) -> Column:
    turn = F.coalesce(F.array_max(F.transform(messages, lambda x: x["turn"])) + 1, F.lit(0).cast("long"))
    return F.concat(messages, F.array(F.struct(turn.alias("turn"), F.lit(role).alias("role"), text.alias("text"))))


def last_replaced(messages: Column, text: Column) -> Column:
    last = F.size(messages) - 1
    return F.transform(messages, lambda x, i: F.when(i == last, F.struct(x["turn"].alias("turn"), x["role"].alias("role"), text.alias("text"))).otherwise(x))
