"""Removal of byte strings that occur twice anywhere, by induced suffix sorting.

Every window of `span` bytes picks an anchor: the `gram`-byte string in it with the least hash, the leftmost of
equals. Equal windows pick equal anchors, so windows can only be equal where their anchors are. The windows in a row
that pick one anchor, with their bytes, are a context. Contexts are counted by (anchor, content):

- an anchor that occurs once has no repeated window;
- a content that occurs twice has repeated windows only;
- where an anchor has several contents, one copy of each goes, with the others of its anchor, to one shard, where the
  suffixes are sorted by external induced sorting (induced.py) and starts that agree over `span` bytes are marked.

An anchor with more contents than a shard should hold is resolved by its windows' hashes instead, counted in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, sliced, staged, texts_of
from .induced import repeated_starts
from .words import mix

UPPER = np.uint64(0xFFFFFFFF00000000)
FACTOR = np.uint64(0xD6E8FEB86659FD93)
#: Where a text goes by in the joins: its hash and its id. Rows equal in both are the same in every result.
KEYS = ("_vg_id", "_vg_tk")
#: Bytes of a text that are looked at together; longer texts go in pieces that overlap by a window less one byte.
PIECE = 1 << 20


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the string of `length` bytes (8 at least) at each place that has one: built from halves, mixed in between."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = 8
    while size < length:
        step = min(size, length - size)
        a, b = h[:-step], h[step:]
        h = a >> np.uint64(29)
        h ^= a
        h *= FACTOR
        h += b
        size += step
    return mix(h)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: from running minima up to, and down from, every width-th place."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def pieces(run: list[bytes], span: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Runs of about PIECE bytes: (parts of texts, the index of each part's text, where the part begins in it)."""
    parts, owner, begin, size = [], [], [], 0
    for k, raw in enumerate(run):
        for lo in range(0, max(1, len(raw) - span + 1), PIECE):
            part = raw[lo : lo + PIECE + span - 1]
            if parts and size + len(part) > PIECE:
                yield parts, np.array(owner), np.array(begin)
                parts, owner, begin, size = [], [], [], 0
            parts.append(part)
            owner.append(k)
            begin.append(lo)
            size += len(part)
    if parts:
        yield parts, np.array(owner), np.array(begin)


def contexts(run: list[bytes], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, content, first, last, size, times): of each context, the text's index, hashes, first and last window start.

    Contexts in a row that are equal (in periodic text) are one row: `last` is that of the last of them, `size` the bytes
    of one, `times` how many there are.
    """
    joined = b"".join(run)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter(map(len, run), np.int64, len(run))
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if len(data) < span:
        return none
    at = np.concatenate([[0], np.cumsum(sizes)])
    h = gram_hashes(data, gram)
    # The upper half of the hash decides; equal ones go by place, so the leftmost wins.
    least = sliding_least((h & UPPER) | np.arange(len(h), dtype=np.uint64), span - gram + 1)
    first = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, at[:-1])
    first = first[first < len(least)]
    t = np.searchsorted(at, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(least)) - 1, at[t + 1] - span)
    ok = first <= last
    first, last, t = first[ok], last[ok], t[ok]
    if not len(first):
        return none
    anchor = h[(least[first] & ~UPPER).astype(np.int64)].view(np.int64)
    ends = last + span
    content = np.frombuffer(b"".join([hashlib.blake2b(joined[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]), np.int64)
    same = (content[1:] == content[:-1]) & (anchor[1:] == anchor[:-1]) & (first[1:] == last[:-1] + 1) & (t[1:] == t[:-1])
    lead = np.flatnonzero(np.concatenate([[True], ~same]))
    times = np.diff(np.append(lead, len(first)))
    return t[lead], anchor[lead], content[lead], first[lead] - at[t[lead]], last[lead + times - 1] - at[t[lead]], ends[lead] - first[lead], times


PLACE = ("anchor", "content", "first", "last", "size", "times")


def anchored(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(id, tk, anchor, content, first, last, size, times) of docs (id, tk, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                keys = batch.select(["id", "tk"])
                for parts, owner, begin in pieces([t.encode("utf-8", "replace") for t in texts_of(batch)], span):
                    t, anchor, content, first, last, *rest = contexts(parts, span, gram)
                    rows = keys.take(pa.array(owner[t]))
                    columns = (anchor, content, *(x.astype(np.int32) for x in (first + begin[t], last + begin[t], *rest)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, columns)], ["id", "tk", *PLACE])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "tk", "text").mapInArrow(find, f"id {kind}, tk long, anchor long, content long, first int, last int, size int, times int")


def cut_contexts(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """wanted (id, tk, anchor, content, n, first, size) with the `bytes` of each context.

    All columns of docs go through the join, so that its exchange of the texts is the one that remove_repeats reads again.
    """
    lists = wanted.groupBy("id", "tk").agg(F.collect_set(F.struct("anchor", "content", "n", "first", "size")).alias("list"))
    lists = lists.select(F.col("id").alias("_vg_i"), F.col("tk").alias("_vg_t"), "list")
    joined = docs.join(lists.hint("merge"), F.col("id").eqNullSafe(F.col("_vg_i")) & (F.col("tk") == F.col("_vg_t"))).select(*docs.columns, "list")
    names = ("anchor", "content", "n", "first")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                lists, keys = batch.column("list"), batch.select(["id", "tk"])
                parents, flat = lists.value_parent_indices(), lists.flatten()
                raw = [t.encode("utf-8", "replace") for t in texts_of(batch)]
                for lo in range(0, len(flat), 4096):
                    part, owner = flat.slice(lo, 4096), parents.slice(lo, 4096)
                    first, size = part.field("first").to_pylist(), part.field("size").to_pylist()
                    out = [raw[k][a : a + n] for k, a, n in zip(owner.to_pylist(), first, size, strict=True)]
                    yield pa.RecordBatch.from_arrays([*keys.take(owner).columns, *(part.field(c) for c in names), pa.array(out, pa.binary())], ["id", "tk", *names, "bytes"])

    kind = docs.schema["id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"id {kind}, tk long, anchor long, content long, n long, first int, bytes binary")


SPANS = "id {id}, tk long, begin long, end long"


def runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return edge[0::2], edge[1::2] - 1


def sort_shards(cut: DataFrame, span: int, shard_bytes: int) -> DataFrame:
    """(id, tk, begin, end): what of the contexts that occur once is repeated in another context of their anchor."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        sizes = np.array([len(r[6]) for r in rows], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        valid = np.arange(len(text)) + span <= np.repeat(at[1:], sizes)
        hit = repeated_starts(text, valid, span)
        owner = np.repeat(np.arange(len(rows)), sizes)
        a, b = runs_of(hit)
        out = [(rows[k][0], rows[k][1], rows[k][5] + x - int(at[k]), rows[k][5] + y - int(at[k]) + span) for k, x, y in zip(owner[a].tolist() if len(a) else [], a.tolist(), b.tolist(), strict=True) if rows[k][4] < 2]
        # A run never goes over into the next context: its last span - 1 starts aren't valid.
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "tk", "begin", "end"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        held: list[tuple] = []
        size, seen = 0, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "tk", "anchor", "content", "n", "first", "bytes")), strict=True):
                if held and row[2] != held[-1][2] and size >= shard_bytes:
                    yield solve(held)
                    held, size = [], 0
                if (row[2], row[3]) == seen:
                    continue  # rows repeated in full bring a context again
                seen = (row[2], row[3])
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)

    id_type = None
    kind = cut.schema["id"].dataType.simpleString()
    return cut.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(shards, SPANS.format(id=kind))


def count_windows(cut: DataFrame, span: int) -> DataFrame:
    """The same for anchors with very many contents: windows are hashed to 128 bits and counted, no group is gathered."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = span // 2
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                raw = batch.column("bytes").to_pylist()
                sizes = np.array([len(b) for b in raw], np.int64)
                h = gram_hashes(np.frombuffer(b"".join(raw), np.uint8), half)
                at = np.concatenate([[0], np.cumsum(sizes)])
                s = np.concatenate([np.arange(a, b - span + 1) for a, b in zip(at, at[1:], strict=False)])
                owner = np.repeat(np.arange(len(raw)), sizes - span + 1)
                rows = batch.select(["id", "tk", "n"]).take(pa.array(owner))
                begin = batch.column("first").to_numpy()[owner] + (s - at[owner])
                hashes = (h[s].view(np.int64), h[s + span - half].view(np.int64))
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, (begin.astype(np.int64), *hashes))], ["id", "tk", "n", "begin", "h1", "h2"])

    kind = cut.schema["id"].dataType.simpleString()
    each = cut.dropDuplicates(["anchor", "content"]).mapInArrow(windows, f"id {kind}, tk long, n long, begin long, h1 long, h2 long")
    often = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("h1", "h2")
    return each.where("n < 2").join(often, ["h1", "h2"]).select("id", "tk", "begin", (F.col("begin") + span).alias("end"))


def repeated_spans(docs: DataFrame, span: int = 400, gram: int = 100, shard_bytes: int = 4 << 20, shard_contents: int = 20_000) -> DataFrame:
    """(id, tk, begin, end), which may overlap: the bytes of docs (id, tk, text) covered by strings of `span` bytes that start elsewhere too."""
    # Hints: the same plan at every size; a broadcast of what grows with the corpus is no plan.
    places = staged(anchored(docs.where(F.octet_length("text") >= span), span, gram))
    # Anchors that occur once, most of them in most texts, leave before anything else is shuffled.
    often = places.groupBy("anchor").agg(F.sum("times").alias("total")).where("total >= 2").select("anchor")
    places = staged(places.join(often.hint("merge"), "anchor"))
    counts = places.groupBy("anchor", "content").agg(F.sum("times").alias("n"), F.min(F.struct("id", "tk", "first", "size")).alias("one"))
    anchors = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"))
    known = staged(counts.join(anchors.hint("merge"), "anchor"))
    twice = known.where("n >= 2").select("anchor", "content")
    whole = places.join(twice.hint("merge"), ["anchor", "content"]).select("id", "tk", F.col("first").cast("long").alias("begin"), (F.col("last") + span).cast("long").alias("end"))
    wanted = known.where("contents >= 2").select("one.id", "one.tk", "anchor", "content", "n", "one.first", "one.size", (F.col("contents") > shard_contents).alias("wide"))
    parts = [whole, sort_shards(cut_contexts(docs, wanted.where("NOT wide"), span), span, shard_bytes)]
    if not wanted.where("wide").isEmpty():
        parts.append(count_windows(cut_contexts(docs, wanted.where("wide"), span), span))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, as_text: bool = False, gram: int = 100) -> DataFrame:
    """docs (all columns) with `kept` binary (the remaining bytes), n_bytes, n_removed and n_spans (maximal removed runs).

    gram: the bytes of an anchor, of which a window of `span` bytes has one; the result is the same whatever it is.
    as_text: kept is a string, without the rests of characters that a cut went through; null for a null text.

    Every byte goes that is covered by a string of `span` bytes which also starts anywhere else, in the same text too;
    strings are judged on the input. Texts are UTF-8 bytes; a null text counts as empty and keeps nothing; a text of
    under `span` bytes stays whole. Long texts are looked at in pieces that overlap; a worker holds one whole text and its
    spans. A null id is a value of its own; an empty table gives an empty result. Repeated rows and copies remove each other whole. Columns named kept, n_bytes,
    n_removed or n_spans are replaced, others are passed on.
    """
    keep = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    inner = {id_col: "id", text_col: "text"}
    inner |= {c: f"_vg_{k}" for k, c in enumerate(keep) if c not in inner}
    keyed = in_batches(docs).select(F.xxhash64(text_col).alias("tk"), *[F.col(c).alias(inner[c]) for c in keep])
    spans = repeated_spans(keyed, span, gram)
    lists = spans.groupBy("id", "tk").agg(F.collect_set(F.struct("begin", "end")).alias("_vg_spans")).select(F.col("id").alias(KEYS[0]), F.col("tk").alias(KEYS[1]), "_vg_spans")
    joined = keyed.join(lists.hint("merge"), F.col("id").eqNullSafe(F.col(KEYS[0])) & (F.col("tk") == F.col(KEYS[1])), "left").select(*[F.col(inner[c]).alias(c) for c in keep], "_vg_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t.encode("utf-8", "replace") for t in texts_of(batch, text_col)]
            kept, removed, runs = [], [], []
            for raw, spans in zip(raws, batch.column("_vg_spans").to_pylist(), strict=True):
                out, end, n, at = [], -1, 0, 0
                for s in sorted((x["begin"], x["end"]) for x in spans or ()):
                    if s[0] > end:
                        n += 1
                        out.append(raw[at : s[0]])
                    at = end = max(end, s[1])
                out.append(raw[at:])
                kept.append(b"".join(out))
                removed.append(len(raw) - len(kept[-1]))
                runs.append(n)
            if as_text:
                there = batch.column(text_col).is_valid().to_pylist()
                kept = [k.decode("utf-8", "ignore") if ok else None for k, ok in zip(kept, there, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array([len(r) for r in raws], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
                [*keep, "kept", "n_bytes", "n_removed", "n_spans"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(cut, f"{kinds}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")


def op5_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that occur elsewhere."""
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
