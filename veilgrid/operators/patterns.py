"""Many patterns at once: replacement in one pass over a text, names without stop fragments."""

from __future__ import annotations

from collections.abc import Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def replaced_once(text: str, new: Mapping[str, str]) -> str:
    """The text with each leftmost, then longest, occurrence of a key replaced; what was put in isn't searched again."""
    automaton = ahocorasick.Automaton()
    for old in new:
        automaton.add_word(old, len(old))
    automaton.make_automaton()
    found = sorted((end + 1 - length, -length) for end, length in automaton.iter(text))
    out, done = [], 0
    for start, minus in found:
        if start >= done:
            out += [text[done:start], new[text[start : start - minus]]]
            done = start - minus
    return "".join([*out, text[done:]])


def _replaced(texts: pd.Series, pairs: pd.Series) -> pd.Series:
    def one(text: str | None, own) -> str | None:
        if text is None or own is None:
            return text
        new: dict[str, str] = {}
        for p in own:
            if p["old"] and p["new"] is not None:
                new.setdefault(p["old"], p["new"])
        return replaced_once(text, new) if new else text

    return pd.Series([one(t, p) for t, p in zip(texts, pairs, strict=True)], dtype=object)


#: Spark replaces one string at a time; this looks for all of a document's in one pass, by an automaton.
replaced = F.pandas_udf(_replaced, StringType())


def replace_all(docs: DataFrame, pairs: DataFrame, old: str, new: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each text's own pairs (id, old, new) replaced, all in one pass: leftmost first, then longest.

    Of several `new` for an `old` the least counts; a pair with an empty or null `old` or a null `new` is left out. A
    document without pairs, or without an id, keeps its text (it isn't sent to Python); a null text stays null.
    """
    own = F.sort_array(F.collect_set(F.struct(F.col(old).alias("old"), F.col(new).alias("new"))))
    lists = pairs.where(F.col(old).isNotNull() & F.col(new).isNotNull()).groupBy(F.col(id_col).alias("_vg_id")).agg(own.alias("_vg_pairs"))
    joined = docs.join(lists, F.col(id_col) == F.col("_vg_id"), "left")
    text = replaced(F.when(F.col("_vg_pairs").isNotNull(), F.col(text_col)), F.col("_vg_pairs"))
    return joined.withColumn(text_col, F.coalesce(text, F.col(text_col))).select(*docs.columns)


def pieces(text: Column, lengths: Column) -> Column:
    """The distinct substrings of the given lengths."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(text)), of)))


def without_fragments(names: DataFrame, fragments: DataFrame, name_col: str = "name", fragment_col: str = "fragment") -> DataFrame:
    """The rows of names that hold no fragment, as equi-joins: a name's pieces of the fragments' lengths are looked up.

    The distinct lengths of the fragments (at most the longest one's) are what comes to the driver. Rows with a null
    name stay, as no fragment is in it; null fragments are left out; an empty one is in every name.
    """
    f = fragments.where(F.col(fragment_col).isNotNull()).select(F.col(fragment_col).alias("_vg_piece")).distinct()
    lengths = [r[0] for r in f.select(F.length("_vg_piece")).distinct().collect()]
    if not lengths:
        return names
    if 0 in lengths:
        return names.where(F.col(name_col).isNull())
    known = names.where(F.col(name_col).isNotNull()).select(F.col(name_col).alias("_vg_name")).distinct()
    cut = known.select("_vg_name", F.explode(pieces(F.col("_vg_name"), F.array(*[F.lit(n) for n in sorted(lengths)]))).alias("_vg_piece"))
    holding = cut.join(f, "_vg_piece", "left_semi").select("_vg_name").distinct()
    return names.join(holding, F.col(name_col) == F.col("_vg_name"), "left_anti")
