"""Text: pseudonyms and their restoration, extraction of entities and values."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .patterns import replace_all

# Titles that are taken off names, in the order in which they are tried.
TITLES = ["Prof ", "Prof.", "Prof", "Mrs. ", "Mrs ", "Mrs.", "Mrs", "Mr ", "Mr. ", "Mr.", "Mr", "Ms. ", "Ms.", "Ms", "Herr ", "Herrn ", "Frau ", "M. ", "Mme. ", "M ", "Mme ", "Madame ", "Monsieur ", '"', "[", "]", "\\ ", "Dr. ", "Dr.", "Miss ", "Miss"]
# What entities look like.
PATTERNS = {
    "age": r"\b(\d{1,3})\b",
    "zipcode": r"\b(\d{5}(?:-\d{4})?)\b",
    "money": r"([-+]?\d+(?:,\d+)*(?:\.\d+)?)",
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
    "ip": r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b",
    "token": r"token = \"([0-9a-f]+)\"",
}
PAIR_NAME = r"([A-Za-z][A-Za-z0-9_]*)\s*[:=]\s*[-+]?\d+(?:\.\d+)?"
PAIR_VALUE = r"[A-Za-z][A-Za-z0-9_]*\s*[:=]\s*([-+]?\d+(?:\.\d+)?)"
FINAL_CLASS = r"(?i)FINAL_CLASS\s*[:=]\s*(-?\d+)"


def entities(docs: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, entity): every match of the kind's pattern, in order."""
    text = F.regexp_replace(text_col, "[a-zA-Z]", "") if kind == "money" else F.col(text_col)
    return docs.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 1)).alias("position", "entity"))


def first_word_replaced(text: Column, word: Column, other: Column) -> Column:
    """The first occurrence of word as a whole word, replaced; other occurrences stay."""
    at = F.regexp_instr(text, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\b")))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), other, F.substring(text, at + F.length(word), F.length(text)))).otherwise(text)


def pseudonym(kind: str, entity: Column, secret: str = "veil") -> Column:
    """A token for an entity: its kind and 12 digits of a keyed hash."""
    return F.concat(F.lit(f"<{kind}:"), F.substring(F.sha2(F.concat_ws(":", F.lit(secret), F.lit(kind), entity), 256), 1, 12), F.lit(">"))


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


#: Unicode's composed form (NFC); Spark has no function for it.
composed = F.pandas_udf(_composed, StringType())


def number_forms(entity: Column) -> Column:
    """A number's ways of being written: as it is, without thousands separators, and with comma and dot exchanged."""
    plain = F.replace(entity, F.lit(","), F.lit(""))
    return F.array_distinct(F.array(entity, plain, F.translate(entity, ",.", ".,"), F.translate(plain, ".", ",")))


def with_number_forms(pairs: DataFrame) -> DataFrame:
    """A mapping (id, kind, entity, token) with a row for each form that a numeric token may come back in."""
    forms = F.when(F.col("token").rlike(r"^[-+]?[0-9][0-9.,]*$"), number_forms(F.col("token"))).otherwise(F.array("token"))
    return pairs.withColumn("token", F.explode(forms))


def mapping(docs: DataFrame, kinds: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, entity, token): the distinct entities of each document with their tokens."""
    out = None
    for kind in kinds:
        one = entities(docs, kind, id_col, text_col).select(id_col, F.lit(kind).alias("kind"), "entity").distinct().withColumn("token", pseudonym(kind, F.col("entity")))
        out = one if out is None else out.unionByName(one)
    return out


def pseudonymise(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every entity replaced by its token, both in composed form (NFC), in one pass: leftmost first, then longest."""
    nfc = pairs.withColumn("entity", composed("entity"))
    return replace_all(docs.withColumn(text_col, composed(text_col)), nfc, "entity", "token", id_col, text_col)


def restore(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every token replaced by its entity, in one pass; a numeric token in any of number_forms."""
    return replace_all(docs, with_number_forms(pairs), "token", "entity", id_col, text_col)


def shifted_digits(number: Column, key: Column, secret: str = "veil") -> Column:
    """A number's digits shifted by keyed amounts modulo 10, position by position; separators keep their places."""
    chars = F.split(number, "")
    h = F.sha2(F.concat_ws(":", F.lit(secret), key), 256)
    def shift(c: Column, i: Column) -> Column:
        amount = F.conv(F.substring(h, i % 64 + 1, F.lit(1)), 16, 10).cast("int")
        return F.when(c.rlike("^[0-9]$"), F.pmod(c.cast("int") + amount, F.lit(10)).cast("string")).otherwise(c)
    return F.array_join(F.transform(chars, shift), "")


def without_titles(name: Column) -> Column:
    for t in TITLES:
        name = F.replace(name, F.lit(t), F.lit(""))
    return name


def after_last(text: Column, delimiter: str) -> Column:
    return F.trim(F.substring_index(text, delimiter, -1))


def reply_values(replies: DataFrame, synonyms: DataFrame, roots: DataFrame, keys: Sequence[str], text_col: str = "reply") -> DataFrame:
    """(keys, root, value): `name: number` and `name = number` pairs; names or synonyms of roots; the last duplicate wins.

    synonyms: (name, stem); roots: (template, root). keys holds template.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(PAIR_NAME), 1).alias("name"), F.regexp_extract_all(text_col, F.lit(PAIR_VALUE), 1).alias("value"))
    found = replies.select(*keys, F.posexplode(pairs).alias("at", "p")).select(*keys, "at", F.lower("p.name").alias("name"), F.col("p.value").cast("double").alias("value"))
    named = found.join(F.broadcast(synonyms), "name", "left")
    r = roots.select("template", "root", F.lower("root").alias("stem"))
    direct = named.join(F.broadcast(r.withColumnRenamed("stem", "name")), ["template", "name"]).select(*keys, "at", "root", "value")
    known = r.select("template", F.col("stem").alias("name"))
    other = named.join(F.broadcast(known), ["template", "name"], "left_anti").join(F.broadcast(r), ["template", "stem"]).select(*keys, "at", "root", "value")
    return direct.unionByName(other).groupBy(*keys, "root").agg(F.max_by("value", "at").alias("value"))
