"""A corpus pipeline of the llm operators: STAGES in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm.common import documents, staged
from veilgrid.llm.jaccard import one_of_each
from veilgrid.llm.language import identify, train_languages
from veilgrid.llm.line_dedup import drop_boilerplate
from veilgrid.llm.packing import pack_documents
from veilgrid.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars as the text now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the language model rejects: no letters, or no language that fits."""
    return identify(docs, train_languages(docs)).where("NOT rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's boilerplate lines out of its documents."""
    return with_text(drop_boilerplate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return one_of_each(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of 200 bytes and more that occur elsewhere out of the documents: all of over 50 words, if these have three letters on average."""
    return with_text(remove_repeats(docs, span=200, gram=40, as_text=True).withColumn("text", F.col("kept")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens; one row per piece."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: No SQL: the language model, suffix sorting and packing aren't expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
