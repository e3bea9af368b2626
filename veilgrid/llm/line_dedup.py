"""Line deduplication by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged


def boilerplate_lines(docs: DataFrame, host_col: str, text_col: str, max_percent: int, min_pages: int) -> DataFrame:
    """(host, boiler): the lines on more than max_percent % of a host's pages, and on min_pages at least.

    A page has few lines, so a host has at most 100 / max_percent times its mean number of lines of them: the array
    per host is bounded however many pages the host has.
    """
    pages = docs.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    lines = docs.select(F.col(host_col).alias("host"), F.explode(F.array_distinct(F.split(text_col, "\n", -1))).alias("line"))
    often = lines.where(F.trim("line") != "").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often, pages = often.alias("o"), pages.alias("p")
    hit = often.join(pages, F.col("o.host").eqNullSafe(F.col("p.host"))).where(F.col("n") * 100 > F.col("pages") * max_percent)
    return hit.groupBy(F.col("o.host").alias("host")).agg(F.sort_array(F.collect_list("line")).alias("boiler"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_percent: int = 5, min_pages: int = 3) -> DataFrame:
    """docs with boilerplate lines taken out of the text, plus `n_lines` and `n_dropped`.

    A line is boilerplate on its host if more than max_percent % of the host's pages have it, and at least min_pages
    do. Lines are compared exactly; blank lines neither count nor go. A null host is a host of its own. A null text
    stays null with 0 lines; an empty text has one (blank) line. Repeated rows count as separate pages. Lines and texts
    of any length count whole; an empty table gives an empty result. Columns named
    n_lines or n_dropped are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    boiler = staged(boilerplate_lines(docs, host_col, text_col, max_percent, min_pages)).select(F.col("host").alias("_vg_host"), F.col("boiler").alias("_vg_boiler"))
    joined = docs.select(*keep).join(boiler, F.col(host_col).eqNullSafe(F.col("_vg_host")), "left")
    lines = F.split(text_col, "\n", -1)
    kept = F.when(F.col("_vg_boiler").isNull(), F.col("_vg_lines")).otherwise(F.filter("_vg_lines", lambda x: ~F.array_contains("_vg_boiler", x)))
    out = joined.withColumn("_vg_lines", lines).withColumn("_vg_kept", kept)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(n(c)).cast("long")
    columns = [F.array_join("_vg_kept", "\n").alias(text_col) if c == text_col else F.col(c) for c in keep]
    return out.select(*columns, size("_vg_lines").alias("n_lines"), (size("_vg_lines") - size("_vg_kept")).alias("n_dropped"))


def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    out = drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, * FROM documents),
     lines AS (SELECT DISTINCT r, source, unnest(string_split(text, chr(10))) AS line FROM rows),
     pages AS (SELECT source, count(*) AS pages FROM rows GROUP BY source),
     boiler AS (SELECT l.source, l.line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
                WHERE trim(l.line, ' ') <> '' GROUP BY l.source, l.line HAVING count(*) >= 3 AND count(*) * 100 > any_value(p.pages) * 5),
     ordered AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS k FROM rows),
     marked AS (SELECT o.*, b.line IS NOT NULL AS bad FROM ordered o
                LEFT JOIN boiler b ON o.source IS NOT DISTINCT FROM b.source AND o.line = b.line),
     kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped,
                     coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT bad), '') AS t FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(t) END AS kept_sha256
FROM rows d LEFT JOIN kept USING (r)
"""
