"""The registered queries of the release library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.derive import with_derived
from ..operators.release import released_columns
from ..sources.tables import table
from . import base, q_budget, q_release, q_report, q_text  # noqa: F401
from .catalog import PRICING
from .q_release import LINE_KEYS


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release the three roots of every line at an even budget, derive the charge, and measure its error per group."""
    lines = with_derived(table(spark, sf_dir, "lineitem"), PRICING)
    r = released_columns(lines, PRICING, {r: 0.4 / 3 for r in PRICING.roots}, "exp", LINE_KEYS)
    return r.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(M.wmape(F.col("charge"), F.col("r_charge")), 4).alias("wmape"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
