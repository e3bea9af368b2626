"""Values and intervals: joins on bins, classes by binary search in sorted cuts. No plan has a nested loop."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def range_join(values: DataFrame, intervals: DataFrame, value: str, on: Sequence[str] = (), lo: str = "lo", hi: str = "hi", lo_closed: str = "lo_closed", hi_closed: str = "hi_closed") -> DataFrame:
    """The rows of values with each interval (on, lo, hi, lo_closed, hi_closed, ..) that holds the value; an equi-join.

    Intervals may overlap and be of any width. One of width w lies in bins of the least power of two from w on, so it
    touches two of them at most; a value is looked up in one bin per power that occurs (some fifty at most, and only
    those numbers come to the driver, with the values' least and greatest). A null bound is open to all finite values;
    a null flag is an open bound. Null, NaN and infinite values are in no interval, a null in `on` equals nothing.
    Other columns of the two sides must have different names.
    """
    kept = values.where(_number(F.col(value).cast("double"))).withColumn("_vg_v", F.col(value).cast("double"))
    least, most = kept.agg(F.min("_vg_v"), F.max("_vg_v")).first()
    if least is None:
        least = most = 0.0
    size = max(abs(least), abs(most))
    floor = math.ceil(math.log2(size)) - 50 if size > 0 else 0
    a = F.greatest(F.coalesce(F.col(lo).cast("double"), F.lit(least)), F.lit(least))
    b = F.least(F.coalesce(F.col(hi).cast("double"), F.lit(most)), F.lit(most))
    width = F.least(F.col("_vg_b") - F.col("_vg_a"), F.lit(sys.float_info.max))
    level = F.when(width > 0, F.greatest(F.ceil(F.log2(width)).cast("int"), F.lit(floor))).otherwise(floor)
    cut = intervals.withColumn("_vg_a", a).withColumn("_vg_b", b).where("_vg_a <= _vg_b").withColumn("_vg_level", level)
    levels = sorted(r[0] for r in cut.select("_vg_level").distinct().collect())
    bin_of = lambda x: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("_vg_level")))
    right = cut.withColumn("_vg_bin", F.explode(F.sequence(bin_of("_vg_a"), bin_of("_vg_b")))).drop("_vg_a", "_vg_b")
    left = kept.withColumn("_vg_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("_vg_bin", bin_of("_vg_v"))
    joined = left.join(right, [*on, "_vg_level", "_vg_bin"])
    above = F.col(lo).isNull() | (F.col("_vg_v") > F.col(lo)) | ((F.col("_vg_v") == F.col(lo)) & F.coalesce(F.col(lo_closed), F.lit(False)))
    below = F.col(hi).isNull() | (F.col("_vg_v") < F.col(hi)) | ((F.col("_vg_v") == F.col(hi)) & F.coalesce(F.col(hi_closed), F.lit(False)))
    return joined.where(above & below).drop("_vg_level", "_vg_bin", "_vg_v")


def range_totals(values: DataFrame, intervals: DataFrame, value: str, key: str, on: str, lo: str = "lo", hi: str = "hi", segments: int = 256) -> DataFrame:
    """(key, n, total): how many values are above an interval's lo and not above its hi, and their sum; without a pair of both.

    The count and the sum up to each end are running ones, and an interval has the difference of its ends'; so the work
    grows with the rows of both sides, not with their pairs. A null hi is open, a null lo holds nothing; intervals without
    values are left out, and rows with the same key count together. Values and ends of a group are dealt to `segments`
    ranges of equal width, each sorted by itself; what the earlier ranges hold is added from a table of totals.
    """
    v = values.where(_number(F.col(value).cast("double"))).select(F.col(on).alias("_vg_on"), F.col(value).cast("double").alias("_vg_x"), F.lit(0).alias("_vg_end"), F.col(value).cast("double").alias("_vg_v"), F.lit(None).cast(intervals.schema[key].dataType).alias(key))
    v = v.where("_vg_on IS NOT NULL")
    least, most = v.agg(F.min("_vg_x"), F.max("_vg_x")).first()
    if least is None:
        least = most = 0.0
    # Ends beyond all values are as good as at the values' own ends; those below them come before every value.
    low, high = F.col(lo).cast("double"), F.coalesce(F.col(hi).cast("double"), F.lit(math.inf))
    ends = F.explode(F.array(*[F.struct(x.alias("x"), F.lit(sign).alias("end")) for x, sign in ((low, -1), (high, 1))])).alias("e")
    kept = intervals.where(F.col(lo).isNotNull() & F.col(on).isNotNull() & (low < high))
    e = kept.select(F.col(on).alias("_vg_on"), key, ends).select("_vg_on", F.col("e.x").alias("_vg_x"), F.col("e.end").alias("_vg_end"), F.lit(0.0).alias("_vg_v"), key)
    width = (most - least) / segments or 1.0
    clipped = F.greatest(F.least(F.col("_vg_x"), F.lit(most)), F.lit(least))
    rows = v.unionByName(e).withColumn("_vg_s", F.least(F.floor((clipped - least) / width), F.lit(segments - 1)).cast("int"))
    is_value = F.when(F.col("_vg_end") == 0, 1).otherwise(0)
    held = rows.where("_vg_end = 0").groupBy("_vg_on", "_vg_s").agg(F.count(F.lit(1)).alias("_vg_n"), F.sum("_vg_v").alias("_vg_t"))
    earlier = Window.partitionBy("_vg_on").orderBy("_vg_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # By range, what the ranges before it hold: a range's totals count from the next one on.
    held = held.select("_vg_on", (F.col("_vg_s") + 1).alias("_vg_from"), F.sum("_vg_n").over(earlier).alias("_vg_n0"), F.sum("_vg_t").over(earlier).alias("_vg_t0"))
    before = held.select("_vg_on", "_vg_from", "_vg_n0", "_vg_t0", F.coalesce(F.lead("_vg_from").over(Window.partitionBy("_vg_on").orderBy("_vg_from")), F.lit(segments + 1)).alias("_vg_to"))
    before = before.select("_vg_on", "_vg_n0", "_vg_t0", F.explode(F.sequence("_vg_from", F.col("_vg_to") - 1)).alias("_vg_s"))
    inside = Window.partitionBy("_vg_on", "_vg_s").orderBy("_vg_x", F.abs("_vg_end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select("_vg_on", "_vg_s", "_vg_end", key, F.sum(is_value).over(inside).alias("_vg_n"), F.sum("_vg_v").over(inside).alias("_vg_t")).where("_vg_end <> 0")
    at = run.join(F.broadcast(before), ["_vg_on", "_vg_s"], "left")
    n, total = (F.sum(F.col("_vg_end") * (F.col(f"_vg_{c}") + F.coalesce(f"_vg_{c}0", F.lit(0)))) for c in "nt")
    return at.groupBy(key).agg(n.alias("n"), total.alias("total")).where("n > 0")


def cuts_beyond(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts (array of cut, closed) the value is beyond, by binary search; a closed cut is beyond itself."""
    n = F.size(cuts)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + F.lit(1))).cast("int") + 1)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["l"] + s["h"]) / 2).cast("int")
        at = F.get(cuts, middle)
        beyond = (value > at["cut"]) | ((value == at["cut"]) & at["closed"])
        return F.when(s["l"] >= s["h"], s).when(beyond, F.struct((middle + 1).alias("l"), s["h"].alias("h"))).otherwise(F.struct(s["l"].alias("l"), middle.alias("h")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("l"), n.alias("h")), halve)["l"]


def classified(df: DataFrame, cuts: DataFrame, key: str, value: str, name: str = "class") -> DataFrame:
    """df with the number of its key's cuts (key, cut, closed) that the value is beyond.

    Null and NaN values, null keys and keys without cuts are class 0. Equal cuts count each; cuts that are null are left out.
    """
    lists = cuts.where("cut IS NOT NULL").groupBy(F.col(key).alias("_vg_key")).agg(F.sort_array(F.collect_list(F.struct(F.col("cut").cast("double").alias("cut"), (~F.col("closed")).alias("_open"), "closed"))).alias("_vg_cuts"))
    v = F.col(value).cast("double")
    found = F.when(F.col("_vg_cuts").isNull() | v.isNull() | F.isnan(v), 0).otherwise(cuts_beyond(F.col("_vg_cuts"), v))
    return df.join(lists, F.col(key) == F.col("_vg_key"), "left").withColumn(name, found).drop("_vg_key", "_vg_cuts")


def cut_table(spark: SparkSession, cuts: Iterable[tuple[str, float, bool]]) -> DataFrame:
    """(template, cut, closed) of a catalog's cuts."""
    return spark.createDataFrame(list(cuts), "template string, cut double, closed boolean")
