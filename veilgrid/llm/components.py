"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged


def rows_of(*structs: Column) -> Column:
    return F.inline(F.array(*structs))


def pair(u: Column, v: Column, *more: Column) -> Column:
    return F.struct(u.alias("u"), v.alias("v"), *more)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each node on an edge (u, v), the least node that it is connected with.

    Large star: each node points its larger neighbours at its least one; small star: its smaller ones and itself. Both
    keep the components and shorten the paths, in a number of rounds that grows with the logarithm of the longest; more
    than `rounds` of them fail the job rather than give unfinished components. A round is two exchanges by node, and is
    the last one if no edge moves.
    Every step is a window over a node's edges, which spills, so no component is ever gathered in a task's memory. Loops
    (u = v) keep single nodes; null ends are left out.
    """
    edges = staged(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL"))
    loops = edges.where("u = v").select("u").distinct()
    e = edges.where("u <> v")
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    least = F.least("u", F.min("v").over(Window.partitionBy("u")))
    for _ in range(rounds):
        both = e.select(rows_of(pair(u, v), pair(v, u))).repartition("u").dropDuplicates(["u", "v"])
        large = both.withColumn("m", least).where("v > u").select(v.alias("u"), m.alias("v"), (m != u).alias("moved"))
        # (u, v) with v < u now; small star
        star = large.withColumn("m", least).withColumn("moved", F.col("moved") | (v != m))
        e = staged(star.select(rows_of(pair(m, v, F.col("moved")), pair(m, u, F.col("moved")))).where("u <> v"))
        if not e.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError(f"components unfinished after {rounds} rounds")
    roots = e.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found, "node", "left_anti")
    return found.unionByName(alone)
