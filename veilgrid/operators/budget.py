"""Splitting a privacy budget over roots, and keeping account of what was spent."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dialect import SPARK, Dialect
from ..plans.catalog import Template

CELL = ("template", "eps", "b_setting")
#: Budgets in multiples of eps, by the number of roots k.
MULTIPLES = {"k+1": lambda k: k + 1, "2k+1": lambda k: 2 * k + 1, "3k+1": lambda k: 3 * k + 1}


def inherited(template: Template, bounds: Mapping[str, tuple[float, float]], eps: str, d: Dialect = SPARK) -> dict[str, tuple[str, str]]:
    """SQL of (budget, effective eps) of every node, from the SQL of eps: down the graph, a node inherits from its parents.

    A root has eps. A derived node with lower bound m is left at an effective eps / m by its roots. If the parents'
    largest effective eps over m is within eps, that is its budget; else eps / m if that is; else what is missing in
    1 / eps^2 to the target. m = 0 tells nothing about the roots: the budget is then eps.
    """
    inf = d.num(1e300)
    out = {r: (f"({eps})", f"({eps})") for r in template.roots}
    for node, _, partials in template.nodes:
        if partials is None:
            continue
        m = bounds[node][0]
        own = f"(({eps}) / {d.num(m)})" if m > 0 else inf
        parents = [out[p][1] for p in partials]
        over = f"(greatest({', '.join(parents)}) / {d.num(m)})" if m > 0 and len(parents) > 1 else f"({parents[0]} / {d.num(m)})" if m > 0 else inf
        rest = f"sqrt({d.num(1)} / nullif({d.num(1)} / (({eps}) * ({eps})) - {d.num(1)} / ({own} * {own}), {d.num(0)}))" if m > 0 else f"({eps})"
        out[node] = (f"CASE WHEN {over} <= {eps} THEN {over} WHEN {own} <= {eps} THEN {own} ELSE {rest} END", own)
    return out


def with_budget(roots: DataFrame, epsilons: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    """roots (template, root, ...) by epsilons (eps) and settings, with k and the total `budget`."""
    k = F.count(F.lit(1)).over(Window.partitionBy("template"))
    settings = F.array(*[F.struct(F.lit(s).alias("b_setting"), (F.lit(int(s[0]) if s[0] != "k" else 1)).alias("times")) for s in MULTIPLES])
    grid = epsilons.select("eps", F.explode(settings).alias("s")).select("eps", "s.b_setting", "s.times")
    return roots.withColumn("k", k).crossJoin(F.broadcast(grid)).withColumn("budget", (F.col("times") * F.col("k") + 1) * F.col("eps")).drop("times")


def uniform(rows: DataFrame, cell: tuple[str, ...] = CELL) -> DataFrame:
    """eps_root = budget / k."""
    return rows.withColumn("eps_root", F.col("budget") / F.count(F.lit(1)).over(Window.partitionBy(*cell)))


def in_proportion(rows: DataFrame, weight: Column, cell: tuple[str, ...] = CELL) -> DataFrame:
    """eps_root in proportion to a weight; even where all weights are zero."""
    w = Window.partitionBy(*cell)
    total = F.sum("_vg_w").over(w)
    share = F.when(total > 0, F.col("_vg_w") / total).otherwise(1 / F.count(F.lit(1)).over(w))
    return rows.withColumn("_vg_w", weight).withColumn("eps_root", F.col("budget") * share).drop("_vg_w")


def square_root(rows: DataFrame, cell: tuple[str, ...] = CELL, weighted: bool = False) -> DataFrame:
    """eps_root in proportion to sqrt(|h| * spacing).

    weighted: under sum(eps_root * width) = eps * sum(width), where the optimum is in proportion to sqrt(|h|).
    """
    if not weighted:
        return in_proportion(rows, F.sqrt(F.abs("h") * (F.col("hi") - F.col("lo")) / 999), cell)
    w, width, root = Window.partitionBy(*cell), F.col("hi") - F.col("lo"), F.sqrt(F.abs("h"))
    spent = F.sum(root * width).over(w)
    return rows.withColumn("eps_root", F.when(spent > 0, F.col("eps") * F.sum(width).over(w) * root / spent).otherwise(F.col("eps")))


def cube_root(rows: DataFrame, eps_min: float = 1e-3, eps_max: float = 20.0, cell: tuple[str, ...] = CELL, widths: bool = True) -> DataFrame:
    """eps_root in proportion to ((h * width)^2)^(1/3) within [eps_min, eps_max]: what a bound takes or leaves is dealt to the others.

    Without `widths`, (h^2)^(1/3): for releases in value space.
    """
    w = Window.partitionBy(*cell)
    out = rows.withColumn("_vg_c", F.pow(F.pow(F.col("h") * ((F.col("hi") - F.col("lo")) if widths else F.lit(1.0)), 2), 1 / 3)).withColumn("_vg_fixed", F.lit(None).cast("double"))
    for _ in range(4):
        rest = F.col("budget") - F.coalesce(F.sum("_vg_fixed").over(w), F.lit(0.0))
        free = F.sum(F.when(F.col("_vg_fixed").isNull(), F.col("_vg_c"))).over(w)
        count = F.sum(F.when(F.col("_vg_fixed").isNull(), 1)).over(w)
        out = out.withColumn("_vg_rest", rest).withColumn("_vg_free", free).withColumn("_vg_n", count)
        share = F.when(F.col("_vg_free") > 0, F.col("_vg_rest") * F.col("_vg_c") / F.col("_vg_free")).otherwise(F.col("_vg_rest") / F.col("_vg_n"))
        out = out.withColumn("eps_root", F.coalesce("_vg_fixed", share))
        bound = F.when(F.col("eps_root") < eps_min, eps_min).when(F.col("eps_root") > eps_max, eps_max)
        out = out.withColumn("_vg_fixed", F.coalesce("_vg_fixed", bound))
    return out.withColumn("eps_root", F.least(F.greatest("eps_root", F.lit(eps_min)), F.lit(eps_max))).drop("_vg_c", "_vg_fixed", "_vg_rest", "_vg_free", "_vg_n")


def ledger(events: DataFrame, entity: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), eps: str = "eps", limit: float | None = None) -> DataFrame:
    """events with `spent`, what the entity has spent up to each, and `allowed`, whether that is within the limit."""
    running = F.sum(eps).over(Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = events.withColumn("spent", running)
    return out if limit is None else out.withColumn("allowed", F.round("spent", 9) <= limit)
