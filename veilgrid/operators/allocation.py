"""The exact allocation of a budget over roots, as a relation.

Minimise the sum over roots of weight * moment(eps) with sum(cost * eps) = budget and eps >= EPS_LOW. The moments fall and
are convex, so at the optimum all roots have the same gain per cost, weight * -d moment / d eps / cost, but for those at
the lower bound. Each root's gain is tabulated over a grid of eps; between its points, ln eps is linear in ln gain. All
roots' points, in order of falling gain, are the steps of one curve: at each, every root's eps and the total they cost. A
budget falls between two steps, and its allocation is the point between them that costs it. The curve is the same for
all budgets of a template, and as large as the catalog makes it, whatever the number of entities.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mechanisms import M

EPS_LOW, EPS_HIGH, STEPS = 1e-3, 100.0, 600
#: Tasks that a table of gains, 600,000 terms for each root, is worked out by.
DEALT = 32
#: The middle of the grid, for allocations that know nothing of where values are.
CENTRE = (M - 1) / 2


def exponential_gain(variance: bool) -> Column:
    """-d/d eps of E|S - t|, or of Var(S), under probabilities in proportion to exp(-eps / 2 * |s - t|): half a covariance with |s - t|.

    Distances count from the least one, so that large eps lose no digits.
    """
    t, y = F.col("t"), F.col("s") - F.col("t")
    d = F.abs(y) - F.least(t - F.floor(t), F.ceil(t) - t)
    p = F.exp(-F.col("eps") / 2 * d)
    mean = lambda x: F.sum(p * x) / F.sum(p)
    if not variance:
        return (mean(d * d) - mean(d) * mean(d)) / 2
    return (mean(y * y * d) - 2 * mean(y) * mean(y * d) - (mean(y * y) - 2 * mean(y) * mean(y)) * mean(d)) / 2


def tail_gain(mechanism: str) -> Column:
    """-d/d eps of E|S - t| of noise that is rounded to the grid and kept on it.

    The boundary at s + 1/2 parts S <= s from S > s; it adds the difference of their distances, with the probability
    that the noise goes beyond it, away from t.
    """
    eps, t, s = F.col("eps"), F.col("t"), F.col("s")
    x = F.abs(s + 0.5 - t)
    more = F.signum(s + 0.5 - t) * (F.abs(s + 1 - t) - F.abs(s - t))
    if mechanism == "blap":
        falls = x * F.exp(-eps * x)
    else:
        # Of |noise| a whole number g of steps has mass (1 - p) p^g, and gamma parts each into two even ones.
        root = F.exp(-eps / 2)
        g, gamma = F.floor(x), root / (1 + root)
        r = x - g
        power = lambda e: F.exp(-eps * e)
        slope = lambda e: e * power(e)
        low = slope(g) + r * (slope(g + 0.5) - slope(g - 0.5))
        high = slope(g + 0.5) + (r - gamma) * (slope(g + 1.5) - slope(g + 0.5)) + (power(g + 0.5) - power(g + 1.5)) * root / 2 / ((1 + root) * (1 + root))
        falls = F.when(r < gamma, low).otherwise(high)
    return F.sum(F.when(s < M - 1, more * falls / 2))


def marginal_gains(roots: DataFrame, mechanism: str, variance: bool = False) -> DataFrame:
    """roots (.., t) by the grid: all columns of roots, j, eps and gain, made to fall with eps where it doesn't.

    t is a root's place on the grid of M points, a number between 0 and M - 1.
    """
    if variance and mechanism != "exp":
        raise ValueError("the variance is an objective of the exponential law only")
    eps = F.exp(F.lit(math.log(EPS_LOW)) + F.col("j") * F.lit(math.log(EPS_HIGH / EPS_LOW) / (STEPS - 1)))
    # Few rows become many here: dealt out by what they are summed by.
    points = roots.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))).withColumn("eps", eps).repartition(DEALT, "root", "j")
    rows = points.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(M - 1))))
    gain = exponential_gain(variance) if mechanism == "exp" else tail_gain(mechanism)
    out = rows.groupBy(*roots.columns, "j", "eps").agg(gain.alias("gain"))
    so_far = Window.partitionBy(*[c for c in roots.columns if c != "t"]).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("gain", F.greatest(F.min("gain").over(so_far), F.lit(1e-300)))


def gain_curve(roots: DataFrame, mechanism: str, variance: bool = False, group: str = "template") -> DataFrame:
    """(group, root, place, eps, next_eps, total, next_total): every root's eps at each step of the curve and the one after.

    roots: (group, root, weight, cost, t). Roots without weight stay at EPS_LOW.
    """
    points = marginal_gains(roots.where("weight > 0"), mechanism, variance)
    points = points.select(group, F.col("root").alias("of"), "j", F.ln("eps").alias("x"), F.ln(F.col("weight") * F.col("gain") / F.col("cost")).alias("level"))
    steps = points.join(roots.where("weight > 0").select(group, "root", "cost"), group).withColumn("own", F.when(F.col("of") == F.col("root"), F.struct("x", "level")))
    falling = Window.partitionBy(group, "root").orderBy(F.desc("level"), "of", "j")
    rising = Window.partitionBy(group, "root").orderBy("level", F.desc("of"), F.desc("j"))
    steps = steps.withColumn("place", F.row_number().over(falling)).withColumn("a", F.last("own", True).over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("b", F.last("own", True).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    way = F.when(F.col("a.level") > F.col("b.level"), (F.col("a.level") - F.col("level")) / (F.col("a.level") - F.col("b.level"))).otherwise(0.0)
    x = F.when(F.col("a").isNull(), math.log(EPS_LOW)).when(F.col("b").isNull(), math.log(EPS_HIGH)).otherwise(F.col("a.x") + way * (F.col("b.x") - F.col("a.x")))
    at = steps.select(group, "root", "place", F.exp(x).alias("eps"), "cost")
    idle = roots.where("weight <= 0").groupBy(group).agg(F.sum(F.col("cost") * EPS_LOW).alias("idle"))
    totals = at.groupBy(group, "place").agg(F.sum(F.col("cost") * F.col("eps")).alias("total")).join(idle, group, "left")
    following = Window.partitionBy(group).orderBy("place")
    totals = totals.withColumn("total", F.col("total") + F.coalesce("idle", F.lit(0.0))).withColumn("next_total", F.lead("total").over(following)).drop("idle")
    after = Window.partitionBy(group, "root").orderBy("place")
    return at.drop("cost").withColumn("next_eps", F.lead("eps").over(after)).join(totals, [group, "place"])


def exact(rows: DataFrame, mechanism: str, weighted: bool = False, variance: bool = False, group: str = "template") -> DataFrame:
    """rows (group, root, h, lo, hi, t, eps, budget, ..) with eps_root, the exact optimum of each budget.

    h, lo, hi and t are the same for a root in all rows of a group; rows of one eps and budget are an allocation.
    weighted: the constraint is sum(eps_root * width) = eps * sum(width), as of one release of every root at eps.
    variance: minimise sum of (h * spacing)^2 * Var instead of |h| * spacing * E|error|.
    Budgets too small for EPS_LOW each are dealt evenly, and so are those of roots that are all without weight.
    """
    width = F.col("hi") - F.col("lo")
    weight = F.abs("h") * width / (M - 1)
    cost = width if weighted else F.lit(1.0)
    roots = rows.select(group, "root", (weight * weight if variance else weight).alias("weight"), cost.alias("cost"), F.col("t").cast("double").alias("t")).distinct()
    curve = gain_curve(roots, mechanism, variance, group)
    budgets = rows.withColumn("_vg_c", cost).groupBy(group, "eps", "budget").agg(F.sum("_vg_c").alias("costs"))
    budgets = budgets.select(group, F.col("eps").alias("_vg_e"), F.col("budget").alias("_vg_b"), "costs", (F.col("eps") * F.col("costs") if weighted else F.col("budget")).alias("spend"))
    met = curve.join(budgets, group).where("total <= spend AND (spend < next_total OR next_total IS NULL)")
    way = F.coalesce((F.col("spend") - F.col("total")) / (F.col("next_total") - F.col("total")), F.lit(0.0))
    found = met.select(group, "root", "_vg_e", "_vg_b", (F.col("eps") + way * (F.coalesce("next_eps", "eps") - F.col("eps"))).alias("_vg_x"))
    heavy = roots.groupBy(group).agg(F.max("weight").alias("_vg_w"), F.sum("cost").alias("_vg_s"))
    out = rows.join(heavy, group).withColumn("_vg_b", F.col("budget")).withColumn("_vg_e", F.col("eps")).join(found, [group, "root", "_vg_e", "_vg_b"], "left")
    even = (F.col("eps") * F.col("_vg_s") if weighted else F.col("budget")) / F.col("_vg_s")
    eps_root = F.when((even <= EPS_LOW) | (F.col("_vg_w") <= 0), even).otherwise(F.coalesce("_vg_x", F.lit(EPS_LOW)))
    return out.withColumn("eps_root", eps_root).select(*rows.columns, "eps_root")
