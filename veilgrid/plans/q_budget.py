"""Queries: budgets and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mechanisms as N
from ..functions.dialect import DUCK, SPARK, Dialect
from ..operators import allocation as L
from ..operators import budget as B
from ..operators import release as R
from ..operators.derive import bind, class_sql, derived_columns, layered_sql, sensitivity_columns, with_derived
from ..sources.tables import patients, patients_sql, table, wide, wide_sql
from .base import BY, EPSILONS, allocations, allocations_sql, at_means_sql, exact_sql, grid_of_budgets, observations, observations_sql, portable, query, results, results_sql, rounded, sensitivities, swept_entities, worked_out
from .catalog import DOMAINS, LIPSCHITZ, PRICING, Template, templates
from .q_release import LINE, LINE_KEYS, P

A = f"{P}, {allocations_sql()}"
D = DUCK
HOMA, VASCULAR, FIB4 = (templates()[t] for t in ("HOMA", "VASCULAR", "FIB4"))


def counted(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows by template and root, with the number of patients that they hold for."""
    return rows.join(patients(spark, sf_dir).groupBy("template", "root").agg(F.count(F.lit(1)).alias("n")), ["template", "root"])


COUNTED = "JOIN (SELECT template, root, count(*) AS n FROM patients GROUP BY 1, 2) USING (template, root)"


#: Budgets in multiples of eps: of t turns, and of k roots or n nodes.
TURNS = 4
TOTALS = (("t", f"{TURNS}"), ("k", "k"), ("k+1", "k + 1"), ("2k+1", "2 * k + 1"), ("3k+1", "3 * k + 1"), ("n", "n"))
NODE_COUNTS = [(t.name, len(t.roots), len(t.roots) + sum(p is not None for _, _, p in t.nodes)) for t in templates().values() if t.name in DOMAINS]


@query(
    "bud1_totals",
    f"{P}, c(template, k, n) AS (VALUES {', '.join(map(str, NODE_COUNTS))}), e(eps) AS (VALUES {', '.join(f'({e}::DOUBLE)' for e in EPSILONS)}) "
    + "SELECT template, b_setting, eps, round(f * eps, 6) AS budget, round(f * eps * patients, 4) AS all_patients FROM ("
    + " UNION ALL ".join(f"SELECT template, '{name}' AS b_setting, {f} AS f, count(DISTINCT patient_id) AS patients FROM patients JOIN c USING (template) GROUP BY template, k, n" for name, f in TOTALS)
    + ") CROSS JOIN e",
)
def bud1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each template's total at each eps, and what the table's patients spend together."""
    n = patients(spark, sf_dir).groupBy("template").agg(F.count_distinct("root").alias("k"), F.count_distinct("patient_id").alias("patients"))
    nodes = spark.createDataFrame([(t, n) for t, _, n in NODE_COUNTS], "template string, n int")
    grid = n.join(F.broadcast(nodes), "template").withColumn("eps", F.explode(F.array(*[F.lit(e) for e in EPSILONS])))
    each = grid.select("template", "eps", "patients", F.explode(F.array(*[F.struct(F.lit(name).alias("b_setting"), F.expr(f).cast("double").alias("f")) for name, f in TOTALS])).alias("x"))
    budget = F.col("x.f") * F.col("eps")
    return each.select("template", "x.b_setting", "eps", F.round(budget, 6).alias("budget"), F.round(budget * F.col("patients"), 4).alias("all_patients"))


@query("bud2_uniform", f"{P}, {allocations_sql()} SELECT template, root, b_setting, eps, round(eps_root, 6) AS eps_root, n FROM allocs {COUNTED} WHERE config = 'roots'")
def bud2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = counted(spark, sf_dir, allocations(spark).where("config = 'roots'"))
    return rounded(a.select("template", "root", "b_setting", "eps", "eps_root", "n"), 6)


#: What a root without influence on the target is released at.
EPS_MIN = 1e-3


@query(
    "bud7_square_root",
    f"{P}, {allocations_sql()}, w AS (SELECT *, sqrt(abs(h) * (hi - lo) / 999) AS w FROM budgets) SELECT template, root, b_setting, eps, round(greatest(budget * w / sum(w) OVER (PARTITION BY template, eps, b_setting), {EPS_MIN}::DOUBLE), 6) AS eps_root, n FROM w {COUNTED}",
)
def bud7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed form under the continuous law, with a least budget."""
    best = B.square_root(grid_of_budgets(spark)).withColumn("eps_root", F.greatest("eps_root", F.lit(EPS_MIN)))
    return rounded(counted(spark, sf_dir, best).select("template", "root", "b_setting", "eps", "eps_root", "n"), 6)


def inherited_sql() -> str:
    """Layer by layer over tables of nodes and edges: b<k> has the nodes of the first k layers."""
    depth: dict[tuple[str, str], int] = {}
    nodes, edge_rows = [], []
    for t in (t for t in templates().values() if t.name in DOMAINS):
        depth |= {(t.name, r): 0 for r in t.roots}
        for n, _, p in t.nodes:
            if p is not None:
                depth[t.name, n] = 1 + max(depth[t.name, x] for x in p)
                nodes.append(f"('{t.name}', '{n}', {depth[t.name, n]}, {LIPSCHITZ[n][0]!r}::DOUBLE)")
                edge_rows += [f"('{t.name}', '{x}', '{n}')" for x in p]
    sql = f"{P}, e AS (SELECT c_custkey AS patient_id, 0.05::DOUBLE + 0.01::DOUBLE * (c_custkey % 10) AS eps FROM customer), nd(template, node, layer, m) AS (VALUES {', '.join(nodes)}), ed(template, parent, node) AS (VALUES {', '.join(edge_rows)}), b0 AS (SELECT patient_id, template, root AS node, eps, eps AS budget, eps AS effective FROM patients JOIN e USING (patient_id))"
    for k in range(1, max(depth.values()) + 1):
        rule = "CASE WHEN m > 0 AND max(b.effective) / m <= b.eps THEN max(b.effective) / m WHEN m > 0 AND b.eps / m <= b.eps THEN b.eps / m WHEN m > 0 THEN sqrt(1 / (1 / (b.eps * b.eps) - 1 / ((b.eps / m) * (b.eps / m)))) ELSE b.eps END"
        sql += f", b{k} AS (SELECT * FROM b{k - 1} UNION ALL SELECT b.patient_id, nd.template, nd.node, b.eps, {rule}, CASE WHEN m > 0 THEN b.eps / m ELSE 1e300 END FROM nd JOIN ed USING (template, node) JOIN b{k - 1} b ON b.template = ed.template AND b.node = ed.parent WHERE nd.layer = {k} GROUP BY b.patient_id, nd.template, nd.node, b.eps, m)"
    return f"{sql} SELECT patient_id, template, node, round(budget, 6) AS budget, round(least(effective, 1000000), 4) AS effective FROM b{max(depth.values())}"


@query("bud3_inherited", inherited_sql())
def bud3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets down each template's graph, at an eps of each patient's own."""
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), (0.05 + 0.01 * (F.col("c_custkey") % 10)).alias("eps"))
    parts = []
    for t in (t for t in templates().values() if t.name in DOMAINS):
        nodes = [F.struct(F.lit(n).alias("node"), F.expr(b).alias("budget"), F.expr(x).alias("effective")) for n, (b, x) in B.inherited(t, LIPSCHITZ, "eps").items()]
        parts.append(e.select("patient_id", F.lit(t.name).alias("template"), F.explode(F.array(*nodes)).alias("x")).select("patient_id", "template", "x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("patient_id", "template", "node", F.round("budget", 6).alias("budget"), F.round(F.least("effective", F.lit(1e6)), 4).alias("effective"))


NODE_ROWS = [(t.name, r, "root", 0.0) for t in templates().values() for r in t.roots] + [(t.name, n, "derived", LIPSCHITZ[n][0]) for t in templates().values() for n, _, p in t.nodes if p is not None]
NODE_SQL = "nodes(template, node, kind, m) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {m!r}::DOUBLE)" for a, b, c, m in NODE_ROWS) + ")"


def node_budgets(spark: SparkSession, sf_dir: str, budget: Column) -> DataFrame:
    nodes = spark.createDataFrame(NODE_ROWS, "template string, node string, kind string, m double")
    n = patients(spark, sf_dir).groupBy("template").agg(F.count_distinct("patient_id").alias("n"))
    return nodes.join(n, "template").select("template", "node", F.round(budget, 6).alias("budget"), "n")


PER_TEMPLATE = "JOIN (SELECT template, count(DISTINCT patient_id) AS n FROM patients GROUP BY 1) USING (template)"


@query("bud4_roots_only", f"{P}, {NODE_SQL} SELECT template, node, CASE WHEN kind = 'root' THEN 0.1 ELSE 0.0 END::DOUBLE AS budget, n FROM nodes {PER_TEMPLATE}")
def bud4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_budgets(spark, sf_dir, F.when(F.col("kind") == "root", 0.1).otherwise(0.0))


@query("bud5_by_bound", f"{P}, {NODE_SQL} SELECT template, node, round(CASE WHEN kind = 'root' OR m = 0 THEN 0.1::DOUBLE ELSE 0.1::DOUBLE / m END, 6) AS budget, n FROM nodes {PER_TEMPLATE}")
def bud5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_budgets(spark, sf_dir, F.when((F.col("kind") == "root") | (F.col("m") == 0), 0.1).otherwise(0.1 / F.when(F.col("m") > 0, F.col("m"))))


def clamp_sql(widths: bool = True) -> str:
    """The cube-root allocation: four rounds in which what a bound takes or leaves is dealt to the others."""
    over = "OVER (PARTITION BY template, eps, b_setting)"
    sql = f"SELECT *, power(power(h * {'(hi - lo)' if widths else '1'}, 2), 1.0 / 3) AS c, NULL::DOUBLE AS fixed, 0::DOUBLE AS eps_root FROM budgets"
    for _ in range(4):
        sql = f"SELECT * EXCLUDE (eps_root, rest, free, cnt), coalesce(fixed, CASE WHEN free > 0 THEN rest * c / free ELSE rest / cnt END) AS eps_root FROM (SELECT *, budget - coalesce(sum(fixed) {over}, 0) AS rest, sum(CASE WHEN fixed IS NULL THEN c END) {over} AS free, sum(CASE WHEN fixed IS NULL THEN 1 END) {over} AS cnt FROM ({sql}))"
        sql = f"SELECT * EXCLUDE (fixed), coalesce(fixed, CASE WHEN eps_root < 0.001 THEN 0.001 WHEN eps_root > 20 THEN 20 END) AS fixed FROM ({sql})"
    return f"SELECT * EXCLUDE (eps_root), least(greatest(eps_root, 0.001), 20) AS eps_root FROM ({sql})"


for _name, _widths in (("bud6_cube_root", True), ("bud6_cube_root_plain", False)):

    def _cube(spark: SparkSession, sf_dir: str, widths: bool = _widths) -> DataFrame:
        rows = allocations(spark).where("config = 'roots'").drop("eps_root", "config")
        return rounded(counted(spark, sf_dir, B.cube_root(rows, widths=widths)).select("template", "root", "b_setting", "eps", "eps_root", "n"), 6)

    query(_name, f"{A}, cube AS ({clamp_sql(_widths)}) SELECT template, root, b_setting, eps, round(eps_root, 6) AS eps_root, n FROM cube {COUNTED}")(_cube)


def own_sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(template, root, lo, hi, h, t): at the mean of the table's own patients, the target's derivative by each root and the root's place on the grid.

    One aggregate; a mean for each root of the catalog comes to the driver, so the table is read once.
    """
    means: dict[str, dict[str, float]] = {}
    for r in patients(spark, sf_dir).groupBy("template", "root").agg(F.avg("value").alias("mean")).collect():
        means.setdefault(r.template, {})[r.root] = r["mean"]
    schema = "template string, root string, lo double, hi double, h double, t double"
    return worked_out(spark, " UNION ALL ".join(at_means_sql(SPARK, templates()[t], m) for t, m in sorted(means.items()))) if means else spark.createDataFrame([], schema)


def own_means_sql(means: str, t: Template) -> str:
    sql = means
    for column, expression in derived_columns(D, t):
        sql = f"SELECT *, {expression} AS {D.quote(column)} FROM ({sql})"
    rows = []
    for r, h in sensitivity_columns(D, t):
        lo, hi = map(D.num, t.domains[r])
        rows.append(f"SELECT '{t.name}' AS template, '{r}' AS root, {lo} AS lo, {hi} AS hi, {D.double(h)} AS h, round(({D.quote(r)} - {lo}) / ({hi} - {lo}) * 999, 4) AS t FROM ({sql})")
    return " UNION ALL ".join(rows)


def own_budgets_sql() -> str:
    """own: the table's own sensitivities and places with every budget."""
    parts = []
    for t in (t for t in templates().values() if t.name in DOMAINS):
        picks = ", ".join(f"avg(CASE WHEN root = '{r}' THEN value END) AS {D.quote(r)}" for r in t.roots)
        parts.append(f"m_{t.name} AS MATERIALIZED (SELECT {picks} FROM patients WHERE template = '{t.name}'), o_{t.name} AS ({own_means_sql(f'SELECT * FROM m_{t.name}', t)})")
    union = " UNION ALL ".join(f"SELECT * FROM o_{t.name}" for t in templates().values() if t.name in DOMAINS)
    eps = ", ".join(f"({e}::DOUBLE)" for e in EPSILONS)
    return f"{P}, {', '.join(parts)}, own AS MATERIALIZED (SELECT o.*, eps, b_setting, (times * count(*) OVER (PARTITION BY template, eps, b_setting) + 1) * eps AS budget FROM ({union}) o CROSS JOIN (VALUES {eps}) e(eps) CROSS JOIN (VALUES ('k+1', 1), ('2k+1', 2), ('3k+1', 3)) b(b_setting, times))"


_EXACT = [(m, w, False) for m in ("exp", "blap", "stair") for w in (False, True)] + [("exp", False, True), ("exp", True, True)]
for _k, (_mechanism, _weighted, _variance) in enumerate(_EXACT):

    def _exact(spark: SparkSession, sf_dir: str, mechanism: str = _mechanism, weighted: bool = _weighted, variance: bool = _variance) -> DataFrame:
        """The exact allocation of every budget, with sensitivities and places at the patients' own means."""
        grid = spark.createDataFrame([(e,) for e in EPSILONS], "eps double")
        out = L.exact(B.with_budget(own_sensitivities(spark, sf_dir), grid), mechanism, weighted, variance)
        return out.select("template", "root", "b_setting", "eps", F.round("h", 6).alias("h"), F.round("budget", 6).alias("budget"), F.round("eps_root", 5).alias("eps_root"))

    query(
        f"bud{8 + _k % 6}_exact_{_mechanism}{'_weighted' if _weighted else ''}{'_var' if _variance else ''}",
        f"{own_budgets_sql()}, {exact_sql('own', _mechanism, _weighted, _variance)} SELECT template, root, b_setting, eps, round(h, 6) AS h, round(budget, 6) AS budget, round(eps_root, 5) AS eps_root FROM best",
    )(_exact)


def moments(d: Dialect) -> str:
    """E|S - t| and Var(S) of each law at t = 500 over the whole grid, at an eps from each event type's count."""
    one, half = d.num(1), d.num(0.5)
    grid = "SELECT explode(sequence(0, 999)) AS s" if d.spark else "SELECT unnest(range(1000)) AS s"

    def laplace(x: str) -> str:
        return f"CASE WHEN {x} < {d.num(0)} THEN {half} * exp(eps * ({x})) ELSE {one} - {half} * exp(-eps * ({x})) END"

    def staircase(x: str) -> str:
        p, g = "exp(-eps)", f"floor(abs({x}))"
        gamma, r = f"(sqrt({p}) / (sqrt({p}) + {one}))", f"(abs({x}) - {g})"
        inner = f"CASE WHEN {r} < {gamma} THEN {one} - power({p}, {g}) + ({one} - {p}) * power({p}, {g} - {half}) * {r} ELSE {one} - power({p}, {g} + {half}) + ({one} - {p}) * power({p}, {g} + {half}) * ({r} - {gamma}) END"
        return f"CASE WHEN {x} >= {d.num(0)} THEN {half} + {half} * ({inner}) ELSE {half} * ({one} - ({inner})) END"

    def mass(cdf) -> str:
        low, high = f"(s - {d.num(500.5)})", f"(s - {d.num(499.5)})"
        return f"(CASE WHEN s = 999 THEN {one} ELSE {cdf(high)} END) - (CASE WHEN s = 0 THEN {d.num(0)} ELSE {cdf(low)} END)"

    eps = f"SELECT event_type, {d.num(0.001)} * count(*) / {d.num(100)} + {d.num(0.01)} AS eps FROM {{events}} GROUP BY event_type"
    parts = []
    for law, w in (("exp", f"exp(-eps * abs(s - {d.num(500)}) / {d.num(2)})"), ("blap", mass(laplace)), ("stair", mass(staircase))):
        parts.append(f"SELECT event_type, '{law}' AS mechanism, round(sum(w * abs(s - {d.num(500)})) / sum(w), 5) AS e_abs, round(sum(w * s * s) / sum(w) - power(sum(w * s) / sum(w), {d.num(2)}), 3) AS var FROM (SELECT event_type, s, {w} AS w FROM ({eps}) e CROSS JOIN ({grid}) g) x GROUP BY event_type")
    return " UNION ALL ".join(parts)


portable("bud14_moments", moments, "events")


@query("bud15_grid_check", f"{A} SELECT template, config, b_setting, eps, count(*) AS roots, round(abs(sum(eps_root) - any_value(budget)), 6) AS gap, sum(n)::BIGINT AS n FROM allocs {COUNTED} WHERE config <> 'all' GROUP BY ALL")
def bud15(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = counted(spark, sf_dir, allocations(spark).where("config <> 'all'"))
    return rounded(a.groupBy("template", "config", "b_setting", "eps").agg(F.count(F.lit(1)).alias("roots"), F.abs(F.sum("eps_root") - F.first("budget")).alias("gap"), F.sum("n").alias("n")), 6)


@query("bud16_most_budgeted", f"{A} SELECT template, b_setting, eps, max_by(root, (round(eps_root, 9), root)) AS root, sum(n)::BIGINT AS n FROM allocs {COUNTED} WHERE config = 'opt' GROUP BY ALL")
def bud16(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = counted(spark, sf_dir, allocations(spark).where("config = 'opt'"))
    return a.groupBy("template", "b_setting", "eps").agg(F.max_by("root", F.struct(F.round("eps_root", 9), "root")).alias("root"), F.sum("n").alias("n"))


@query("bud17_mean_position", f"{P} SELECT template, root, round((avg(value) - any_value(lo)) / (any_value(hi) - any_value(lo)) * 999, 4) AS t FROM patients JOIN roots USING (template, root) GROUP BY 1, 2")
def bud17(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir).join(F.broadcast(sensitivities(spark)), ["template", "root"])
    return rounded(p.groupBy("template", "root").agg(((F.avg("value") - F.first("lo")) / (F.first("hi") - F.first("lo")) * 999).alias("t")))


@query("bud18_ledger", "SELECT event_id, user_id, round(sum(0.1) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4)::DOUBLE AS spent, round(sum(0.1) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) <= 5 AS allowed FROM events")
def bud18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("eps", F.lit(0.1))
    return B.ledger(e, limit=5.0).select("event_id", "user_id", F.round("spent", 4).alias("spent"), "allowed")


# Releases -----------------------------------------------------------------------------------------------------------

EPS3 = {"l_extendedprice": 0.3, "l_discount": 0.3, "l_tax": 0.3}


def charge_noise(d: Dialect) -> str:
    lo, hi = d.num(0), d.num(115000)
    return N.exponential(d, N.grid_position(d, N.clip("charge", lo, hi), lo, hi), d.num(0.1), d.uniform("'veil'", "'charge'", *LINE_KEYS))


@query("rel2_target_space", f"SELECT {LINE}, {charge_noise(D)} AS idx FROM ({layered_sql('lineitem', PRICING)})")
def rel2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_derived(table(spark, sf_dir, "lineitem"), PRICING).select(*LINE_KEYS, F.expr(charge_noise(SPARK)).alias("idx"))


EVEN3 = {r: 0.1 for r in PRICING.roots}
for _name, _mechanism, _eps in (("rel3_root_space", "exp", EVEN3), ("rel3_root_space_blap", "blap", EVEN3), ("rel3_root_space_stair", "stair", EVEN3), ("rel4_roots", "exp", EPS3), ("rel4_roots_blap", "blap", EPS3), ("rel4_roots_stair", "stair", EPS3)):

    def _released(spark: SparkSession, sf_dir: str, mechanism: str = _mechanism, eps: dict = _eps) -> DataFrame:
        r = R.released_columns(table(spark, sf_dir, "lineitem"), PRICING, eps, mechanism, LINE_KEYS)
        return r.select(*LINE_KEYS, F.round("r_l_extendedprice", 3).alias("price"), F.round("r_charge", 2).alias("charge"))

    query(_name, f"SELECT {LINE}, round(r_l_extendedprice, 3) AS price, round(r_charge, 2) AS charge FROM ({R.released_columns_sql('lineitem', PRICING, _eps, _mechanism, LINE_KEYS)})")(_released)


def pricing_budgets(spark: SparkSession, sf_dir: str, eps: float, mechanism: str, weighted: bool) -> DataFrame:
    """One row with eps_<root>: the exact allocation under a law of (k + 1) eps at the mean line, rounded to 5 digits."""
    means = table(spark, sf_dir, "lineitem").agg(*[F.round(F.avg(r), 6).alias(r) for r in PRICING.roots]).first().asDict()
    if None in means.values():  # no line to release
        return spark.createDataFrame([], ", ".join(f"eps_{r} double" for r in PRICING.roots))
    budget = eps * (len(PRICING.roots) + 1)
    rows = worked_out(spark, at_means_sql(SPARK, PRICING, means)).withColumns({"eps": F.lit(eps), "budget": F.lit(budget)})
    return L.exact(rows, mechanism, weighted).agg(*[F.round(F.max(F.when(F.col("root") == r, F.col("eps_root"))), 5).alias(f"eps_{r}") for r in PRICING.roots])


def pricing_budgets_sql(eps: float, mechanism: str, weighted: bool) -> str:
    """CTEs that end in budgeted, the lines with their roots' budgets; the derivatives written out: (1 - d)(1 + t), -p (1 + t), p (1 - d)."""
    h = {"l_extendedprice": "(1 - l_discount) * (1 + l_tax)", "l_discount": "-l_extendedprice * (1 + l_tax)", "l_tax": "l_extendedprice * (1 - l_discount)"}
    rows = " UNION ALL ".join(
        f"SELECT 'PRICING' AS template, '{r}' AS root, {D.num(lo)} AS lo, {D.num(hi)} AS hi, {h[r]} AS h, round(({r} - {D.num(lo)}) / ({D.num(hi)} - {D.num(lo)}) * 999, 4) AS t, {D.num(eps)} AS eps, {D.num(eps * (len(h) + 1))} AS budget FROM mean_line"
        for r, (lo, hi) in ((r, PRICING.domains[r]) for r in PRICING.roots)
    )
    picks = ", ".join(f"round(max(CASE WHEN root = '{r}' THEN eps_root END), 5) AS eps_{r}" for r in PRICING.roots)
    means = ", ".join(f"round(avg({r}), 6) AS {r}" for r in PRICING.roots)
    return f"WITH mean_line AS MATERIALIZED (SELECT {means} FROM lineitem), own AS MATERIALIZED ({rows}), {exact_sql('own', mechanism, weighted)}, budgeted AS (SELECT * FROM lineitem CROSS JOIN (SELECT {picks} FROM best))"


BUDGETED = {r: f"eps_{r}" for r in PRICING.roots}
for _name, _mechanism, _weighted in (("rel5_optimised", "exp", False), ("rel5_optimised_blap", "blap", False), ("rel5_optimised_stair", "stair", False), ("rel6_weighted", "exp", True), ("rel6_weighted_blap", "blap", True), ("rel6_weighted_stair", "stair", True)):

    def _optimised(spark: SparkSession, sf_dir: str, mechanism: str = _mechanism, weighted: bool = _weighted) -> DataFrame:
        """The table's own allocation, broadcast as one row, and a release at it."""
        lines = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(pricing_budgets(spark, sf_dir, 0.1, mechanism, weighted)))
        r = R.released_columns(lines, PRICING, BUDGETED, mechanism, LINE_KEYS)
        return r.select(*LINE_KEYS, F.round("r_l_extendedprice", 3).alias("price"), F.round("r_charge", 2).alias("charge"))

    query(_name, f"{pricing_budgets_sql(0.1, _mechanism, _weighted)} SELECT {LINE}, round(r_l_extendedprice, 3) AS price, round(r_charge, 2) AS charge FROM ({R.released_columns_sql('budgeted', PRICING, BUDGETED, _mechanism, LINE_KEYS)})")(_optimised)


@query("rel7_closed_form", f"{A}, cube AS ({clamp_sql()}), o0 AS (SELECT p.patient_id, p.value, c.* FROM patients p JOIN cube c USING (template, root) WHERE b_setting = '3k+1' AND eps = 0.1), o1 AS (SELECT *, {R.release_sql(D, 'exp', ('template', 'root', 'patient_id'))[0]} AS idx FROM o0) SELECT template, root, sum(idx)::BIGINT AS total FROM o1 GROUP BY ALL")
def rel7(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.cube_root(allocations(spark).where("config = 'roots' AND b_setting = '3k+1' AND eps = 0.1").drop("eps_root", "config"))
    o = R.release(patients(spark, sf_dir).join(F.broadcast(a), ["template", "root"]), "exp", paired=True)
    return o.groupBy("template", "root").agg(F.sum("idx").alias("total"))


def continuous(d: Dialect) -> str:
    """A value-space release with Laplace noise of scale 1 / eps_root."""
    return N.truncated_laplace(d, "value", "eps_root", "lo", "hi", d.uniform("'veil'", "'continuous'", "template", "root", "patient_id"))


@query("rel7_continuous", f"{A}, cube AS ({clamp_sql(False)}) SELECT template, root, patient_id, round({continuous(D)}, 4) AS released FROM patients p JOIN cube c USING (template, root) WHERE b_setting = '3k+1' AND eps = 0.1")
def rel7c(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.cube_root(allocations(spark).where("config = 'roots' AND b_setting = '3k+1' AND eps = 0.1").drop("eps_root", "config"), widths=False)
    o = patients(spark, sf_dir).join(F.broadcast(a), ["template", "root"])
    return o.select("template", "root", "patient_id", F.round(F.expr(continuous(SPARK)), 4).alias("released"))


def own_uniform(d: Dialect, tag: str) -> str:
    return d.uniform("'veil'", f"'{tag}'", "patient_id")


def noised(d: Dialect, x: str, eps: str, lo: float, hi: float, tag: str, u: str | None = None) -> str:
    """A node's value after a draw of its own; u: the column that has own_uniform of the tag."""
    l, h = d.num(lo), d.num(hi)
    t = N.grid_position(d, N.clip(x, l, h), l, h)
    return N.value_of(d, "(" + N.exponential(d, t, eps, u or own_uniform(d, tag)) + ")", l, h)


def reset_chain(d: Dialect, t: Template, base: str, bank: bool, eps: float = 0.1, threshold: float = 0.1) -> str:
    """Layers of SQL: a derived node keeps what follows from released parents while its error is small, else the true
    value is noised anew: at eps / m (m < 1) or eps, or with all that the bank has gathered. It looks at the truth, so
    the choice itself isn't private: for comparison only."""
    q = d.quote
    sql = f"SELECT *, {d.num(0)} AS bank FROM ({base})"
    for r in t.roots:
        sql = f"SELECT *, {noised(d, q(r), d.num(eps), *t.domains[r], r)} AS {q('s_' + r)} FROM ({sql})"
    names, truth = {r: q("s_" + r) for r in t.roots}, {r: q(r) for r in t.roots}
    for node, expression, partials in t.nodes:
        if partials is None:
            continue
        m = max(LIPSCHITZ[node][0], 1e-6)
        sql = f"SELECT *, {bind(d, expression, truth)} AS {q(node)}, {bind(d, expression, names)} AS {q('f_' + node)} FROM ({sql})"
        error = f"abs({q('f_' + node)} - {q(node)}) / CASE WHEN abs({q(node)}) < {d.num(1e-10)} THEN {d.num(1)} ELSE abs({q(node)}) END"
        own = f"(bank + {d.num(eps)})" if bank else d.num(eps / m if m < 1 else eps)
        sql = f"SELECT *, {error} > {d.num(threshold)} AS {q('x_' + node)}, {own} AS {q('e_' + node)} FROM ({sql})"
        # Columns of their own: an expression is generated once for each place that it stands in.
        sql = f"SELECT *, {own_uniform(d, node)} AS {q('u_' + node)}, least({q('e_' + node)}, {d.num(20)}) AS {q('c_' + node)} FROM ({sql})"
        again = noised(d, q(node), q("c_" + node), *t.domains[node], node, q("u_" + node))
        left = f"CASE WHEN {q('x_' + node)} THEN {d.num(0)} ELSE bank + {d.num(eps)} END" if bank else d.num(0)
        keep = "* EXCEPT (bank)" if d.spark else "* EXCLUDE (bank)"
        sql = f"SELECT {keep}, CASE WHEN {q('x_' + node)} THEN {again} ELSE {q('f_' + node)} END AS {q('s_' + node)}, {left} AS bank FROM ({sql})"
        names[node], truth[node] = q("s_" + node), q(node)
    return sql


for _name, _bank in (("rel8_threshold_reset", False), ("rel9_budget_bank", True)):

    def _reset(spark: SparkSession, sf_dir: str, bank: bool = _bank) -> DataFrame:
        w = wide(patients(spark, sf_dir), "VASCULAR")
        out = spark.sql(reset_chain(SPARK, VASCULAR, "SELECT * FROM {w}", bank), w=w)
        return out.select("patient_id", F.round("s_ppi", 5).alias("ppi"), F.col("x_ppi").alias("reset"), F.round("e_ppi", 4).alias("budget"), F.round("bank", 4).alias("bank"))

    query(_name, f'{P}, {wide_sql("VASCULAR")} SELECT patient_id, round(s_ppi, 5) AS ppi, x_ppi AS reset, round(e_ppi, 4) AS budget, round(bank, 4) AS bank FROM ({reset_chain(D, VASCULAR, "SELECT * FROM w", _bank)})')(_reset)


for _name, _bank in (("rel8_every_template", False), ("rel9_every_template", True)):

    def _resets(spark: SparkSession, sf_dir: str, bank: bool = _bank) -> DataFrame:
        """The target of every template under the policy: what is released, whether it was noised anew, at what budget, and what the bank has left."""
        out = None
        for t in (t for t in templates().values() if t.name in DOMAINS):
            one = spark.sql(reset_chain(SPARK, t, "SELECT * FROM {w}", bank), w=swept_entities(spark, sf_dir, t))
            x = t.target
            one = one.select(F.lit(t.name).alias("template"), "patient_id", F.round(f"s_{x}", 5).alias("released"), F.col(f"x_{x}").alias("reset"), F.round(f"e_{x}", 4).alias("budget"), F.round("bank", 4).alias("bank"))
            out = one if out is None else out.unionAll(one)
        return out

    _parts = [f"SELECT '{t.name}' AS template, patient_id, round(\"s_{t.target}\", 5) AS released, \"x_{t.target}\" AS reset, round(\"e_{t.target}\", 4) AS budget, round(bank, 4) AS bank FROM ({reset_chain(D, t, f'SELECT * FROM w_{t.name}', _bank)})" for t in templates().values() if t.name in DOMAINS]
    query(_name, f"{P}, {', '.join(wide_sql(t, f'w_{t}') for t in templates() if t in DOMAINS)} {' UNION ALL '.join(_parts)}")(_resets)


def ordered_chain(d: Dialect, t: Template, base: str, roots_only: bool, eps: float = 0.1) -> str:
    """Down the graph: a node follows from its released parents, and is noised at its budget where that reaches eps."""
    q = d.quote
    budgets = {r: (d.num(eps), "") for r in t.roots} if roots_only else B.inherited(t, LIPSCHITZ, d.num(eps), d)
    sql, names = f"SELECT * FROM {base}", {}
    for node, expression, partials in [(r, None, {}) for r in t.roots] + [n for n in t.nodes if n[2] is not None]:
        value = q(node) if expression is None else bind(d, expression, names)
        budget = budgets[node][0] if node in budgets else d.num(0)
        own = noised(d, q("f_" + node), q("b_" + node), *t.domains[node], f"ordered {node}")
        sql = f"SELECT *, {value} AS {q('f_' + node)}, {budget} AS {q('b_' + node)} FROM ({sql})"
        sql = f"SELECT *, CASE WHEN {q('b_' + node)} >= {d.num(eps)} THEN {own} ELSE {q('f_' + node)} END AS {q('s_' + node)} FROM ({sql})"
        names[node] = q("s_" + node)
    return sql


for _name, _roots_only in (("rel10_budget_ordered", False), ("rel10_roots_only", True)):

    def _ordered(spark: SparkSession, sf_dir: str, roots_only: bool = _roots_only) -> DataFrame:
        parts = []
        p = patients(spark, sf_dir)
        for t in (t for t in templates().values() if t.name in DOMAINS):
            out = spark.sql(ordered_chain(SPARK, t, "{w}", roots_only), w=wide(p, t.name))
            parts.append(out.select(F.lit(t.name).alias("template"), "patient_id", F.round(f"`s_{t.target}`", 5).alias("released"), F.round(f"`b_{t.target}`", 6).alias("budget")))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionAll(x)
        return out

    _parts = [(t.name, t.target, ordered_chain(D, t, f"w_{t.name}", _roots_only)) for t in templates().values() if t.name in DOMAINS]
    query(_name, f"{P}, {', '.join(wide_sql(n, f'w_{n}') for n, _, _ in _parts)} " + " UNION ALL ".join(f"SELECT '{n}' AS template, patient_id, round(\"s_{x}\", 5) AS released, round(\"b_{x}\", 6) AS budget FROM ({sql})" for n, x, sql in _parts))(_ordered)


@query("rel11_cached", f"WITH {observations_sql()} SELECT template, root, patient_id, q, round(released, 4) AS released FROM obs CROSS JOIN (VALUES (0), (1), (2)) x(q) WHERE config = 'opt' AND b_setting = 'k+1' AND eps = 1.0")
def rel11(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).where("config = 'opt' AND b_setting = 'k+1' AND eps = 1.0")
    return rounded(o.withColumn("q", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("template", "root", "patient_id", "q", "released"))


ASKED = "config = 'opt' AND b_setting = 'k+1' AND eps = 0.1"
NAMES12 = [t for t in templates() if t in DOMAINS]
KINDS = ("fetch", "target", "classify", "sanitize")


def sanitized_price(d: Dialect) -> str:
    lo, hi = d.num(0), d.num(600000)
    t = N.grid_position(d, N.clip("o_totalprice", lo, hi), lo, hi)
    return N.value_of(d, f"({N.exponential(d, t, d.num(0.1), d.uniform(chr(39) + 'veil' + chr(39), chr(39) + 'sanitize' + chr(39), 'o_orderkey'))})", lo, hi)


@query(
    "rel12_lookup",
    f"""WITH {results_sql(where=ASKED)}, {observations_sql().removeprefix(f'{patients_sql()}, {allocations_sql()},')},
    rq AS (SELECT *, ['{"', '".join(KINDS)}'][o_orderkey % 4 + 1] AS request, ['{"', '".join(NAMES12)}'][(o_orderkey // 4) % {len(NAMES12)} + 1] AS template, o_custkey AS patient_id FROM orders),
    first AS (SELECT template, min(root) AS root FROM roots GROUP BY 1)
    SELECT o_orderkey, request, round(CASE request WHEN 'fetch' THEN f.released WHEN 'target' THEN r.target WHEN 'classify' THEN r.target_class ELSE {sanitized_price(D)} END, 4) AS answer
    FROM rq JOIN first USING (template) LEFT JOIN (SELECT * FROM obs WHERE {ASKED}) f USING (template, root, patient_id) LEFT JOIN results r USING (template, patient_id)""",
)
def rel12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a cached release: fetch a root, compute the target, classify it, or noise a value that is at hand."""
    o = observations(spark, sf_dir).where(ASKED).select("template", "root", "patient_id", "released")
    first = spark.createDataFrame([(t, min(templates()[t].roots)) for t in NAMES12], "template string, root string")
    named = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("patient_id"), named(KINDS, k % 4).alias("request"), named(NAMES12, F.floor(k / 4) % len(NAMES12)).alias("template"))
    asked = asked.join(F.broadcast(first), "template").join(o, ["template", "root", "patient_id"], "left")
    r = results(spark, sf_dir, where=ASKED).select("template", "patient_id", "target", "target_class")
    request = F.col("request")
    answer = F.when(request == "fetch", F.col("released")).when(request == "target", F.col("target")).when(request == "classify", F.col("target_class").cast("double")).otherwise(F.expr(sanitized_price(SPARK)))
    return asked.join(r, ["template", "patient_id"], "left").select("o_orderkey", "request", F.round(answer, 4).alias("answer"))


@query("rel13_report", f"{A} SELECT template, b_setting, eps, string_agg(root || '=' || round(eps_root, 3)::DECIMAL(12, 3)::VARCHAR, ',' ORDER BY root) AS allocation, round(sum(eps_root), 4) AS total, sum(n)::BIGINT AS n FROM allocs {COUNTED} WHERE config = 'opt' GROUP BY ALL")
def rel13(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = counted(spark, sf_dir, allocations(spark).where("config = 'opt'"))
    pairs = F.array_sort(F.collect_list(F.struct("root", F.concat("root", F.lit("="), F.round("eps_root", 3).cast("decimal(12,3)").cast("string")).alias("s"))))
    return rounded(a.groupBy("template", "b_setting", "eps").agg(F.array_join(F.transform(pairs, lambda x: x["s"]), ",").alias("allocation"), F.sum("eps_root").alias("total"), F.sum("n").alias("n")))
