"""Properties of mechanisms, allocations, releases and audits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.functions import mechanisms as N
from veilgrid.functions.dialect import SPARK
from veilgrid.operators import audit as A
from veilgrid.operators import allocation as L
from veilgrid.operators import budget as B
from veilgrid.operators import metrics as M
from veilgrid.operators import release as R
from veilgrid.operators import text as X
from veilgrid.operators.derive import class_sql, sensitivity_columns, with_derived
from veilgrid.plans.catalog import PRICING, Template, templates


def draws(spark, mechanism, eps, t, n=20_000, m=50):
    index = N.noise_index(SPARK, mechanism, SPARK.num(t), SPARK.num(eps), "'test'", "id", m=m)
    return spark.range(n).select(F.expr(index).alias("s")).toPandas()["s"].to_numpy()


@pytest.mark.parametrize("eps", [0.2, 1.0])
@pytest.mark.parametrize("t", [0.0, 10.4, 49.0])
def test_exponential_law(spark, eps, t):
    s = draws(spark, "exp", eps, t)
    p = np.exp(-eps / 2 * np.abs(np.arange(50) - t))
    p /= p.sum()
    seen = np.bincount(s, minlength=50) / len(s)
    assert np.abs(seen - p).max() < 4 * math.sqrt(0.25 / len(s))
    assert abs((s * 1.0).mean() - p @ np.arange(50)) < 0.3


@pytest.mark.parametrize("mechanism", ["exp", "blap", "stair"])
def test_in_domain_and_less_noise_with_more_budget(spark, mechanism):
    low, high = draws(spark, mechanism, 0.05, 25.0), draws(spark, mechanism, 5.0, 25.0)
    assert low.min() >= 0 and low.max() <= 49
    assert np.abs(high - 25).mean() < 1 < np.abs(low - 25).mean()


def test_noise_is_a_function_of_the_key(spark):
    rows = spark.range(500).select(F.col("id").alias("patient_id"), F.lit("T").alias("template"), F.lit("r").alias("root"), (F.col("id") / 5).alias("value"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"), F.lit(0.5).alias("eps_root"))
    one = R.release(rows, "exp")
    other = R.release(rows.repartition(7), "exp")
    assert one.join(other, "patient_id").where(one["idx"] != other["idx"]).count() == 0
    cached = A.repeated(rows, "exp", 4, True).groupBy("patient_id").agg(F.count_distinct("idx").alias("n"))
    assert cached.where("n > 1").count() == 0
    fresh = A.repeated(rows, "exp", 4, False).groupBy("patient_id").agg(F.count("idx").alias("n"), F.count_distinct("idx").alias("d"))
    assert fresh.where("n <> 5").count() == 0 and fresh.where("d > 1").count() > 400


@pytest.mark.parametrize("row, target, kind", [("HOMA", 2.0, 1), ("FIB4", 1.4732, 1), ("ANEMIA", 33.3333, 1)])
def test_known_rows(spark, row, target, kind):
    values = {"HOMA": {"glu": 100.0, "ins": 8.1}, "FIB4": {"age": 66.0, "ast": 12.0, "plt": 170.0, "alt": 10.0}, "ANEMIA": {"hb": 14.0, "hct": 42.0, "rbc": 5.0}}[row]
    t = templates()[row]
    df = with_derived(spark.createDataFrame([tuple(values.values())], list(values)), t)
    r = df.select(F.col(t.target).alias("v"), F.expr(class_sql(SPARK, t, t.target)).alias("c")).first()
    assert r.v == pytest.approx(target, abs=1e-3) and r.c == kind


@pytest.mark.parametrize("name", [*templates(), "PRICING"])
def test_partials_are_differences(spark, name):
    t = PRICING if name == "PRICING" else templates()[name]
    middle = {r: t.domains[r][0] * 0.6 + t.domains[r][1] * 0.4 for r in t.roots}
    rows = [middle] + [{**middle, r: middle[r] + s * 1e-5 * max(1, abs(middle[r]))} for r in t.roots for s in (1, -1)]
    df = with_derived(spark.createDataFrame([tuple(x[r] for r in t.roots) for x in rows], t.roots), t)
    out = df.select(F.col(f"`{t.target}`").alias("v"), *[F.expr(s).cast("double").alias(f"h_{r}") for r, s in sensitivity_columns(SPARK, t)]).collect()
    for k, r in enumerate(t.roots):
        step = 2e-5 * max(1, abs(middle[r]))
        assert out[0][f"h_{r}"] == pytest.approx((out[1 + 2 * k].v - out[2 + 2 * k].v) / step, rel=1e-4, abs=1e-8)


def test_undefined_is_null_or_raises(spark):
    t = Template("Q", ["a", "b"], {"a": (0, 1), "b": (0, 1)}, [("q", "a / b", {"a": "1 / b", "b": "-a / (b * b)"})], "q")
    df = spark.createDataFrame([(1.0, 0.0), (None, 1.0), (1.0, 2.0)], "a double, b double")
    assert [r.q for r in with_derived(df, t).collect()] == [None, None, 0.5]
    with pytest.raises(Exception, match="finite"):
        with_derived(df, t, non_finite="raise").collect()


def expected_error(mechanism, eps, t, m=1000, variance=False):
    """E|S - t| or Var(S), from the law's probabilities over the whole grid."""
    s = np.arange(m)
    if mechanism == "exp":
        p = np.exp(-eps * np.abs(s - t) / 2)
        p /= p.sum()
    else:

        def below(x):
            q = np.exp(-eps)
            gamma = np.sqrt(q) / (1 + np.sqrt(q))
            g = np.floor(np.abs(x))
            r = np.abs(x) - g
            stair = np.where(r < gamma, 1 - q**g + (1 - q) * q ** (g - 0.5) * r, 1 - q ** (g + 0.5) + (1 - q) * q ** (g + 0.5) * (r - gamma))
            beyond = stair if mechanism == "stair" else 1 - np.exp(-eps * np.abs(x))
            return 0.5 + 0.5 * np.sign(x) * beyond

        c = below(np.arange(m + 1) - t - 0.5)
        c[0], c[-1] = 0, 1
        p = np.diff(c)
    return p @ (s**2.0) - (p @ s) ** 2 if variance else p @ np.abs(s - t)


ROOTS = [("a", 2.0, 0.0, 10.0, 499.5), ("b", -0.3, 0.0, 300.0, 200.25), ("c", 0.0, 0.0, 1.0, 10.0), ("d", 5.0, 1.0, 2.0, 990.0)]


@pytest.mark.parametrize("mechanism,weighted,variance", [("exp", False, False), ("exp", True, False), ("exp", False, True), ("blap", False, False), ("blap", True, False), ("stair", False, False), ("stair", True, False)])
def test_exact_allocation(spark, mechanism, weighted, variance):
    """No move of budget from one root to another helps; all of it is spent; small budgets and roots without weight are dealt as stated."""
    rows = [("T", *r, e, m * e) for r in ROOTS for e in (0.0001, 0.01, 0.1, 1.0, 5.0) for m in (5.0, 13.0)]
    df = spark.createDataFrame(rows, "template string, root string, h double, lo double, hi double, t double, eps double, budget double")
    for (eps, budget), g in L.exact(df, mechanism, weighted, variance).toPandas().groupby(["eps", "budget"]):
        g = g.sort_values("root")
        width = (g.hi - g.lo).to_numpy()
        w = (g.h.abs() * width / 999).to_numpy() ** (2 if variance else 1)
        cost, x = width if weighted else np.ones(4), g.eps_root.to_numpy()
        spend = eps * width.sum() if weighted else budget
        assert (cost * x).sum() == pytest.approx(spend)
        if eps == 0.0001:
            assert x == pytest.approx(spend / cost.sum())
            continue
        assert x[2] == pytest.approx(1e-3)
        value = lambda y: sum(k * expected_error(mechanism, e, t, variance=variance) for k, e, t in zip(w, y, g.t, strict=True))  # noqa: E731, B023
        best = value(x)
        for i, k in ((0, 1), (1, 0), (1, 3), (3, 1), (0, 3), (3, 0)):
            y = x.copy()
            d = 0.05 * min(x[i] * cost[i], x[k] * cost[k])
            y[i] -= d / cost[i]
            y[k] += d / cost[k]
            if y[i] >= 1e-3:
                assert value(y) >= best * (1 - 1e-9)


def test_allocation_without_weights_is_even(spark):
    df = spark.createDataFrame([("T", r, 0.0, 0.0, 1.0, 5.0, 0.1, 0.6) for r in "ab"], "template string, root string, h double, lo double, hi double, t double, eps double, budget double")
    assert [r.eps_root for r in L.exact(df, "exp").collect()] == pytest.approx([0.3, 0.3])
    assert L.exact(df.limit(0), "exp").count() == 0
    with pytest.raises(ValueError, match="exponential law only"):
        L.exact(df, "blap", variance=True)


@pytest.mark.parametrize("mechanism,rate", [("exp", 0.5), ("blap", 1.0), ("stair", 1.0)])
def test_best_index_of_all_grid_points(spark, mechanism, rate):
    """Against the whole grid's scores: releases in the middle and at the ends, priors that are narrow, wide, far off or missing."""
    rng = np.random.default_rng(8)
    s, rows, want = np.arange(1000), [], {}
    for k in range(400):
        eps, centre = float(rng.choice([0.002, 0.01, 0.1, 0.5, 2.0])), int(rng.choice([rng.integers(0, 1000), rng.integers(0, 20), rng.integers(980, 1000)]))
        obs = np.clip(np.rint(centre + rng.laplace(0, 2 / eps, int(rng.integers(1, 18)))), 0, 999).astype(int)
        mean = float(rng.choice([centre, rng.uniform(0, 999)]))
        std = float(rng.choice([0.5, 5, 60, 300, 3000])) if rng.random() < 0.8 else None
        f = rate * eps
        score = -f * np.abs(s[:, None] - obs).sum(1) - len(obs) * np.log(np.exp(-f * np.abs(s[:, None] - s)).sum(1))
        want[k] = int((score - (0 if std is None else 0.5 * ((s - mean) / std) ** 2)).round(9).argmax())
        rows.append((k, obs.tolist(), eps, mean, std))
    rows += [(-1, [], 0.1, 5.0, 1.0), (-2, [3, 3, 900], 0.1, None, 0.0)]
    df = spark.createDataFrame(rows, "k int, obs array<int>, eps double, mean double, std double")
    assert {r.k: r.map_idx for r in A.with_best_index(df, mechanism).collect()} == want | {-1: 500, -2: 3}


def test_map_index(spark):
    obs = spark.createDataFrame([("T", 1, "r", i, 0.5, None, None) for i in (10, 12, 40)] + [("T", 2, "r", 700, 0.1, 100.0, 5.0)], "template string, patient_id long, root string, idx long, eps_root double, prior_mean double, prior_std double")
    got = {r.patient_id: r.map_idx for r in A.map_index(obs, "exp").collect()}
    assert got[1] == 12 and 90 <= got[2] <= 110


def test_bootstrap(spark):
    df = spark.range(4000).select(F.lit("a").alias("g"), F.col("id").alias("k"), (F.col("id") % 10 + 1).cast("double").alias("t"), (F.col("id") % 10 + 1 + F.col("id") % 3).cast("double").alias("v"), (F.col("id") % 4 == 0).alias("right"))
    sums = {"e": F.abs(F.col("v") - F.col("t")), "t": F.abs("t"), "right": F.col("right").cast("int")}
    statistics = {"wmape": lambda s: 100 * s["e"] / s["t"], "accuracy": lambda s: 100 * s["right"] / s["n"]}
    out = {r.name: r for r in M.bootstrap(df, "k", sums, statistics, ("g",), 400).collect()}
    assert out["wmape"].value == pytest.approx(100 * 3999 / 22000, rel=1e-3) and out["accuracy"].value == pytest.approx(25.0)
    # The standard errors of a share and of a ratio of sums.
    assert out["accuracy"].se == pytest.approx(100 * math.sqrt(0.25 * 0.75 / 4000), rel=0.15)
    assert out["wmape"].se == pytest.approx(df.agg(M.wmape_se(F.col("t"), F.col("v"))).first()[0], rel=0.15)


@pytest.mark.parametrize("eps", [0.3, 1.0])
@pytest.mark.parametrize("mechanism", ["blap", "stair"])
def test_law_of_rounded_noise(spark, mechanism, eps):
    """Frequencies against the distribution function, written independently."""
    s = draws(spark, mechanism, eps, 25.0)
    x = np.linspace(-60, 60, 1_200_001)
    if mechanism == "blap":
        density = np.exp(-eps * np.abs(x))
    else:
        gamma = 1 / (1 + math.exp(eps / 2))
        whole = np.floor(np.abs(x))
        density = np.exp(-eps * (whole + (np.abs(x) - whole >= gamma)))
    mass = np.histogram(np.clip(x, -25.49, 24.49), bins=np.arange(51) - 25.5, weights=density)[0]
    seen = np.bincount(s, minlength=50) / len(s)
    assert np.abs(seen - mass / mass.sum()).max() < 4 * math.sqrt(0.25 / len(s))


def test_releases_at_other_budgets_are_independent(spark):
    rows = spark.range(4000).select(F.col("id").alias("patient_id"), F.lit("T").alias("template"), F.lit("r").alias("root"), F.lit(50.0).alias("value"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"))
    a, b = (R.release(rows.withColumn("eps_root", F.lit(e)), "exp").select("patient_id", F.col("idx").alias(n)) for e, n in ((0.01, "a"), (0.012, "b")))
    assert abs(a.join(b, "patient_id").agg(F.corr("a", "b")).first()[0]) < 0.08
    a, b = (R.release(rows.withColumn("eps_root", F.lit(e)), "exp", paired=True).select("patient_id", F.col("idx").alias(n)) for e, n in ((0.01, "a"), (0.012, "b")))
    assert a.join(b, "patient_id").agg(F.corr("a", "b")).first()[0] > 0.9


def test_inherited_budgets(spark):
    t = Template("I", ["a", "b"], {"a": (0, 1), "b": (0, 1)}, [("c", "a + b", {"a": "1", "b": "1"}), ("d", "c * 2", {"c": "2"}), ("e", "d * 1", {"d": "1"}), ("f", "a * 0", {"a": "0"})], "e")
    bounds = {"c": (2.0, 2.0), "d": (0.5, 0.5), "e": (0.4, 0.4), "f": (0.0, 0.0)}
    sql = B.inherited(t, bounds, "eps")
    row = spark.createDataFrame([(0.2,)], "eps double").select(*[F.expr(b).alias(n) for n, (b, _) in sql.items()]).first()
    # c: eps / 2; d: parents' 0.1 / 0.5 = eps; e: 0.4 / 0.4 > eps and eps / 0.4 > eps, so what is missing in 1 / eps^2.
    assert (row.a, row.c, row.d, row.f) == pytest.approx((0.2, 0.1, 0.2, 0.2)) and row.e == pytest.approx(math.sqrt(1 / (1 / 0.2**2 - 1 / 0.5**2)))


def test_joint_prior(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    rows = spark.createDataFrame([("T", k, r, float(x[k, i])) for k in range(50) for i, r in enumerate("abc")], "template string, patient_id long, root string, value double")
    got = {r.patient_id: r.lp for r in A.joint_log_prior(rows, A.population_statistics(rows)).collect()}
    d = x - x.mean(axis=0)
    want = -0.5 * np.einsum("ki,ij,kj->k", d, np.linalg.inv(np.cov(x.T, bias=True) + 1e-6 * np.eye(3)), d)
    assert [got[k] for k in range(50)] == pytest.approx(want.tolist())


def test_population_file(spark, tmp_path):
    from veilgrid.sources import tables as S

    stats = spark.createDataFrame([("T", a, b, 9, m, 1.0, c) for a, m in (("x", 1.0), ("y", 2.0)) for b, c in (("x", 2.0 if a == "x" else 0.5), ("y", 0.5 if a == "x" else 3.0))], "template string, root string, other string, n long, mean double, std double, cov double")
    S.write_population(stats, str(tmp_path / "p"))
    back = S.read_population(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.select(stats.columns).collect())) == sorted(map(tuple, stats.collect()))
    roots, cov, inv = S.inverse_covariances(back)["T"]
    assert roots == ["x", "y"] and np.allclose(cov @ inv, np.eye(2)) and cov[0, 0] == pytest.approx(2.000001)


def test_unobserved_root_is_put_amid_the_grid(spark):
    rows = spark.createDataFrame([("T", 1, "r", None, None, None, None), ("T", 2, "r", 3, 0.5, None, None)], "template string, patient_id long, root string, idx long, eps_root double, prior_mean double, prior_std double")
    assert {r.patient_id: r.map_idx for r in A.map_index(rows, "exp").collect()} == {1: 500, 2: 3}


def test_text_edges(spark):
    df = spark.createDataFrame([(1, "a@b.co and a@b.co"), (2, None), (3, "")], "doc_id long, text string")
    pairs = X.mapping(df, ["email"])
    assert pairs.count() == 1
    hidden = X.pseudonymise(df, pairs)
    assert hidden.where("text LIKE '%@%'").count() == 0
    assert X.restore(hidden, pairs).orderBy("doc_id").collect() == df.orderBy("doc_id").collect()
    accents = spark.createDataFrame([(1, "e\u0301 a\u00f1o")], "doc_id long, text string")
    names = spark.createDataFrame([(1, "name", "\u00e9", "<1>"), (1, "name", "an\u0303o", "<2>")], "doc_id long, kind string, entity string, token string")
    assert X.pseudonymise(accents, names).first().text == "<1> <2>"


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "template string, root string, patient_id long, value double, lo double, hi double, eps_root double")
    assert R.release(rows, "exp").count() == 0
    assert R.targets(rows, ("patient_id",)).count() == 0


def test_calls_are_matched_in_two_passes(spark):
    """Pending requests first, in order; what is left goes to the first request of the value, answered or not."""
    requests = spark.createDataFrame([(1, "alt", 16.0, True, 1), (1, "ast", 16.0, True, 2), (1, "age", 50.0, False, 0), (2, "alt", 16.0, False, 1)], "session int, root string, value double, pending boolean, ord int")
    calls = spark.createDataFrame([(1, 16.0, 15.5, 1), (1, 16.0, 16.5, 2), (1, 16.0, 17.0, 3), (1, 50.0, 49.0, 4), (1, 7.0, 7.5, 5), (2, 16.0, 15.0, 1)], "session int, value double, released double, ord int")
    got = {(r.session, r.ord): r.root for r in A.match_calls(requests, calls).collect()}
    assert got == {(1, 1): "alt", (1, 2): "ast", (1, 3): "alt", (1, 4): "age", (1, 5): None, (2, 1): "alt"}


def test_stated_errors(spark):
    plans = spark.createDataFrame([(1, 5)], "session int, t int")
    assert [r.root for r in A.request_plan(plans, ["glu", "ins"]).orderBy("turn", "root").collect()] == ["glu", "ins", "glu", "ins", "glu", "ins"]
    with pytest.raises(Exception, match="two turns"):
        A.request_plan(spark.createDataFrame([(1, 1)], "session int, t int"), ["glu"]).collect()
    with pytest.raises(Exception, match="needs a release"):
        spark.createDataFrame([(1, None)], "root int, idx long").groupBy("root").agg(A.lower_median().alias("idx")).collect()


def test_bootstrap_weighs_every_entity(spark):
    """Resampled sums are those of a Poisson weight for each entity, not for a group of them, whatever number of groups a task holds."""
    df = spark.range(60).select((F.col("id") % 20).alias("k"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 1.5).alias("x"))
    b = df.crossJoin(spark.range(13).select(F.col("id").cast("int").alias("b")))
    weight = F.when(F.col("b") == 0, 1).otherwise(F.expr(M.poisson_weight(SPARK, M.digest_sql(SPARK, "k", f"(floor(b / {M.SHARED}) * {M.SHARED})"), "b")))
    want = {(r.g, r.b): (r.n, r.x) for r in b.withColumn("w", weight).groupBy("g", "b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("x")).collect()}
    found = M.resampled(df, "k", {"x": F.col("x")}, ("g",), 12).collect()
    assert {(r.g, r._vg_b): (r._vg_s_n, pytest.approx(r._vg_s_x)) for r in found} == want
    one = M.bootstrap(df, "k", {"x": F.col("x")}, {"mean": lambda s: s["x"] / s["n"]}, ("g",), 12, buckets=None).collect()
    values = [want["0", k][1] / want["0", k][0] for k in range(1, 13)]
    assert {r.g: r.se for r in one}["0"] == pytest.approx(np.std(values, ddof=1))


def test_sweep_draws_equal_sql(spark):
    """The draws of sweeps over arrays and those of the SQL expressions, ends of the grid included."""
    import numpy as np
    from pyspark.sql import functions as F

    from veilgrid.functions import draws
    from veilgrid.functions import mechanisms as N
    from veilgrid.functions.dialect import SPARK

    rng = np.random.default_rng(3)
    t = np.concatenate([rng.random(150) * 999, [0.0, 999.0, 500.0]])
    u = np.concatenate([rng.random(150), [0.0, 0.5, 0.75]])
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(t, u, strict=True))], "k int, t double, u double")
    for mechanism in ("exp", "blap", "stair"):
        for eps in (0.005, 0.1, 5.0):
            found = [r.s for r in rows.withColumn("s", F.expr(N.drawn(SPARK, mechanism, "t", SPARK.num(eps), "u"))).orderBy("k").collect()]
            assert draws.drawn(mechanism, t, eps, u).astype(int).tolist() == found
            value, budget, layers, index = N.steps(SPARK, mechanism, "t", SPARK.num(eps), "u")
            staged = rows
            for columns in (value | budget, *layers, {"s": index}):
                staged = staged.withColumns({c: F.expr(x) for c, x in columns.items()})
            assert [r.s for r in staged.orderBy("k").collect()] == found


def test_entities_are_dealt(spark, sf_dir):
    """One file of one row group isn't one task's work, and each sweep keeps a null value null."""
    from veilgrid.operators.release import swept
    from veilgrid.plans.catalog import templates
    from veilgrid.sources.tables import entities

    assert entities(spark, sf_dir).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame([(1, 100.0, 0.5, 10.0, 0.25), (2, None, 0.5, 10.0, 0.25)], "patient_id long, glu double, u_glu double, ins double, u_ins double")
    cells = spark.createDataFrame([("all", "k+1", 0.1, 0.1, 0.1)], "config string, b_setting string, eps double, eps_glu double, eps_ins double")
    found = {r.patient_id: r.target for r in swept({"HOMA": rows}, {"exp": {"HOMA": cells}}).collect()}
    assert found[1] is not None and found[2] is None and templates()["HOMA"].target == "homa"


def test_reconstruction_equals_grouped_releases(spark, sf_dir):
    """Releases drawn within a row are those that are exploded and grouped, and a customer that repeats counts once."""
    import tempfile

    from pyspark.sql import functions as F

    from veilgrid.operators.audit import lower_median
    from veilgrid.plans import q_report as Q

    folder = tempfile.mkdtemp(prefix="run-")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey BETWEEN 1 AND 20")
    c.unionAll(c).write.parquet(f"{folder}/customer.parquet")
    found = Q.root_errors(spark, folder, (1, 4), (4,), Q.AUDITED)
    assert found.where("config = 'all' AND q = 4").count() == 20 * 21
    for q in (1, 4):
        old = Q.repeats(spark, folder, q).groupBy(*Q.ROOT).agg(F.avg("released").alias("mean"), F.first("value").alias("v"), lower_median().alias("idx"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        both = old.join(found.where(f"config = 'all' AND q = {q}"), list(Q.ROOT))
        off = (F.abs(F.abs(F.col("mean") - F.col("v")) - F.col("naive")) > 1e-9) | (F.abs(F.abs(F.expr("lo + idx * (hi - lo) / 999") - F.col("v")) - F.col("map")) > 1e-9)
        assert both.count() == 20 * 21 and both.where(off).count() == 0


def test_one_page_reads_its_cells_once(spark, sf_dir):
    """The page reads tables of the cells and the compliance, not the customers once per line."""
    from veilgrid.plans import q_report as Q

    assert not any("customer" in f for f in Q.rpt17(spark, sf_dir).inputFiles())
