"""Range joins, classes, many patterns, resumed sweeps and ledgers in event order, against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from veilgrid.operators import patterns as X
from veilgrid.operators import ranges as G
from veilgrid.sources import sweeps
from veilgrid.sources import tables as S
from veilgrid.streaming import releases as ST


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_equals_comparison_of_all(spark):
    r = random.Random(3)
    points = [r.choice([-1e6, -3.0, 0.0, 0.5, 1.0, 2.0, 1e9]) if r.random() < 0.4 else r.uniform(-50, 50) for _ in range(150)]
    values = [(i, r.choice(["a", "b", None]), x) for i, x in enumerate(points + [None, math.nan, math.inf, -math.inf])]
    spans = []
    for j in range(120):
        a = r.choice([None, -3.0, 0.0, 1.0, r.uniform(-60, 60)])
        b = r.choice([None, 0.0, 1.0, 2.0, (a or 0.0) + 10.0 ** r.randint(-6, 6)])
        spans.append((j, r.choice(["a", "b", None]), a, b, r.choice([True, False, None]), r.choice([True, False])))
    v = spark.createDataFrame(values, "i int, k string, x double")
    s = spark.createDataFrame(spans, "j int, k string, lo double, hi double, lo_closed boolean, hi_closed boolean")
    holds = lambda x, lo, hi, c, e: x is not None and math.isfinite(x) and (lo is None or x > lo or (x == lo and c)) and (hi is None or x < hi or (x == hi and e))
    for on in ([], ["k"]):
        found = G.range_join(v if on else v.drop("k"), s if on else s.drop("k"), "x", on)
        assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
        want = {(i, j) for i, k, x in values for j, q, *span in spans if (not on or (k is not None and k == q)) and holds(x, *span)}
        got = [(x["i"], x["j"]) for x in found.select("i", "j").collect()]
        assert len(got) == len(want) and set(got) == want
    assert G.range_join(v.where("false"), s.drop("k"), "x").count() == 0
    assert G.range_join(v.drop("k"), s.drop("k").where("false"), "x").count() == 0


def test_classes_of_ties_and_of_what_has_no_number(spark):
    cuts = [("a", float(c), c % 2 == 0) for c in range(33)] + [("b", 1.0, True), ("b", 1.0, False), ("b", None, True)]
    values = [(k, x) for k in ("a", "b", "none", None) for x in [None, math.nan, -5.0, 1e9, *[c / 2 for c in range(70)]]]
    got = G.classified(spark.createDataFrame(values, "k string, x double"), G.cut_table(spark, cuts).withColumnRenamed("template", "k"), "k", "x").collect()
    assert len(got) == len(values)
    for k, x, c in got:
        own = [] if x is None or math.isnan(x) else [1 for q, cut, closed in cuts if q == k and cut is not None and (x > cut or (x == cut and closed))]
        assert c == len(own), (k, x, c)


def test_all_patterns_in_one_pass(spark):
    assert X.replaced_once("abcabd", {"ab": "1", "abc": "2", "b": "3"}) == "21d"
    assert X.replaced_once("aaa", {"a": "aa"}) == "aaaaaa"
    assert X.replaced_once("xabcdx", {"ab": "1", "bcd": "2"}) == "x1cdx"
    many = {f"name{i:04d}@x.org": f"<{i}>" for i in range(1000)}
    text = " ".join(many) * 3
    assert X.replaced_once(text, many) == "".join([" ".join(many.values())] * 3)
    docs = spark.createDataFrame([(1, "uno due"), (1, "due"), (2, None), (3, ""), (4, "kept"), (None, "uno")], "doc_id int, text string")
    pairs = spark.createDataFrame([(1, "due", "2"), (1, "due", "3"), (1, "", "x"), (1, "uno", None), (2, "a", "b"), (3, "a", "b"), (None, "uno", "1")], "doc_id int, old string, new string")
    got = sorted((tuple(r) for r in X.replace_all(docs, pairs, "old", "new").collect()), key=str)
    assert got == sorted([(1, "uno 2"), (1, "2"), (2, None), (3, ""), (4, "kept"), (None, "uno")], key=str)


def test_names_without_fragments(spark):
    names = spark.createDataFrame([("anna",), ("anna",), ("bob",), ("",), (None,), ("x" * 300 + "éz",)], "name string")
    f = lambda *x: spark.createDataFrame([(y,) for y in x], "fragment string")
    left = lambda *x: sorted(str(r["name"])[-4:] for r in X.without_fragments(names, f(*x)).collect())
    assert left("nn", None, "zzzzzz") == sorted(["bob", "", "None", "xxéz"])
    assert left("éz", "b") == sorted(["anna", "anna", "", "None"])
    assert left("") == ["None"]
    assert len(left()) == 6
    assert "NestedLoop" not in plan(X.without_fragments(names, f("nn", "b")))


def test_a_stopped_sweep_resumes(spark, tmp_path):
    path = f"file://{tmp_path}/tree"
    cells = spark.createDataFrame([(t, e) for t in "abc" for e in (0.1, 0.2, None)] + [("a", 0.1)], "t string, e double")
    calls = []

    def compute(todo):
        calls.append({tuple(r) for r in todo.collect()})
        return todo.where("t <> 'c'").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))

    def breaks(todo):
        compute(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("t", "e").parquet(path)
        raise RuntimeError("killed")

    assert sweeps.sweep(cells, compute, path, ["t", "e"], waves=4, most=1) == 1
    with pytest.raises(RuntimeError):
        sweeps.sweep(cells, breaks, path, ["t", "e"], waves=4)
    first, killed = calls[0], calls[1]
    sweeps.sweep(cells, compute, path, ["t", "e"], waves=4)
    later = set().union(*calls[2:])
    assert killed and killed <= later and not first & later
    assert first | later == {(t, e) for t in "abc" for e in (0.1, 0.2, None)}
    tree = sweeps.finished(path, cells.withColumn("n", F.lit(1)).select("n", "t", "e"))
    assert sorted((tuple(r) for r in tree.collect()), key=str) == sorted(((n, t, e) for t in "ab" for e in (0.1, 0.2, None) for n in (1, 2)), key=str)
    assert sweeps.sweep(cells, compute, path, ["t", "e"], waves=4) == 0


def test_samples_a_line_each(spark, tmp_path):
    turns = [[{"hb": 1.0, "rbc": 2.0}, {"hb": 3.0}], []]
    df = spark.createDataFrame([("A", "1", [(m,) for m in turns[0]]), ("A", "2", [])], S.SAMPLE)
    S.write_samples(df, f"file://{tmp_path}/s")
    with open(f"{tmp_path}/s/odd.json", "w") as f:
        f.write('{"template": "B"\n{"id": "3"}\n')
    assert sorted(tuple(r) for r in S.read_samples(spark, f"file://{tmp_path}/s").collect()) == [("A", "1", "hb", 3.0), ("A", "1", "rbc", 2.0)]


@pytest.mark.parametrize("idle", [None, 100.0])
def test_ledger_in_event_order_across_batches(spark, tmp_path, idle):
    """Events come out of order, some twice, some too late; what the watermark has passed equals the ledger in order."""
    r = random.Random(5)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    happened = [(u, 100 * u + k, 20 * k + r.randint(0, 9) + (400 if k > 12 else 0)) for u in (1, 2, 3) for k in range(24)]
    arrival = sorted(happened, key=lambda e: e[2] + r.randint(0, 90))
    batches = [arrival[k : k + 12] for k in range(0, len(arrival), 12)]
    late = (1, 999, 1)
    batches[-1] = [*batches[-1], late, batches[-1][0], batches[-2][-1]]
    own = ST.ledger_session(spark)
    schema = "user_id long, event_id long, ts timestamp, eps double"
    source = f"file://{tmp_path}/in"
    for k, b in enumerate(batches):
        own.createDataFrame([(u, e, start + dt.timedelta(seconds=s), 0.25) for u, e, s in b], schema).coalesce(1).write.mode("append").parquet(source)
    charged = ST.charged_in_order(own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 1.0, "120 seconds", idle)
    q = charged.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/marks").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {x["event_id"]: (x["user_id"], round(x["spent"], 6), x["allowed"]) for x in own.read.parquet(f"file://{tmp_path}/out").collect()}
    want, spent, last = {}, {}, {}
    mark = max(s for _, _, s in happened) - 120
    for u, e, s in sorted(happened, key=lambda x: (x[0], x[2], x[1])):
        if s > mark:
            continue
        if idle is not None and u in last and s - last[u] > idle:
            spent[u] = 0.0
        ok = round(spent.get(u, 0.0) + 0.25, 9) <= 1.0
        spent[u], last[u] = spent.get(u, 0.0) + 0.25 * ok, s
        want[e] = (u, spent[u], ok)
    assert got == want
    assert sum(ok for _, _, ok in got.values()) == (12 if idle is None else 24)
    assert ST.late_events(q.recentProgress) >= 1


def test_range_totals(spark):
    """Counts and sums over intervals equal those of all pairs: ends on values, open and empty intervals, keys that repeat, nulls; and no join of the two sides."""
    import random

    rng = random.Random(5)
    values = [(rng.randrange(3), float(rng.randrange(-20, 60))) for _ in range(300)] + [(None, 1.0), (1, None), (2, float("nan"))]
    spans = [(k % 150, rng.randrange(4), float(rng.randrange(-30, 70)), rng.choice([None, float(rng.randrange(-30, 70))])) for k in range(200)] + [(900, 1, None, 5.0), (901, None, 0.0, 5.0)]
    want = {}
    for k, g, lo, hi in spans:
        for h, x in values:
            if None not in (g, lo, x) and g == h and x > lo and (hi is None or x <= hi):
                n, t = want.get(k, (0, 0.0))
                want[k] = n + 1, t + x
    v, s = spark.createDataFrame(values, "g int, x double"), spark.createDataFrame(spans, "k int, g int, lo double, hi double")
    for segments in (1, 7, 256):
        found = G.range_totals(v, s, "x", "k", "g", segments=segments)
        assert {r.k: (r.n, round(r.total, 6)) for r in found.collect()} == {k: (n, round(t, 6)) for k, (n, t) in want.items()}
    assert G.range_totals(v.limit(0), s, "x", "k", "g").count() == 0
