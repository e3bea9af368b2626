"""Releases of a root that come together in its own task: the rows of the SQL where customers repeat, and plans that shuffle no releases."""

import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from test_oracles import rows
from veilgrid.operators.audit import lower_medians
from veilgrid.operators.release import numbered
from veilgrid.plans import q_report as Q
from veilgrid.plans import registry
from veilgrid.plans.base import cell_rows

TOGETHER = ["aud1_repeated", "aud1_replayed", "aud4_summed", "aud6_map_with_prior", "aud6_map_with_prior_stair", "aud7_unaffected", "aud8_lower_median", "aud11_naive", "aud13_errors", "rpt12_by_template"]
TRUE_VALUES = ["dag5_targets", "cls1_risk_class", "cls2_inclusive_cuts", "cls2_all_templates", "src8_resumed_sweep"]


@pytest.fixture(scope="module")
def repeating(spark, sf_dir):
    """A folder whose customers are 12, 4 of them twice and one three times."""
    folder = tempfile.mkdtemp(prefix="run-")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey BETWEEN 1 AND 12")
    c.unionAll(c.where("c_custkey <= 4")).unionAll(c.where("c_custkey = 1")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("name", TOGETHER + TRUE_VALUES)
def test_customers_that_repeat(spark, repeating, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{repeating}/customer.parquet/*.parquet'")
    assert rows(registry.queries()[name](spark, repeating).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", TOGETHER[2:5] + TOGETHER[6:9] + TRUE_VALUES[:1])
def test_no_release_is_shuffled(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(c_custkey" in plan and "hashpartitioning(template" not in plan and "hashpartitioning(patient_id" not in plan


def test_target_estimates_shuffle_keys_only(spark, repeating, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{repeating}/customer.parquet/*.parquet'")
    name = "aud12_target_estimates"
    assert rows(registry.queries()[name](spark, repeating).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(c_custkey" in plan and "hashpartitioning(template" not in plan and "hashpartitioning(patient_id" not in plan


@pytest.mark.parametrize("name", ["cls1_risk_class", "cls2_all_templates", "aud13_errors"])
def test_keys_are_dealt_before_they_are_distinct(spark, sf_dir, name):
    """A task that reads a file aggregates none of its keys."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    reads = [k for k, line in enumerate(plan) if "Exchange hashpartitioning(c_custkey" in line]
    assert reads and not any("HashAggregate" in plan[k + 1] for k in reads)


def test_equal_cells_are_released_once(spark):
    """The config all has the same budgets under every setting."""
    for cells in cell_rows(spark).values():
        found = numbered(cells)
        assert len(found) == 90 and len({k for k, c in found if c.config == "all"}) == 10


def test_errors_are_summed_where_they_are_drawn(spark, sf_dir, repeating):
    """One read of the customers serves every law, config, eps and strategy; tasks return sums, equal to those of a row per root and q."""
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{repeating}/customer.parquet/*.parquet'")
    name = "rpt11_by_draws"
    assert rows(registry.queries()[name](spark, repeating).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("MapInArrow") == 1
    keys, where = ["template", "root", "config", "eps", "q"], f"{Q.RECONSTRUCTED} AND eps <= 0.1"
    for law in ("exp", "blap", "stair"):
        sums = [F.sum(F.abs("value")).alias("value"), F.sum("naive").alias("naive"), F.sum("map").alias("map")]
        each = {tuple(r[:5]): r[5:] for r in Q.root_errors(spark, repeating, Q.QS, Q.QS, where, law).groupBy(*keys).agg(*sums).collect()}
        summed = {tuple(r[:5]): r[5:] for r in Q.drawn(spark, repeating, {law: where}).groupBy(*keys).agg(*sums).collect()}
        assert summed.keys() == each.keys() and len(each) > 100
        for k, x in each.items():
            assert summed[k] == pytest.approx(x, rel=1e-9, abs=1e-9)


def test_lower_medians_of_every_prefix():
    import numpy as np

    idx = np.random.default_rng(5).integers(0, 9, (17, 200)).astype(np.int16)
    for n, found in lower_medians(idx, (1, 2, 5, 9, 16, 17)).items():
        assert (found == np.sort(idx[:n], axis=0)[(n + 1) // 2 - 1]).all()
