"""Every registered query that has SQL, against DuckDB on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from veilgrid.plans import registry
from veilgrid.plans.base import TABLES, allocations


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def pairs(request, spark, sf_dir, duck):
    """The rows of every query asked for, by Spark and by DuckDB, worked out a few at a time: most of it is planning."""
    names = [i.callspec.params["name"] for i in request.session.items if getattr(i, "originalname", "") == "test_same_rows"]
    allocations(spark)

    def both(name):
        return rows(registry.queries()[name](spark, sf_dir).toPandas()), rows(duck.cursor().execute(registry.oracle_sql()[name]).df())

    with ThreadPoolExecutor(4) as pool:
        yield {n: pool.submit(both, n) for n in names}
        pool.shutdown(cancel_futures=True)


def rows(df):
    columns = sorted(df.columns)
    value = lambda x: None if pd.isna(x) else float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return columns, sorted((tuple(value(x) for x in r) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(pairs, name):
    ours, theirs = pairs[name].result()
    assert ours == theirs


def test_every_oracle_parses(duck):
    for sql in registry.oracle_sql().values():
        duck.sql(f"EXPLAIN {sql}")


def test_registered(spark, sf_dir):
    assert len(registry.queries()) > 200
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.flagship(spark, sf_dir).count() == 3
