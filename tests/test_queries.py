"""Every registered query with SQL equals DuckDB on the smallest tables; the others run."""

import numpy as np
import pandas as pd
import pytest

from orderlens.plans import oracles, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(value):
    if value is None or value is pd.NaT or isinstance(value, float) and np.isnan(value):
        return "null"
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    if isinstance(value, (bool, np.bool_, str)):
        return str(value)
    return f"{float(value):.6f}"


def table(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = oracles.oracle_sql().get(name)
    if sql:
        assert table(got) == table(duck.execute(sql).df())
    else:
        assert len(got) and name in {"fc1_backtest_by_region", "fc1_chosen_by_region", "a06_isolation_forest", "a07_clv", "a09_segmentation", "a09_segmentation_engaged", "a12_churn_risk"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
