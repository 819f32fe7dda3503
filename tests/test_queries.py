"""Every query of the engine against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tombola.plans.oracles import ORACLE_SQL
from tombola.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or v != v:
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v)

    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    pd.testing.assert_frame_equal(plain(QUERIES[name](spark, DATA).toPandas()), plain(duck.execute(ORACLE_SQL[name]).df()))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("parse_")] + ["find_date", "repair_text"])
def test_expressions_do_not_multiply(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") < 30


@pytest.mark.parametrize("name", ["backtest_predictions", "backtest_report", "backtest_kept", "strength_ranking", "four_conditions_static"])
def test_the_history_is_scanned_once_and_nothing_is_kept(spark, name):
    """Every further use of the reconciled history reads the shuffle of the first."""
    spark.catalog.clearCache()
    df = QUERIES[name](spark, DATA)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "InMemoryTableScan" not in final
    assert final.count("FileScan parquet") <= 2


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("backtest_")])
def test_uses_of_the_history_do_not_sort_it_again(spark, name):
    """Sorts of all uses meet in one task. (`backtest_kept` had 120 sorts to aggregate.)"""
    df = QUERIES[name](spark, DATA)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "FileScan parquet" not in final and "Scan ExistingRDD" in final
    assert final.count("SortAggregate") == 0 and final.count("Sort [") <= 20
