"""Every query with check SQL equals DuckDB on the test tables."""

import time

import __spark_entry__ as driver
import compare
import pytest

from leadtide.registry.catalog import BUILDERS, Tables

ORACLES = driver.oracle_sql()
QUERIES = driver.queries()
#: Queries that fit models: few rounds are enough to check them.
FITTING = {
    "mlp_3d", "mlp_2w", "gbt_3d", "gbt_2w", "gbt_full_3d", "gbt_full_2w", "value_gbt", "value_gbt_full", "scored_quotes",
    "model_report", "feature_importance", "new_customer_test_scores", "model_roundtrip", "train_from_json", "stream_score",
}


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_duckdb(spark, folder, con, name):
    found = BUILDERS[name](Tables(spark, folder, rounds=3)) if name in FITTING else QUERIES[name](spark, folder)
    assert compare.differences(found, con, ORACLES[name]) is None


def test_every_query_of_the_reference_has_a_check():
    assert set(BUILDERS) <= set(ORACLES)


def test_check_sql_is_quick_with_one_thread(folder):
    """The checks share a machine with the queries; none may plan its steps over and over."""
    slow = {}
    con = compare.connect(folder.replace("sf0.001", "sf0.01"))
    con.sql("SET threads = 1")
    for name in BUILDERS:
        start = time.perf_counter()
        con.sql(ORACLES[name]).fetchall()
        slow[name] = time.perf_counter() - start
    assert max(slow.values()) < 20, max(slow, key=slow.get)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_all_features(spark):
    rows = driver.entry(spark)
    assert len([c for c in rows.columns if c.endswith(("_aov", "_close_rate", "_asc"))]) >= 24
    assert rows.count() > 0
