"""Every registered query with a SQL twin gives the same rows; the others give rows."""

import pytest

import __spark_entry__ as entry_module
from compare import differences, duck

SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert differences(got, con.execute(SQL[name]).df(), slack=1.1e-6) == []


# the slow ones are covered by their own unit tests
ROWS_ONLY = sorted(set(QUERIES) - set(SQL) - {
    "importance_vote", "outlier_benchmark", "synthetic_benchmark", "generalisation", "extra_trees_importance",
    "gbt_cv", "bagging", "bagging_tuned", "forest_grid", "tree_cv", "symbolic_islands", "impute_models", "impute_model_scores"})


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(5).count() > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 8 and min(r["rank"] for r in rows) == 1
