"""Every query with an SQL counterpart must give the same rows in DuckDB; the plans must scale."""

import pytest

import __spark_entry__ as contract
from check import compare, database
from voxtide.plans.catalog import QUERIES

FITTED = [n for n, q in QUERIES.items() if q.sql is None]


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_same_as_sql(spark, data, db, name):
    state, note = compare(spark, db, data, QUERIES[name])
    assert state == "ok", note


@pytest.mark.parametrize("name", FITTED)
def test_fitted_queries_give_rows(spark, data, name):
    assert QUERIES[name].run(spark, data).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() == 80
    assert set(contract.oracle_sql()) < set(contract.queries())


@pytest.mark.parametrize("name", ["flagship", "combined_series", "collection_stats", "crosstab_long", "value_shares",
                                  "store_sentiment_rows", "topics_of_feedback", "confusion_matrix", "tfidf"])
def test_plans(spark, data, name):
    plan = QUERIES[name].run(spark, data)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, plan
