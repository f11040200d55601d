"""Every core query against its SQL on the small tables, and the plans that are promised."""

import pytest

from stackmill.plans import catalog
from stackmill.plans.catalog_sql import ORACLE_SQL
from tests import oracle
from tests.conftest import FOLDER


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.of_spark(catalog.QUERIES[name](spark, FOLDER)) == oracle.of_sql(con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_one_operator(spark):
    assert "TakeOrderedAndProject" in _plan(catalog.QUERIES["queue_claim_batch"](spark, FOLDER))


def test_filters_reach_the_scan(spark):
    plan = _plan(catalog.QUERIES["queue_legacy_unscoped"](spark, FOLDER))
    assert "ReadSchema: struct<project:string>" in plan
    from stackmill.operators import history

    log = spark.read.parquet(f"{FOLDER}/download_log.parquet")
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,failed)]" in _plan(history.attempts(log, status="failed"))


def test_stream_limiter_equals_closed_form(spark):
    assert oracle.of_spark(catalog.QUERIES["stream_rate_limiter"](spark, FOLDER)) == oracle.of_spark(catalog.QUERIES["rate_limit_schedule"](spark, FOLDER))


def test_history_pages_are_cut_before_folding(spark):
    plan = _plan(catalog.QUERIES["log_by_status"](spark, FOLDER))
    window = plan.index("Window")
    # Below the window only the rows of the page are left: they come from a join with the top-k of ids.
    assert "BroadcastHashJoin" in plan[window:] and "TakeOrderedAndProject" in plan[window:] and "EqualTo(status,failed)" in plan


def test_keywords_and_parsing_shuffle_nothing(spark):
    for name in ("topics_rake", "parse_items_ordered", "bibtex_parse", "url_canonical", "page_walls"):
        assert "Exchange" not in _plan(catalog.QUERIES[name](spark, FOLDER)), name
