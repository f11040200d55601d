"""Queries of this subpackage against their SQL; the others run on the small tables."""

import pytest

from stackmill.llm import queries
from tests import oracle
from tests.conftest import FOLDER


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert oracle.of_spark(queries.QUERIES[name](spark, FOLDER)) == oracle.of_sql(oracle.connect(FOLDER), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.endswith(("_found", "_packed", "_mixed")) and n not in queries.ORACLE_SQL])
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
