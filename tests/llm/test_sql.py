"""Training-data queries that SQL can express, against DuckDB over a whole table."""

import oracle
import pytest

from fieldbook.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query(spark, name):
    assert oracle.differences(q.QUERIES[name](spark, SF), oracle.duck(SF), q.ORACLE_SQL[name]) == ""
