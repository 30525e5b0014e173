import pytest

from pointloom.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connection


@pytest.mark.parametrize("name", ORACLE)
def test_query_against_its_sql(spark, name):
    assert compare(spark, connection(), QUERIES[name], ORACLE[name]) is None
