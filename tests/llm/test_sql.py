import oracle
import pytest

from folioforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    assert oracle.compare(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0
