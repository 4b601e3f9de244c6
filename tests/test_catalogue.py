import oracle
import pytest

from folioforge import catalogue


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, sf, name):
    assert oracle.compare(spark, sf, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]) > 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
