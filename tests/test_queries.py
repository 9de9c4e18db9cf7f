import pytest

from leadloom.plans import catalogue
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    same(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry_has_rows_and_a_stable_schema(spark):
    import __spark_entry__

    first = __spark_entry__.entry(spark)
    assert first.columns == ["id", "name", "state", "score", "total", "total_pages"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
