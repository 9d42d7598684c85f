import pytest

from rowstream.plans import catalogue
from tests.comparison import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "pos_offset" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
