import pytest

from tests.oracle import assert_same, connect
from treeloom.jobs.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert_same(df, con, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
