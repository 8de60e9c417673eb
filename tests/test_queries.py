import pytest

from colloquy.plans import catalog

from duck import assert_same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    if name in catalog.SQL:
        assert_same(df, catalog.SQL[name], DATA)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
