"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from framepack import queries as core
from tests.oracle import same

QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same(df, SQL[name], sf_dir)
    else:
        assert df.count() >= 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())
