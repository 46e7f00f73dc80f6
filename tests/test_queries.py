"""Every engine query against its SQL."""

import pytest

from siftwell.queries import ORACLES, QUERIES
from tests.conftest import DATA, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        same(df, duck.sql(ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
