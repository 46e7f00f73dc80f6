"""The jobs as queries, against their SQL."""

import pytest

from jobs.queries import ORACLES, QUERIES
from tests.conftest import DATA, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck.sql(ORACLES[name]))
