"""Every registered query against its SQL, and the rest for rows, on the smallest data set."""

import pytest
from compare import compare

from urlsieve import registry

registry.load_all()
ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, sf, name):
    problem, _ = compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf)
    assert problem is None, problem


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
