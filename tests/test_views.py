"""Each programme view built with the DataFrame API equals its SQL body
(FIXTURES.md section C) run in DuckDB on the same tables."""

import pytest

from conftest import SF_SMALL
from oracle import compare, duck
from rollcall.plans.fixture_sql import VIEW_SQL
from rollcall.plans.views import VIEW_BUILDERS, Programme


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(VIEW_BUILDERS))
def test_view_matches_fixture_sql(spark, con, name):
    problems, n = compare(getattr(Programme(spark, SF_SMALL), name), con, VIEW_SQL[name])
    assert not problems, problems
    assert n > 0
