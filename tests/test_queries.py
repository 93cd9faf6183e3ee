"""Every registered query at the smallest scale, compared with its SQL twin where there is one."""

import pytest

import __spark_entry__ as entry_points
from basketry.session import stage_scope
from compare import connect, difference, kinds

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    with stage_scope(spark):
        got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert difference(got, want) is None
    assert kinds(got) == kinds(want)
    assert len(got) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_gives_rows(spark, name):
    with stage_scope(spark):
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
