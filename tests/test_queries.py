"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from check import compare

SF_DIR = "/root/testdata/sf0.001"
PLANS, SQLS = entry_points.queries(), entry_points.oracle_sql()


@pytest.mark.parametrize("key", sorted(PLANS))
def test_query(spark, key):
    verdict, _ = compare(spark, SF_DIR, key, PLANS, SQLS)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


def test_every_sql_has_a_plan():
    assert set(SQLS) <= set(PLANS)
