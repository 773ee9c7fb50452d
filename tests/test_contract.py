"""The driver contract: entry, names, plans."""

import __spark_entry__ as contract
import pytest

from tidemark.queries import load_all

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "hours_since_view" in df.columns


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    own = load_all()
    assert len(own.QUERIES) - len(own.ORACLE) <= 6


@pytest.mark.parametrize("name", sorted(load_all().QUERIES))
def test_plans_stay_in_the_jvm_without_cross_joins(spark, sf, name):
    plan = contract.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]


def test_scan_is_pruned_and_filtered(spark, sf):
    plan = contract.queries()["date_range_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
