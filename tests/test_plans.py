"""Every registered query plans without cartesian products or nested-loop joins."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if not n.startswith("op") and n != "pipeline"])
def test_no_pairwise_joins(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"
