"""Plans of the criteria queries, which the driver holds several times over."""

import pytest

from proofsheet.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["criteria_read", "matrix_payloads"])
def test_plan_is_small(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 130_000


def test_duplicates_are_ordered_once_a_group(spark):
    from proofsheet.operators import matching

    o = spark.createDataFrame([(5, "a", ""), (3, "a", ""), (4, "", "a"), (9, "a", "x"), (1, "", "")], "k long, s string, w string")
    df = matching.duplicate_identities(o, "k", catalog.F.col("s"), catalog.F.col("w"))
    assert {r.k: r.duplicate_of for r in df.collect()} == {3: [5, 9], 5: [3, 9], 9: [3, 5], 4: [], 1: []}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan and plan.index("array_sort") > plan.index("Join")  # below the join, over groups
