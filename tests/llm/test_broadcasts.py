"""Joins whose sides the optimizer counts too low."""

from skyledger.llm import simhash
from skyledger.session import materialise


def test_keys_of_fingerprints_are_not_broadcast(spark):
    # 20,000 fingerprints are 160 kB to the optimizer, their 67 keys each are 1.3 million rows.
    fps = materialise(spark.range(20_000).selectExpr("xxhash64(id) as fp"), "fps")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
