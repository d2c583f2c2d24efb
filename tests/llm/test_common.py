"""Joins on hot keys against plain Python."""

from __future__ import annotations

from gleanframe.llm.common import join_hot, saved


def test_join_hot(spark):
    for keys, shuffled in ((5, False), (1_500, True)):
        # Key 0 is hot, some keys are on one side only, some rows have none.
        left = [(0 if i % 2 else i % (keys + 3), i) for i in range(4_000)] + [(None, -1)]
        size = {k: sum(x == k for x, _ in left) for k in range(keys)}
        right = saved(spark.createDataFrame([(k, n, f"v{k}") for k, n in size.items()], "key long, n long, value string"))
        got = join_hot(spark.createDataFrame(left, "key long, i long"), right, "key", "n")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("Union" in plan) == shuffled, keys  # few keys: one broadcast, and left is computed once
        assert sorted(map(tuple, got.collect())) == sorted((k, i, size[k], f"v{k}") for k, i in left if k in size)
