"""What the reviewer of the fourth round found of runs along paths: each of these failed before it was mended."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from thalweg.operators import flow, journeys, walks


def _forest(spark, n: int = 400):
    rng = random.Random(5)
    parent = [None] + [None if rng.random() < 0.01 else rng.randrange(max(0, c - 4), c) for c in range(1, n)]
    up = [1] * n
    for c in range(n - 1, 0, -1):
        if parent[c] is not None:
            up[parent[c]] += up[c]
    acc = spark.createDataFrame([(c, parent[c], up[c]) for c in range(n)], "cell_id long, parent_id long, acc long")
    cells = spark.createDataFrame([(c, (None if c // 7 % 5 == 2 else c // 7 % 3, "ab"[c // 20 % 2]), rng.choice([300, 424]) if parent[c] is not None else None, c * 0.5) for c in range(n)], "cell_id long, label struct<a:long,b:string>, hop long, elev double")
    drops = spark.createDataFrame([(d, rng.randrange(n)) for d in range(150)] + [(150, None)], "drop_id long, cell_id long")
    return acc, drops, cells


def test_runs_are_slices_of_stems(spark, monkeypatch):
    """What is listed is a row a stem and path, not a row a run; the runs are those of before, also with a stem in several segments."""
    acc, drops, cells = _forest(spark)
    want = journeys.runs(acc.select("cell_id", "parent_id"), drops, cells)
    trace, counts = flow.trace, []
    monkeypatch.setattr(flow, "trace", lambda *a: counts.append(trace(*a)) or counts[-1])
    monkeypatch.setattr(walks, "SEGMENT", 5)
    got = walks.runs(acc, drops, cells).select(*want.columns)
    rows = sorted(map(repr, (tuple(r) for r in want.collect())))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == rows
    assert len(counts) == 1 and counts[0].count() < len(rows) / 2 and got.dtypes == want.dtypes


def test_journeys_deal_rows_by_path(spark):
    """Rows of a journey are never dealt by path and step."""
    rows = spark.createDataFrame([(d, s, s * 9000.0, 1.0 + s, 0, "R" if s % 5 else None, None) for d in range(4) for s in range(30)], "drop_id long, step long, dist double, area double, cls int, river string, lake string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = journeys.smoothed(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if "step" in x]
    assert journeys.smoothed(rows).where(F.col("river").isNull()).count() == 4
