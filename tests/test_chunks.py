"""Forests that are cut into chunks of ids, against walks in plain Python; ways and cycles cross from chunk to chunk."""

from __future__ import annotations

import random

import pytest

from thalweg.operators import chunks, flow


@pytest.mark.parametrize("size", [4, 16, 1 << 18])
def test_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(chunks, "SIZE", size)
    rng = random.Random(3)
    n = 90
    to = {i: (rng.choice([j for j in range(max(0, i - 25), i)] or [None]) if rng.random() < .9 else None) for i in range(n)}
    val = {i: rng.choice([None, *range(-5, 9)]) for i in range(n)}
    edges = spark.createDataFrame([(i, to[i]) for i in range(n)], "cell_id long, parent_id long")
    values = spark.createDataFrame([(i, val[i], None if val[i] is None else val[i] * .5) for i in range(n)], "cell_id long, v int, d double")
    above = {i: [] for i in range(n)}
    root = {}
    for i in range(n):
        j = i
        while j is not None:
            above[j].append(val[i]); root[i] = j; j = to[j]
    def agg(f, vs):
        vs = [v for v in vs if v is not None]
        return f(vs) if vs else None
    got = {r.cell_id: (r.s, r.a, r.b, r.f) for r in flow.totals(edges, values, s=("sum", "v"), a=("min", "v"), b=("max", "d"), f=("sum", "d")).collect()}
    assert got == {i: (agg(sum, above[i]), agg(min, above[i]), agg(lambda x: max(x) * .5, above[i]), agg(lambda x: sum(x) * .5, above[i])) for i in range(n)}
    assert {r.cell_id: r.term for r in flow.terminals(edges).collect()} == root
    ring = spark.createDataFrame([(50, 51), (51, 52), (52, 60), (60, 50), (3, 60), (7, 7), (8, 7), (70, None), (71, 70)], "cell_id long, parent_id long")
    assert sorted(tuple(r) for r in flow.acyclic(ring).collect() if r.sink) == [(7, None, True), (50, None, True)]
    assert {r.cell_id: r.term for r in flow.terminals(ring).collect()} == {50: 50, 51: 50, 52: 50, 60: 50, 3: 50, 7: 7, 8: 7, 70: 70, 71: 70}
    assert {r.cell_id: r.acc for r in flow.accumulate(ring).collect()} == {50: 5, 51: 1, 52: 2, 60: 4, 3: 1, 7: 2, 8: 1, 70: 2, 71: 1}


def test_joins_follow_entries_alone(spark, monkeypatch):
    """What is joined by doubling are the nodes that another chunk leads to: here one of 64 in a line of 640."""
    chased, doubled, counts = flow._chased, flow._doubled, []
    monkeypatch.setattr(chunks, "SIZE", 64)
    monkeypatch.setattr(flow, "_chased", lambda links, *a, **k: counts.append(links.count()) or chased(links, *a, **k))
    monkeypatch.setattr(flow, "_doubled", lambda links, *a: counts.append(links.count()) or doubled(links, *a))
    line = spark.createDataFrame([(k, k + 1 if k < 639 else None) for k in range(640)], "cell_id long, parent_id long")
    assert flow.terminals(line).where("term = 639").count() == 640
    assert {r.cell_id: r.acc for r in flow.accumulate(line).collect()} == {k: k + 1 for k in range(640)}
    assert counts == [9, 9]
