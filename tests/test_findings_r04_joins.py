"""What the reviewer of the fourth round found of points and names: each of these failed before it was mended."""

from __future__ import annotations

import math
import random

import pytest

from thalweg.operators import flow, search, shapes


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("find", [shapes.nearest, shapes.best_near])
def test_buckets_of_points_are_not_broadcast(spark, find):
    """A point is a row for each of 15 buckets and more, which the planner takes for the size of one."""
    points = spark.createDataFrame([(k, k * 0.01, 57.0, 3.0) for k in range(50)], "point_id long, lon double, lat double, area double")
    ends = spark.createDataFrame([(k, 0, k * 0.013, 57.001, 2.0, 4.0) for k in range(30)], "owner long, seq int, lon double, lat double, up double, dn double")
    got = find(points, ends, 0.02)
    near = [(min((k for k in range(30)), key=lambda k: abs(k * 0.013 - p * 0.01)), p) for p in range(50)]
    want = {p: k for k, p in near if math.hypot((k * 0.013 - p * 0.01) * math.cos(math.radians(57.0)), 0.001) <= 0.02}
    if find is shapes.nearest:
        assert {r.point_id: r.owner for r in got.collect() if r.owner is not None} == want
    assert "Broadcast" not in _plan(got).split("Generate")[0].split("SortMergeJoin [bx")[0].replace("BroadcastHashJoin [point_id", "") and "SortMergeJoin [bx" in _plan(got)


def test_pieces_of_names_are_not_broadcast(spark):
    names = ["old plate", "hot bolt", "cold plate", "plain old ring"]
    entries = spark.createDataFrame([(k, n, k % 3, float(k), float(k), 1.0) for k, n in enumerate(names)], "entry_id long, name string, rank int, size double, lon double, lat double")
    terms = spark.createDataFrame([(0, "old"), (1, "p"), (2, "late"), (3, "zzz")], "term_id long, term string")
    got = search.search_many(entries, terms)
    assert sorted((r.term_id, r.part, r.name) for r in got.collect()) == [(0, 1, "old plate"), (0, 2, "cold plate"), (0, 2, "plain old ring"), (1, 1, "plain old ring"), (2, 2, "cold plate"), (2, 2, "old plate")]
    assert "Broadcast" not in _plan(got)


@pytest.mark.parametrize("reach", [3, 8])
def test_cells_near_by_are_found_in_tiles(spark, reach):
    """No neighbour is a row of its own, and tiles have what lies within reach of them."""
    rng, w = random.Random(3), 300
    area = {(x, y): rng.choice([1, 2, 9, 40, 40]) for x in range(w) for y in range(240, 272)}
    cells = spark.createDataFrame([(y * w + x, x, y, a) for (x, y), a in area.items()], "cell_id long, x long, y long, acc long")
    asked = [xy for xy in sorted(area) if rng.random() < 0.02]
    spots = spark.createDataFrame([(y * w + x, x, y, area[x, y]) for x, y in asked], "cell_id long, x long, y long, here long")
    got = flow.snapped(cells, spots, reach)
    want = {}
    for x, y in asked:
        found = [(-round(math.log10(area[x + i, y + j] + 1) - math.sqrt(i * i + j * j) / (reach + 1), 9), j, i) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if area.get((x + i, y + j), 0) >= max(4, 5 * area[x, y])]
        if found:
            _, j, i = min(found)
            want[y * w + x] = (y + j) * w + x + i
    assert {r.cell_id: r.best for r in got.collect()} == want
    assert _plan(got).count("Generate explode") == 2  # cells to the tiles beside them


def test_spots_and_cells_that_come_twice(spark):
    """A spot is one row, whatever it drains, and of a cell that comes twice the larger one counts."""
    cells = spark.createDataFrame([(0, 0, 0, 1), (1, 1, 0, 90), (1, 1, 0, 5), (2, 2, 0, 60)], "cell_id long, x long, y long, acc long")
    spots = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 0, 18)], "cell_id long, x long, y long, here long")
    assert [tuple(r) for r in flow.snapped(cells, spots, 3).collect()] == [(0, 1)]
