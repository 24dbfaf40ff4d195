"""The flow core against plain walks: all directions, terminal cells, cycles, catchments, orders; and the tables of names."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from thalweg import api
from thalweg.functions import geodesy as g
from thalweg.functions.lineage import add, cut, drop
from thalweg.operators import basins, flow, gazetteer, paths, rasters, search, shapes
from thalweg.sources import rivers

W = 12
DX, DY = (0, 1, 1, 0, -1, -1, -1, 0, 1), (0, 0, 1, 1, 1, 0, -1, -1, -1)


def grid(spark, seed=3):
    rng = random.Random(seed)
    rows = [(y * W + x, x, y, rng.randrange(40), W, 1 if x >= W - 2 or rng.random() < 0.03 else 0) for y in range(W) for x in range(W)]
    return rows, spark.createDataFrame(rows, "cell_id long, x long, y long, z long, w long, cls int")


def test_descent_with_terminal_cells_and_ties(spark):
    rows, cells = grid(spark)
    z = {(x, y): v for _, x, y, v, _, _ in rows}
    got = {r.cell_id: (r.dir, r.parent_id) for r in flow.d8(cells.withColumn("terminal", F.col("cls") == 1)).collect()}
    codes = set()
    for i, x, y, v, _, cls in rows:
        best = (0, None)
        if cls != 1 and 0 < x < W - 1 and 0 < y < W - 1:
            falls = [((v - z[x + DX[k], y + DY[k]]) / (1.41421356 if DX[k] and DY[k] else 1.0), -k) for k in range(1, 9)]
            fall, k = max(falls)
            if fall > 0:
                best = (-k, (y + DY[-k]) * W + x + DX[-k])
        assert got[i] == best
        codes.add(got[i][0])
    assert codes == set(range(9)) and all(got[r[0]][0] == 0 for r in rows if r[5] == 1)


def test_a_cycle_ends_as_a_sink(spark):
    # 5 -> 1 -> 2 -> 3 -> 1, 7 -> 8
    edges = spark.createDataFrame([(5, 1), (1, 2), (2, 3), (3, 1), (7, 8), (8, None)], "cell_id long, parent_id long")
    assert {r.cell_id: r.term for r in flow.terminals(edges).collect()} == {5: 1, 1: 1, 2: 1, 3: 1, 7: 8, 8: 8}
    assert {r.cell_id: r.acc for r in flow.accumulate(edges).collect()} == {5: 1, 1: 4, 2: 1, 3: 2, 7: 1, 8: 2}
    path = flow.trace(edges, spark.createDataFrame([(0, 2), (1, 5)], "drop_id long, cell_id long"))
    assert sorted(map(tuple, path.collect())) == [(0, 0, 2), (0, 1, 3), (0, 2, 1), (1, 0, 5), (1, 1, 1)]
    assert [r.cell_id for r in flow.acyclic(edges).where("sink").collect()] == [1]


def forest(seed, n=120):
    rng = random.Random(seed)
    return {i: rng.randrange(i) if i and rng.random() < 0.95 else None for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_catchments_orders_and_totals(spark, seed):
    parent = forest(seed)
    edges = spark.createDataFrame(sorted(parent.items()), "cell_id long, parent_id long")
    up = {i: [] for i in parent}
    for i in parent:
        j = i
        while j is not None:
            up[j].append(i)
            j = parent[j]
    outlets = spark.createDataFrame([(i,) for i in range(0, 120, 3)], "outlet_id long")
    got = {}
    for r in flow.catchment(edges, outlets).collect():
        got.setdefault(r.outlet_id, []).append(r.cell_id)
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(up[i]) for i in range(0, 120, 3)}
    values = edges.select("cell_id", (F.col("cell_id") * 7 % 31).alias("v"))
    found = {r.cell_id: (r.s, r.a, r.b) for r in flow.totals(edges, values, s=("sum", "v"), a=("min", "v"), b=("max", "v")).collect()}
    assert found == {i: (sum(k * 7 % 31 for k in up[i]), min(k * 7 % 31 for k in up[i]), max(k * 7 % 31 for k in up[i])) for i in parent}
    order = {}
    for i in sorted(parent, reverse=True):  # children are larger
        kids = sorted((order[k] for k in parent if parent[k] == i), reverse=True)
        order[i] = 1 if not kids else kids[0] + (len(kids) > 1 and kids[1] == kids[0])
    acc = edges.select("cell_id", F.lit(1).alias("acc"))
    assert {r.cell_id: r.so for r in flow.strahler(edges, acc, 1).collect()} == order


def test_build_fills_and_leaves_the_sea_alone(spark):
    _, cells = grid(spark)
    built = api.build(cells, stream=2)
    rows = {r.cell_id: r for r in built.collect()}
    assert all(r.dir == 0 and r.parent_id is None for r in rows.values() if r.cls == 1)
    inner = [r for r in rows.values() if r.cls != 1 and 0 < r.x < W - 1 and 0 < r.y < W - 1]
    assert all(r.parent_id is not None for r in inner)  # no pit is left
    assert sum(r.acc for r in rows.values() if r.parent_id is None) == W * W and {r.dir for r in inner} <= set(range(1, 9))
    made = api.build_all(cells.withColumn("size_m", F.lit(1000.0)), spark.createDataFrame([], "poly_id long, rings array<array<struct<lon:double,lat:double>>>, name string"), least=2.0, thresholds=(6.0, 4.0, 2.0))
    assert set(made) == set(api.STAGES) and made["basins"].count() > 0 and {r.lod for r in made["rivers"].collect()} == {0, 1, 2}
    assert {r.layer for r in made["tiles"].select("layer").distinct().collect()} == {"flow", "acc", "elev"} and made["climate"].count() == 4


def test_truncated_traces(spark):
    edges = [(i, i + 1 if i < 30 else None) for i in range(31)]
    cells = spark.createDataFrame([(i, i, 0, 100 - i, 31, 0, p, 1 + i) for i, p in edges], "cell_id long, x long, y long, z long, w long, cls int, parent_id long, acc long")
    e = api.Engine(cells)
    at = e._located(cells.where("cell_id in (0, 25)")).select(F.col("cell_id").alias("drop_id"), "lon", "lat")
    ends = {r.drop_id: (r.n, r.truncated, r.terminal) for r in e.trace(at, max_steps=10).groupBy("drop_id").agg(F.count(F.lit(1)).alias("n"), F.max("truncated").alias("truncated"), F.max("terminal").alias("terminal")).collect()}
    assert ends == {0: (11, True, None), 25: (6, False, 0)}
    assert {r.drop_id: r.truncated for r in e.rain(at, 3, 2).select("drop_id", "truncated").distinct().collect()} == {0: True, 25: False}


def test_profiles_of_hard_paths(spark):
    rows = [(1, 0, None), (1, 1, 5.0), (1, 2, 9.0), (1, 3, float("nan")), (1, 4, -2.0), (1, 5, -3.0), (2, 0, None), (3, 0, -5.0), (3, 1, -6.0), (3, 2, -7.0)]
    df = spark.createDataFrame([(d, s, 10.0 + s / 100, 50.0, 1, None if s % 2 == 0 else 7.0, e) for d, s, e in rows], "drop_id long, step long, lon double, lat double, cls int, area double, elev double")
    got = {(r.drop_id, r.step): (r.elev, r.area, r.sea_at) for r in paths.decorate(df).collect()}
    assert [got[1, s] for s in range(6)] == [(5.0, 0.0, 4), (5.0, 7.0, 4), (5.0, 7.0, 4), (5.0, 7.0, 4), (-2.0, 7.0, 4), (-3.0, 7.0, 4)]
    assert got[2, 0] == (0.0, 0.0, 1) and got[3, 0][2] == 2


def test_nearest_shapes(spark):
    rng = random.Random(1)
    box = lambda x, y, n: [[{"lon": x + a * n, "lat": y + b * n} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]]
    squares = [(k, rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0.3, 3)) for k in range(15)]
    polygons = spark.createDataFrame([(k, box(x, y, n)) for k, x, y, n in squares] + [(99, None)], "poly_id long, rings array<array<struct<lon:double,lat:double>>>")
    spots = [(i, rng.uniform(-1, 22), rng.uniform(-1, 22)) for i in range(60)]
    points = spark.createDataFrame(spots, "point_id long, lon double, lat double")
    got = {r.point_id: (r.poly_id, round(r.d, 9)) for r in shapes.nearest_polygon(points, polygons, 1.5).collect()}
    for i, px, py in spots:
        best = min((math.hypot(max(x - px, 0, px - x - n), max(y - py, 0, py - y - n)), k) for k, x, y, n in squares)
        assert got.get(i) == ((best[1], round(best[0], 9)) if best[0] <= 1.5 else None)
    line = spark.createDataFrame([(7, 0, 0.0, 0.0), (7, 1, 10.0, 0.0), (8, 0, 0.0, 1.0), (8, 1, 10.0, 1.0)], "owner long, seq long, lon double, lat double")
    near = shapes.nearest_line(spark.createDataFrame([(0, 5.0, 0.3), (1, 5.0, 0.8), (2, 5.0, 0.5), (3, 5.0, 3.0)], "point_id long, lon double, lat double"), line, 0.6)
    assert {r.point_id: (r.owner, round(r.d, 6)) for r in near.collect()} == {0: (7, 0.3), 1: (8, 0.2), 2: (7, 0.5)}


def test_tables_of_names(spark):
    assert (len(rivers.GAUGED), len(rivers.FACTS), len(rivers.SEA_GROUPS), len(rivers.HISTORY), len(rivers.START_POINTS)) == (40, 40, 53, 25, 6)
    names = spark.createDataFrame([(" DONAU ",), ("Rhein",), ("Unknown ",), (None,)], "n string")
    assert [r.c for r in names.select(rivers.canonical(F.col("n")).alias("c")).collect()] == ["Danube", "Rhine", "Unknown", None]
    known = {r.n: r.length for r in rivers.with_facts(names, "n").collect()}
    assert known == {" DONAU ": None, "Rhein": 1230, "Unknown ": None, None: None}
    assert [r.year for r in rivers.history_until(spark, 1800).collect()] == [1717, 1681, 1600]
    assert g.grid_of(-25, 33, 62, 72, 8) == (28160, 13312, 16384, 13312)


@pytest.mark.parametrize(("term", "want"), [("48.2, 16.4", (48.2, 16.4)), ("48.2° 16.4", (48.2, 16.4)), ("-5;7°", (-5.0, 7.0)), ("91 3", None), ("1,2,3", None), ("a 3", None), ("1e5 2", None)])
def test_coordinates(term, want):
    assert search.coordinates(term) == want


def test_labels_keep_apart(spark):
    rows = [(0, 0, "Near", "town", 100.0, 100.0), (0, 1, "Nearer", "town", 110.0, 105.0), (0, 2, "Far", "town", 400.0, 300.0), (0, 3, "Out", "town", 2.0, 300.0), (1, 0, "Nearer", "town", 110.0, 105.0)]
    df = spark.createDataFrame(rows, "view long, place long, name string, kind string, px double, py double")
    assert sorted((r.view, r.name) for r in gazetteer.placed_labels(df, 800, 600).collect()) == [(0, "Far"), (0, "Near"), (1, "Nearer")]


def test_seas_and_comparison(spark):
    sea = spark.createDataFrame([(1, "Baltic Sea", [[{"lon": 18.0, "lat": 55.0}, {"lon": 20.0, "lat": 55.0}, {"lon": 20.0, "lat": 58.0}]])], "poly_id long, name string, rings array<array<struct<lon:double,lat:double>>>")
    at = spark.createDataFrame([(1, 20.5, 56.0, 1), (2, 40.0, 56.0, 1), (3, 1.0, 1.0, 4), (4, 1.0, 1.0, 2)], "basin_id long, lon double, lat double, cls int")
    got = {r.basin_id: (r.sea, r.sea_group) for r in basins.seas(at, sea).collect()}
    assert got == {1: ("Baltic Sea", "baltic"), 2: ("Inland sink", "endorheic"), 3: ("Beyond the map edge", "offmap"), 4: ("Inland lake", "lake")}
    two = spark.createDataFrame([(1, 10.0, 4.0), (2, 5.0, None)], "basin_id long, area double, discharge double")
    assert tuple(basins.compared(two, 1, 2).first()) == (2.0, 4.0) and basins.compared(two, 1, 9).count() == 0


def test_classes_and_blocks(spark):
    df = spark.createDataFrame([(True, True, True, True), (False, True, True, True), (False, True, True, False), (None, None, True, False), (False, False, False, False)], "o boolean, l boolean, i boolean, e boolean")
    assert [r.cls for r in rasters.classes(df, *map(F.col, "olie")).collect()] == [1, 4, 2, 5, 0]
    assert rasters.gradient(spark.createDataFrame([(0, 0, 5.0)], "x long, y long, z double"), 10).select("gx", "gy").first() == (0.0, 0.0)


def test_tables_of_loops_are_deleted(spark):
    one = cut(spark.range(3))
    where = one._thalweg_cut.removeprefix("file:")
    two = cut(one.select((F.col("id") + 1).alias("id")), one)
    assert not os.path.exists(where) and sorted(r.id for r in add(two, spark.range(1)).collect()) == [0, 1, 2, 3]
    drop(two)
    assert not os.path.exists(two._thalweg_cut.removeprefix("file:"))


def test_random_seeds_are_the_same_however_they_are_dealt(spark):
    a, b = (sorted(map(tuple, api.random_seeds(spark, 50, 1, 2, 3, 4, 5).repartition(n).collect())) for n in (1, 4))
    assert a == b and all(1 <= lon <= 3 and 2 <= lat <= 4 for _, lon, lat in a)
