"""Shapes, tiles, journeys, search, the API and streams."""

from __future__ import annotations

import json
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thalweg import api
from thalweg.functions import geodesy as g
from thalweg.operators import journeys, search, shapes
from thalweg.sources import tiles
from thalweg.streaming.drops import destinations

RINGS = "array<array<struct<lon:double,lat:double>>>"


def test_polygons_and_nearest(spark):
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    polys = spark.createDataFrame([(1, [square(0.0, 0.0, 10.0), square(4.0, 4.0, 2.0)]), (2, [square(3.0, 3.0, 9.0)]), (3, []), (4, None)], f"poly_id long, rings {RINGS}")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 11.0), (4, 50.0, 1.0), (5, None, 1.0)], "point_id long, lon double, lat double")
    assert {r.point_id: r.poly_id for r in shapes.point_in_polygon(points, polys).collect()} == {1: 1, 2: 2, 3: 2, 4: None, 5: None}
    cut = {r.poly_id: [[tuple(p) for p in ring] for ring in r.rings] for r in shapes.clip(polys, 0, 0, 2, 5).collect()}
    assert set(cut) == {1} and set(cut[1][0]) == {(0, 0), (2, 0), (2, 5), (0, 5)}
    rng = random.Random(1)
    verts = [(i // 3, i % 3, rng.uniform(0, 4), rng.uniform(48, 52), float(i + 1), float(2 * i + 1)) for i in range(90)]
    spots = [(i, rng.uniform(0, 4), rng.uniform(48, 52), rng.uniform(1, 80)) for i in range(40)]
    v = spark.createDataFrame(verts, "owner long, seq long, lon double, lat double, up double, dn double")
    p = spark.createDataFrame(spots, "point_id long, lon double, lat double, area double")

    def dist(a, b):
        return math.hypot((b[2] - a[1]) * math.cos(math.radians(a[2])), b[3] - a[2])

    def least(a, score):
        return min(((score(a, b), b[0]) for b in verts if dist(a, b) <= 0.4), default=(None, None))[1]

    assert {r.point_id: r.owner for r in shapes.nearest(p, v, 0.4).collect()} == {a[0]: least(a, dist) for a in spots}
    value = lambda a, b: (dist(a, b) + 0.032) * (1 + 1.6 * abs(math.log(max(1, (b[4] + b[5]) / 2) / a[3])))
    assert {r.point_id: r.owner for r in shapes.best_near(p, v, 0.4).collect()} == {a[0]: least(a, value) for a in spots}


def test_rings_and_lines(spark):
    cells = [(1, 1000 + x, 800 + y) for x in range(6) for y in range(6) if (x, y) not in ((2, 2), (3, 2), (2, 3), (3, 3))] + [(2, 5, 5)]
    masks = spark.createDataFrame(cells + cells[:3], "mask_id long, px long, py long")
    out = shapes.rings(masks, tolerance=1e-9).orderBy("mask_id", "ring").collect()
    assert [(r.mask_id, r.ring, len(r.coords)) for r in out] == [(1, 0, 5), (1, 1, 5)]
    assert all(r.coords[0] == r.coords[-1] for r in out)
    line = np.array([(0, 0), (1, 0.001), (2, 0), (3, 5), (4, 0)], float)
    assert shapes.simplify_line(line, 0.1).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]
    df = spark.createDataFrame([(1, [tuple(p) for p in line.tolist()]), (2, None), (3, [])], "id int, coords array<struct<lon:double,lat:double>>")
    got = {r.id: r.coords for r in shapes.simplify(df, 0.1).collect()}
    assert len(got[1]) == 4 and got[2] is None and got[3] == []


def test_png(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (tiles.decode_png(tiles.encode_png(image)) == image).all()
    with pytest.raises(ValueError):
        tiles.decode_png(b"nothing")
    # every filter of the format, written by its definition
    lines, above = b"", np.zeros(15, int)
    for y in range(7):
        row, kind = image[y].reshape(-1).astype(int), y % 5
        left, corner = np.r_[0, 0, 0, row[:-3]], np.r_[0, 0, 0, above[:-3]]
        paeth = [min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left, above, corner)]
        lines += bytes([kind]) + bytes(((row - (0, left, above, (left + above) // 2, np.array(paeth))[kind]) & 255).astype(np.uint8))
        above = row
    made = tiles.SIGNATURE + tiles._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 2, 0, 0, 0)) + tiles._chunk(b"IDAT", zlib.compress(lines)) + tiles._chunk(b"IEND", b"")
    assert (tiles.decode_png(made) == image).all()
    cells = spark.createDataFrame([(x, y, (x + y) % 9, 1 if x < 8 else 2, float(x * y), float(x * 10)) for x in range(24) for y in range(8)], "px long, py long, dir int, cls int, acc double, z double")
    back = {(r.px, r.py): r.v for r in tiles.read_tiles(tiles.flow_tiles(cells, 8)).collect()}
    assert back == {(x, y): (x + y) % 9 + 16 * (1 if x < 8 else 2) for x in range(24) for y in range(8)}
    assert tiles.flow_tiles(cells.withColumn("dir", F.lit(0)), 8).count() == 2
    area = {(r.px, r.py): r.v for r in tiles.read_tiles(tiles.area_tiles(cells, 8)).collect()}
    assert area[(5, 3)] == int(math.log2(1 + 11 * 7) * 11)
    elev = tiles.elevation_tiles(cells, 8).orderBy("sx").collect()
    assert [(r.base, r.step) for r in elev] == [(0, 70 / 250), (80, 70 / 250), (160, 70 / 250)]
    rgb = np.zeros((2, 2, 3), np.uint8)
    rgb[0, 1] = (128, 10, 128)
    t = spark.createDataFrame([(3, 0, tiles.encode_png(rgb))], "tx long, ty long, data binary")
    assert {(r.px, r.py): r.z for r in tiles.terrain(t).collect()} == {(6, 0): -12000, (7, 0): 10.5, (6, 1): -12000, (7, 1): -12000}


def test_geojson(spark, tmp_path):
    features = [
        {"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[2, 2], [3, 2], [3, 3]]]]}, "properties": {"name": "Ré"}},
        {"geometry": None, "properties": {}}, {"geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": None},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"features": features}))
    rows = tiles.read_geojson(spark, str(tmp_path / "a.json"))
    assert sorted((r.feature, r.type, r.name, len(r.rings[0])) for r in rows.collect()) == [(0, "Polygon", "Ré", 3)] * 2 + [(2, "Point", None, 1)]
    one = json.loads(tiles.to_geojson(rows.where("name = 'Ré'"), ["name"]).first().value)
    assert one["properties"] == {"name": "Ré"} and one["geometry"]["coordinates"][0][1][1] == 0.0


def test_journey(spark):
    n = 40
    river = ["A"] * 10 + [None] + ["A"] * 5 + ["B"] + ["A"] * 5 + ["C"] * 18
    path = [(7, i, i * 1000.0, 200.0 + i, 500.0 - i, 2 if 30 <= i <= 33 or i in (36, 37, 38) else 0, river[i], "L" if i in (30, 36) else None, "X" if i < 20 else "Y", "Black Sea", "sea") for i in range(n)]
    df = spark.createDataFrame(path, "drop_id long, step long, dist double, area double, elev double, cls int, river string, lake string, country string, destination string, destination_kind string")
    got = [(r.label, r.kind, r.from_m, r.to_m, r.countries) for r in journeys.journey(df).orderBy("stage").collect()]
    assert [v[:2] for v in got] == [("Rainfall", "rain"), ("A", "river"), ("C", "river"), ("L", "lake"), ("Black Sea", "sea")]
    assert got[1][2:4] == (0.0, 21000.0) and got[1][4] == ["X", "Y"] and got[3][2:4] == (29000.0, 38000.0)
    t = journeys.travel(df).first()
    assert t.distance == 39000 and t.seconds > 0 and t.max_elev - t.min_elev == 39 and t.final_area == 239
    few = spark.createDataFrame([(1, i, float(i), a, n) for i, (a, n) in enumerate(zip([1.0, 1.0, 1.0, 0.5], ["a", "b", "a", None]))], "drop_id long, step long, dist double, area double, river string")
    runs = journeys.absorbed(journeys.river_runs(few), F.col("n") == 1)
    assert [(r.label, r.first, r.last) for r in runs.orderBy("first").collect()] == [("a", 0, 2), (None, 3, 3)]
    assert journeys.journey(df.limit(0)).count() == 0


def fold(runs, small):
    """Runs (label, first, last, n, from, to) read one by one; a small one between two of one label joins them."""
    out = []
    for k, r in enumerate(runs):
        if 0 < k < len(runs) - 1 and small(r) and out[-1][0] == runs[k + 1][0] or out and out[-1][0] == r[0]:
            out[-1] = (out[-1][0], out[-1][1], r[2], out[-1][3] + r[3], out[-1][4], r[5])
        else:
            out.append(r)
    return out


def tell(rows):
    """The stages of one path, row by row. rows: dist, area, elev, cls, river, lake, country."""
    names, held = [], None
    for i, r in enumerate(rows):
        held = r["river"] or (held if i and r["area"] >= 0.9 * rows[i - 1]["area"] else None)
        names.append(held)
    runs = fold([(n, i, i, 1, rows[i]["dist"], rows[i]["dist"]) for i, n in enumerate(names)], lambda r: False)
    for small in (lambda r: r[3] == 1, lambda r: r[3] == 1, lambda r: r[5] - r[4] < 25000):
        runs = fold(runs, small)
    river = [label for label, a, b, *_ in runs for _ in range(a, b + 1)]
    wet = [r["cls"] == 2 for r in rows]
    inside, last, i = [False] * len(rows), None, 0
    while i < len(rows):
        j = i
        while j < len(rows) and wet[j] == wet[i]:
            j += 1
        if wet[i] and rows[j - 1]["dist"] - rows[i]["dist"] >= 2000:
            if last is not None and rows[i - 1]["dist"] - rows[last]["dist"] < 40000:
                same = rows[last]["lake"] and rows[last]["lake"] == rows[i]["lake"]
                if rows[i]["dist"] - rows[last]["dist"] < 8000 or same:
                    inside[last:i] = [True] * (i - last)
            inside[i:j], last = [True] * (j - i), j - 1
        i = j
    lake = [r["lake"] for r in rows]
    for i in range(1, len(rows)):
        lake[i] = lake[i] or (lake[i - 1] if inside[i] else None)
    for i in range(len(rows) - 2, -1, -1):
        lake[i] = lake[i] or (lake[i + 1] if inside[i] else None)
    sizes = ((0.5, "Overland flow"), (5, "Headwater stream"), (50, "Stream"), (500, "Small river"), (5000, "River"), (50000, "Major river"), (float("inf"), "Great river"))
    out = [["Rainfall", "rain", None, 0.0, 0.0, 0.0, [rows[0]["country"]]]]
    for i, r in enumerate(rows):
        name = lake[i] if inside[i] else river[i]
        label = name or ("Lake" if inside[i] else next(n for b, n in sizes if r["area"] < b))
        fall = max(0.0, rows[i - 1]["elev"] - r["elev"]) if i else 0.0
        if len(out) == 1 or out[-1][0] != label:
            out.append([label, "lake" if inside[i] else "overland" if r["area"] < 0.5 else "stream" if r["area"] < 50 else "river", name, rows[i - 1]["dist"] if i else 0.0, 0.0, 0.0, []])
        out[-1][4], out[-1][5], out[-1][6] = r["dist"], out[-1][5] + fall, out[-1][6] + [r["country"]]
    out.append(["the sea", "sea", None, rows[-1]["dist"], rows[-1]["dist"], 0.0, [rows[-1]["country"]]])
    told = []
    for s in out:
        if told and (told[-1][0] == s[0] or s[4] - s[3] < 1500 and s[1] not in ("sea", "rain") and not s[2]):
            told[-1][4], told[-1][5] = s[4], told[-1][5] + s[5]
        else:
            told.append(s)
    told = [s for k, s in enumerate(told) if k in (0, len(told) - 1) or s[4] - s[3] > 2500 or s[1] == "lake"]
    return [(a, b, c, d, e, round(f, 6), list(dict.fromkeys(x for x in g if x))) for a, b, c, d, e, f, g in told]


def test_journeys_against_a_walk_along_the_rows(spark):
    rng, paths = random.Random(4), {}
    for d in range(25):
        rows, dist, area, river, country, wet, lake = [], 0.0, rng.choice([0.2, 3.0, 30.0, 300.0]), None, "X", 0, None
        for _ in range(rng.randint(1, 90)):
            if rng.random() < 0.3:
                river = rng.choice(["A", "B", None])
            if rng.random() < 0.1:
                country = rng.choice(["X", "Y", None])
            if rng.random() < 0.2:
                wet, lake = rng.choice([0, 2]), rng.choice(["L", "M", None])
            rows.append({"dist": dist, "area": area, "elev": rng.uniform(0, 900), "cls": wet, "river": river, "lake": lake if wet and rng.random() < 0.6 else None, "country": country})
            dist += rng.choice([300.0, 900.0, 4000.0])
            area *= rng.choice([1.0, 1.0, 1.2, 0.85])
        paths[d] = rows
    schema = "drop_id long, step long, dist double, area double, elev double, cls int, river string, lake string, country string, destination string, destination_kind string"
    df = spark.createDataFrame([(d, i, r["dist"], r["area"], r["elev"], r["cls"], r["river"], r["lake"], r["country"], "the sea", "sea") for d, rows in paths.items() for i, r in enumerate(rows)], schema)
    got = {}
    for r in journeys.journey(df).orderBy("drop_id", "stage").collect():
        got.setdefault(r.drop_id, []).append((r.label, r.kind, r.name, r.from_m, r.to_m, round(r.fall, 6), r.countries))
    for d, rows in paths.items():
        assert got[d] == tell(rows), d


@pytest.fixture(scope="module")
def engine(spark):
    w, rng = 16, random.Random(2)
    rows = [(i, i % w, i // w, (2 * w - i % w - i // w) * 8 + rng.randrange(30), w, 1 if i % w == w - 1 else 0, "x") for i in range(w * w)]
    cells = spark.createDataFrame(rows, "cell_id long, x long, y long, z long, w long, cls int, note string")
    return api.Engine(api.build(cells), 8, 36000, 20000)


def test_api(spark, engine):
    at = spark.createDataFrame([(1, 3, 3), (2, 9, 4), (3, 90, 4)], "drop_id long, x long, y long")
    points = at.select("drop_id", g.pixel_to_lon(F.col("x") + 36000.5, 8).alias("lon"), g.pixel_to_lat(F.col("y") + 20000.5, 8).alias("lat"))
    assert sorted(tuple(r) for r in engine.locate(points).collect()) == [(1, 51), (2, 73)]
    path = engine.trace(points)
    rows = path.where("drop_id = 1").orderBy("step").collect()
    assert [r.step for r in rows] == list(range(len(rows))) and rows[0].dist == 0
    assert all(a.elev >= b.elev and a.dist < b.dist for a, b in zip(rows, rows[1:]))
    ends = {r.cell_id: r for r in engine.cells.collect()}
    assert ends[51].term == rows[-1].cell_id
    shed = {r.drop_id: r for r in engine.watershed(points).collect()}
    assert {k: r.cells for k, r in shed.items()} == {1: ends[51].acc, 2: ends[73].acc}
    assert {r.drop_id: r.inside for r in engine.point(points).collect()} == {1: True, 2: True, 3: False}
    assert engine.analyse(path).count() == 2 and engine.rain(points).where("step % 3 <> 0").count() == 0
    snapped = {r.drop_id: r.cell_id for r in engine.locate(points, 3).collect()}
    assert set(snapped) == {1, 2} and ends[snapped[1]].acc >= ends[51].acc
    assert engine.health().first().cells == 256 and engine.basins(5).count() == 5
    with pytest.raises(ValueError):
        engine.basins(0)
    assert api.read_fragment("#d=1.5,48.25&t=dark&o=snow") == {"drop": (1.5, 48.25), "theme": "dark", "overlay": "snow"}
    assert api.write_fragment(1.5, 48.25, "dark", "snow") == "d=1.5000,48.2500&t=dark&o=snow" and api.read_fragment("t=odd") == {}


def test_overlay(spark):
    cols = "elev double, precip double, season_amp double, season_phase double, temp double, temp_amp double, runoff double, area double, slope_degrees double"
    df = spark.createDataFrame([(100.0, 800.0, 0.2, 1.0, -5.0, 5.0, 300.0, 1000.0, 16.0), (-50.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0), (None,) * 9], cols)
    for kind in ("precip", "snow", "runoff", "flowacc", "elevation", "slope"):
        rows = api.overlay(df, kind, 1, True).collect()
        assert rows[0].alpha > 0 and len(rows) == 3
        if kind not in ("elevation",):
            assert rows[1].alpha == 0
    slope = api.overlay(df, "slope").first()
    assert (slope.r, slope.g, slope.b, slope.alpha) == (142.5, 125, 155, 155)


def test_search(spark):
    rows = [("Łódź", 2, 600, 19.4, 51.7), ("Lodz", 3, 10, 1.0, 1.0), ("Rhône", 1, 90, 4.8, 44.0), ("Le Rhône", 1, 90, 4.8, 44.0), ("Rhône", 1, 80, 4.83, 44.03), (None, 1, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "name string, rank int, size long, lon double, lat double")
    assert [(r.part, r.name) for r in search.search(df, "RHONE").orderBy("part", "place").collect()] == [(1, "Rhône"), (2, "Le Rhône")]
    assert search.fold("Łódź") == "łodz" and search.search(df, " ").count() == 0
    assert [tuple(r) for r in search.search(df, "48.2, 16.4").collect()] == [(0, 1, "48.2, 16.4", 16.4, 48.2)]


def test_stream(spark, engine, tmp_path):
    pd.DataFrame({"drop_id": [1, 2], "cell_id": [51, 9999]}).to_parquet(tmp_path / "a.parquet")
    drops = spark.readStream.schema("drop_id long, cell_id long").parquet(str(tmp_path))
    run = destinations(drops, engine.cells).writeStream.format("memory").queryName("ends").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.drop_id: r.basin_id is not None for r in spark.table("ends").collect()} == {1: True, 2: False}
