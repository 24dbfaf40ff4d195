"""Tile stores, polygons with holes, lines simplified together, sets as runs, many terms, kept stages: against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg import api
from thalweg.operators import generalise, polygons, search, spans
from thalweg.sources import tiles, tilestore
from thalweg.stages import Store, digest


# -- tiles ----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Two by two tiles of 16 pixels, of which one is open sea; areas at half the resolution, elevation a zoom lower."""
    rng = random.Random(2)
    cells = {(x, y): (rng.randrange(9), 1 if x < 16 and y < 16 else 0, rng.random() * 1000, rng.uniform(-50, 900)) for x in range(32) for y in range(32)}
    for k, v in cells.items():
        if v[1] == 1:
            cells[k] = (0, *v[1:])
    df = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "px long, py long, dir int, cls int, acc double, z double")
    low = df.where("px % 2 = 0 and py % 2 = 0").select(F.shiftright("px", 1).alias("px"), F.shiftright("py", 1).alias("py"), "z")
    drawn = tiles.flow_tiles(df, 16).unionByName(tiles.area_tiles(df, 16)).unionByName(tiles.elevation_tiles(low, 16), allowMissingColumns=True)
    root = str(tmp_path_factory.mktemp("tiles") / "store")
    return root, tilestore.publish(drawn, root), cells


def test_published_tiles_and_their_manifest(spark, store):
    root, listed, _ = store
    assert {(r.layer, r.sx, r.sy) for r in listed.collect()} == {("flow", 0, 1), ("flow", 1, 0), ("flow", 1, 1), *(("acc", a, b) for a in (0, 1) for b in (0, 1)), ("elev", 0, 0)}
    assert {r.layer: r.tiles for r in tilestore.summary(listed).collect()} == {"flow": 3, "acc": 4, "elev": 1}
    tilestore.publish(spark.createDataFrame([("flow", 7, 7, tiles.encode_png(np.zeros((16, 16), np.uint8)))], "layer string, sx long, sy long, data binary"), root + "2")
    more = tilestore.publish(spark.createDataFrame([("flow", 7, 8, b"x"), ("flow", 7, 7, b"y")], "layer string, sx long, sy long, data binary"), root + "2")
    assert {(r.sx, r.sy, r.bytes) for r in more.collect()} == {(7, 7, 1), (7, 8, 1)}


def test_data_source_opens_only_the_tiles_asked_for(spark, store):
    root, _, cells = store
    got = {(r.px, r.py): r.v for r in tilestore.pixels(spark, root).where("layer = 'flow' and sx = 1 and sy >= 1").collect()}
    assert got == {k: v[0] + 16 * v[1] for k, v in cells.items() if k[0] >= 16 and k[1] >= 16}
    reader = tilestore.TileReader(root)
    left = list(reader.pushFilters([tilestore.EqualTo(("layer",), "flow"), tilestore.In(("sx",), (1, 5)), tilestore.EqualTo(("v",), 3)]))
    assert len(left) == 1 and [r for p in reader.partitions() for r in p.rows] == [("flow", 1, 0, "flow/1/0.png"), ("flow", 1, 1, "flow/1/1.png")]
    assert tilestore.pixels(spark, root).where("layer = 'none'").count() == 0


def test_probe_of_tiles(spark, store):
    root, _, cells = store
    broken = tilestore.stored(spark, root).withColumn("data", F.when(F.expr("layer = 'flow' and sx = 1 and sy = 0"), F.lit(b"no png")).otherwise(F.col("data")))
    points = [(i, x, y) for i, (x, y) in enumerate(cells)] + [(5000, 900, 900), (5001, -3, -3), (5002, None, 3), (5003, 20, 20), (5003, 20, 20)]
    got, failed = tilestore.probe(spark.createDataFrame(points, "drop_id long, px long, py long"), broken, 16)
    rows = got.collect()
    assert len(rows) == len(points) and [tuple(r) for r in failed.collect()] == [("flow", 1, 0)]
    step = {(r.sx, r.sy): (r.base, r.step) for r in tilestore.stored(spark, root).where("layer = 'elev'").collect()}[0, 0]
    for r in rows:
        if r.drop_id >= 5000:
            assert r.px == 20 or (r.dir, r.cls, r.area, r.elev) == ((None,) * 4 if r.px is None else (0, 1, 0.0, None))
            continue
        x, y = r.px, r.py
        lost = x >= 16 > y
        assert r.incomplete == lost and (r.dir, r.cls) == ((0, 1) if lost else cells[x, y][:2])
        v = max(min(255, max(0, int(math.log2(1 + cells[a, b][2]) * 11))) for a in (x & ~1, x | 1) for b in (y & ~1, y | 1))
        assert r.area == pytest.approx(2 ** (v / 11) - 1 if v else 0)
        assert abs(r.elev - cells[x & ~1, y & ~1][3]) <= step[1] / 2 + 1e-9


# -- polygons -------------------------------------------------------------------------------------------------------------
def parts_of(cells):
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            x, y = todo.pop()
            part.append((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(part)
    return out


def holes_of(part):
    """Parts of what is around, corners counting, that don't reach the outside."""
    xs, ys = [x for x, _ in part], [y for _, y in part]
    own = set(part)
    left = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)} - own
    n = 0
    while left:
        todo, outside = [left.pop()], False
        while todo:
            x, y = todo.pop()
            outside |= x < min(xs) or y < min(ys) or x > max(xs) or y > max(ys)
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (x + a, y + b) in left:
                        left.remove((x + a, y + b))
                        todo.append((x + a, y + b))
        n += not outside
    return n


def test_polygons_of_random_masks(spark):
    rng = random.Random(4)
    masks = {m: [(x, y) for x in range(14) for y in range(14) if rng.random() < 0.4 + 0.05 * m] for m in range(8)}
    rows = [(m, x, y) for m, cells in masks.items() for x, y in cells]
    got = polygons.polygons(spark.createDataFrame(rows + rows[:5], "mask_id long, px long, py long")).collect()
    for m, cells in masks.items():
        own = [r for r in got if r.mask_id == m]
        want = Counter((len(p), holes_of(p)) for p in parts_of(cells))
        assert Counter((r.cells, len(r.rings) - 1) for r in own) == want
        assert sum(r.border for r in own) == sum((x + a, y + b) not in set(cells) for x, y in cells for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        assert all(ring[0] == ring[-1] for r in own for ring in r.rings)


def test_islands_lie_in_holes(spark):
    frame = lambda a, b: [(x, y) for x in range(a, b) for y in range(a, b) if x in (a, b - 1) or y in (a, b - 1)]
    cells = frame(0, 11) + frame(2, 9) + [(5, 5), (20, 20)]
    got = {r.cells: r for r in polygons.polygons(spark.createDataFrame([(1, x, y) for x, y in cells], "mask_id long, px long, py long")).collect()}
    outer, inner = got[40], got[24]
    assert (outer.depth, outer.inside, inner.depth, inner.inside) == (0, None, 2, outer.part)
    singles = [r for r in polygons.polygons(spark.createDataFrame([(1, x, y) for x, y in cells], "mask_id long, px long, py long")).collect() if r.cells == 1]
    assert sorted((r.depth, r.inside) for r in singles if r.inside is not None) == [(4, inner.part)] and sorted(r.depth for r in singles) == [0, 4]


# -- lines ----------------------------------------------------------------------------------------------------------------
def crossed(p, q, r, s):
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1]))
    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def pairs_of(lines):
    seg = [(k, i, c[i], c[i + 1]) for k, c in lines.items() for i in range(len(c) - 1)]
    return {(min(a[0], b[0]), max(a[0], b[0])) for n, a in enumerate(seg) for b in seg[:n] if (a[0] != b[0] or abs(a[1] - b[1]) > 1) and crossed(a[2], a[3], b[2], b[3])}


def test_lines_that_run_side_by_side_don_t_cross(spark):
    """Waves close above each other, of different phase, which cross where each is thinned by itself."""
    rng = random.Random(6)
    lines = {k: [(x / 10, (0.02 if k < 4 else 3) * k + 0.3 * math.sin(x / 3) + rng.uniform(0, 0.015)) for x in range(120)] for k in range(12)}
    df = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in c], "n") for k, c in lines.items()], "line_id long, coords array<struct<lon:double,lat:double>>, name string")
    alone = {k: generalise.thinned(c, 0.2) for k, c in lines.items()}
    before = pairs_of(lines)
    assert pairs_of(alone) - before
    got = {r.line_id: [(p.lon, p.lat) for p in r.coords] for r in generalise.simplified(df, 0.2).collect()}
    assert not pairs_of(got) - before
    assert all(g[0] == lines[k][0] and g[-1] == lines[k][-1] and set(g) <= set(lines[k]) for k, g in got.items())
    assert sum(map(len, got.values())) < sum(map(len, lines.values())) / 2
    assert {(r.one, r.two) for r in generalise.crossings(df, 0.5).collect()} == before


def test_thinning_keeps_what_is_large():
    assert generalise.thinned([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], 0.5) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    assert generalise.thinned([(0, 0), (1, 9)], 5) == [(0, 0), (1, 9)]


# -- sets as runs ---------------------------------------------------------------------------------------------------------
def cells_of(df):
    return Counter((r.set_id, r.x, r.y) for r in spans.to_cells(df).collect())


def test_runs_of_sets(spark):
    rng = random.Random(3)
    a, b = ({(s, x, y) for s in range(3) for x in range(12) for y in range(9) if rng.random() < 0.5} for _ in range(2))
    one, two = (spans.from_cells(spark.createDataFrame(sorted(c) * 2, "set_id long, x long, y long")) for c in (a, b))
    assert cells_of(one) == Counter(a)
    for f, want in ((spans.union, a | b), (spans.difference, a - b), (spans.intersection, a & b)):
        got = f(one, two)
        assert cells_of(got) == Counter(want)
        assert got.count() == spans.from_cells(spark.createDataFrame(sorted(want), "set_id long, x long, y long")).count()  # as long as can be
    assert {r.set_id: (r.cells, r.x0, r.y0, r.x1, r.y1) for r in spans.sizes(one).collect()} == {s: (len(c := [k for k in a if k[0] == s]), min(k[1] for k in c), min(k[2] for k in c), max(k[1] for k in c), max(k[2] for k in c)) for s in range(3)}


def test_catchments_as_runs(spark):
    rng = random.Random(8)
    w, h = 15, 12
    to = {i: None if i % w == w - 1 else rng.choice([n for n in (i + 1, i + 1 + w, i + 1 - w, i + w) if 0 <= n < w * h]) for i in range(w * h)}
    outlets = rng.sample(range(w * h), 25) + [w - 1]
    want = Counter()
    for i in to:
        at = i
        while at is not None:
            if at in outlets:
                want[at, i % w, i // w] = 1
            at = to[at]
    cells = spark.createDataFrame([(i, p, i % w, i // w) for i, p in to.items()], "cell_id long, parent_id long, x long, y long")
    got = spans.catchments(cells, spark.createDataFrame([(o,) for o in outlets] * 2, "outlet_id long"))
    assert cells_of(got) == want


# -- many terms -----------------------------------------------------------------------------------------------------------
def test_many_terms_as_one_by_one(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(300)]
    rows = [(i, n, i % 5, i * 7 % 50 if i % 4 else None, float(i % 30), float(i % 20)) for i, n in enumerate(names)]
    entries = spark.createDataFrame(rows, "entry_id long, name string, rank long, size long, lon double, lat double").cache()
    terms = ["a", "ab", "É", "abc", " dc", "bca", "zzz", "", "aaaa", names[3]]
    got = search.search_many(entries, spark.createDataFrame([*enumerate(terms)], "term_id long, term string")).collect()
    for i, term in enumerate(terms):
        want = {tuple(r) for r in search.search(entries, term).where("part > 0").collect()}
        assert {tuple(r)[1:] for r in got if r.term_id == i} == want


# -- stages ---------------------------------------------------------------------------------------------------------------
def test_stages_run_once(spark, tmp_path):
    ran = []

    def doubled(df, by):
        ran.append(("doubled", by))
        return df.withColumn("v", F.col("v") * by)

    def summed(df):
        ran.append(("summed",))
        return df.agg(F.sum("v").alias("s"))

    def build(rows, by):
        ran.clear()
        kept = Store(spark, f"file://{tmp_path}/kept")
        one = kept.run("doubled", doubled, spark.createDataFrame(rows, "v long"), by=by)
        two = kept.run("summed", summed, one)
        return kept, one, two, two.table.first().s

    rows = [(1,), (2,), (3,)]
    assert build(rows, 2)[3] == 12 and len(ran) == 2
    kept, one, two, total = build(rows[::-1], 2)  # other order, same rows
    assert total == 12 and not ran and not one.ran and not two.ran
    assert build(rows, 3)[3] == 18 and ran == [("doubled", 3), ("summed",)]
    assert build([*rows, (9,)], 3)[3] == 45 and len(ran) == 2
    listed = kept.manifest().collect()
    assert Counter(r.name for r in listed) == {"doubled": 3, "summed": 3} and all(r.rows >= 1 and r.bytes > 0 for r in listed)
    assert {tuple(r.made_of) for r in listed if r.name == "summed"} == {(f"doubled/{r.key}",) for r in listed if r.name == "doubled"}
    assert kept.prune([one, two]) == 4
    assert build(rows, 2)[3] == 12 and not ran


def test_digest_tells_tables_apart(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k long, t string")
    assert digest(a) == digest(a.repartition(3)) and len({digest(a), digest(a.distinct()), digest(a.select("t", "k")), digest(a.limit(0)), digest(a.withColumnRenamed("t", "u"))}) == 5


def test_a_build_in_a_store_is_read_again(spark, tmp_path, monkeypatch):
    rows = [(y * 9 + x, x, y, (9 - x) * 10 + (x * 7 + y * 5) % 9, 9, 1 if x == 8 else 0) for x in range(9) for y in range(9)]
    cells = spark.createDataFrame(rows, "cell_id long, x long, y long, z long, w long, cls int")
    marine = spark.createDataFrame([], "poly_id long, name string, rings array<array<struct<lon:double,lat:double>>>")
    stages = ("hydro", "tiles", "rivers")
    kept = Store(spark, f"file://{tmp_path}/kept")
    one = api.build_all(cells, marine, stages, thresholds=(9.0, 3.0, 2.0), store=kept)
    monkeypatch.setattr(api, "build", lambda *a, **b: 1 / 0)
    two = api.build_all(cells, marine, stages, thresholds=(9.0, 3.0, 2.0), store=Store(spark, kept.root))
    assert all(sorted(map(str, one[s].collect())) == sorted(map(str, two[s].collect())) for s in stages)
    three = api._staged(cells, marine, stages, 8, 0, 0, 1.0, (9.0, 3.0), Store(spark, kept.root))
    assert [three[s].ran for s in stages] == [False, False, True]


# -- whole answers, basins and rivers to draw -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def grid(spark):
    """Two valleys side by side that run east to the sea, and a lake on the way of one."""
    w, h = 30, 9
    rows = []
    for y in range(h):
        for x in range(w):
            cls = 1 if x >= w - 2 else 2 if y == 2 and 14 <= x < 18 else 0
            rows.append((y * w + x, x, y, float((w - x) * 4 + abs(y % 4 - 2) * 30), w, cls))
    cells = spark.createDataFrame(rows, "cell_id long, x long, y long, z double, w long, cls int")
    return api.build(cells)


def test_report_of_a_drop(spark, grid):
    engine = api.Engine(grid, 8, 36352, 19968)
    at = grid.where("cell_id in (63, 155, 91)").select(F.col("cell_id").alias("drop_id"), "x", "y")
    points = engine._located(at).select("drop_id", "lon", "lat")
    got = {r.drop_id: r for r in engine.report(points).collect()}
    traced, alone = engine.named(engine.trace(points)), {}
    for r in engine.analyse(traced).collect():
        alone[r.drop_id] = r
    assert set(got) == {63, 155, 91}
    for k, r in got.items():
        assert all(getattr(r, c) == pytest.approx(getattr(alone[k], c)) for c in ("distance", "seconds", "fall", "discharge"))
        assert r.stages[0].kind == "rain" and r.stages[-1].kind == "sea" and r.stages[-1].label == r.destination
        assert not r.truncated and r.terminal == 1 and r.lon0 < r.lon1


def test_one_pass_over_paths_as_several(spark):
    from thalweg.operators import paths

    rng = random.Random(12)
    rows, area = [], 0.0
    for d in range(5):
        area = 10.0
        for s in range(rng.randint(1, 60)):
            area += rng.choice([0, 1, 5, 40, 90])
            rows.append((d, s, 300.0 * s, area, 500.0 - s, 10 + s / 100, 50 + d / 10, rng.choice(["A", "B", None])))
    df = spark.createDataFrame(rows, "drop_id long, step long, dist double, area double, elev double, lon double, lat double, country string")
    got = {r.drop_id: r for r in paths.analysed(df).collect()}
    for r in paths.travel(df).collect():
        assert all(getattr(got[r.drop_id], c) == pytest.approx(getattr(r, c)) for c in r.asDict())
    want = {}
    for r in sorted(paths.tributaries(df).collect(), key=lambda r: r.rank):
        want.setdefault(r.drop_id, []).append((r.step, r.gain, r.lon))
    assert {k: [(t.step, t.gain, t.lon) for t in r.tributaries] for k, r in got.items() if r.tributaries} == want
    for d, r in got.items():
        assert r.countries == [*dict.fromkeys(x[7] for x in rows if x[0] == d and x[7])]


def test_basins_as_polygons(spark, grid):
    from thalweg.operators import basins

    table = grid.groupBy(F.col("term").alias("basin_id")).agg(F.count(F.lit(1)).cast("double").alias("area")).withColumn("name", F.concat(F.lit("Basin "), "basin_id"))
    got = basins.polygons(grid, table, 8, 36352, 19968, 1, 20, 0.0).collect()
    sizes = {r.basin_id: r.area for r in table.collect() if r.area >= 20}
    sums = Counter()
    for r in got:
        sums[r.basin_id] += r.cells
        assert r.name == f"Basin {r.basin_id}" and r.sea is None
    assert dict(sums) == sizes and [r.area for r in got] == sorted((r.area for r in got), reverse=True)
    lines = tiles.to_geojson(basins.polygons(grid, table, 8, 36352, 19968, 1, 20), ["basin_id", "name", "area"]).collect()
    assert lines and all('"type":"Polygon"' in r.value for r in lines)


def test_river_layers(spark, grid):
    from thalweg.operators import reaches

    got = reaches.layers(grid, (20.0, 5.0), (0.02, 0.001), 8, 36352, 19968).collect()
    assert {r.lod for r in got} == {0, 1}
    plain = {(0 if t == 20.0 else 1, r.reach_id): r.cells for t in (20.0, 5.0) for r in reaches.summarise(reaches.extract(grid.select("cell_id", "parent_id", "acc"), t), grid).collect()}
    assert {(r.lod, r.line_id) for r in got} == set(plain)
    assert all(2 <= len(r.coords) <= plain[r.lod, r.line_id] for r in got)
