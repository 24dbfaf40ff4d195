"""Climate, seasons, flood filling, reaches and tributaries against plain Python."""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions import hydraulics as h
from thalweg.functions import seasons as s
from thalweg.operators import climate, flood, flow, reaches
from thalweg.sources.stations import REGIMES

W = 20


def around(i):
    x, y = i % W, i // W
    return [(y + b) * W + x + a for a, b in zip(flood.DX, flood.DY) if 0 <= x + a < W and 0 <= y + b < W]


@pytest.mark.parametrize("tile", [5, 64])
def test_fill(spark, tile):
    rng = random.Random(3)
    z = [None if i == 210 else float(rng.randrange(30)) for i in range(W * W)]
    seed = [i % W in (0, W - 1) or i // W in (0, W - 1) for i in range(W * W)]
    level = {i: np.float32(z[i]) for i in range(W * W) if seed[i]}
    heap, done, eps = [(v, i) for i, v in level.items()], set(), np.float32(1e-3)
    heapq.heapify(heap)
    while heap:
        v, i = heapq.heappop(heap)
        if i in done:
            continue
        done.add(i)
        for j in around(i):
            if j not in done and z[j] is not None:
                new = np.float32(z[j]) if z[j] > v else np.float32(v + eps)
                if new < level.get(j, math.inf):
                    level[j] = new
                    heapq.heappush(heap, (new, j))
    cells = spark.createDataFrame([(i, i % W, i // W, z[i], seed[i]) for i in range(W * W)], "cell_id long, x long, y long, z double, seed boolean")
    got = {r.cell_id: r.filled for r in flood.fill(cells, tile=tile).collect()}
    assert got == {i: float(level[i]) if i in level else None for i in range(W * W)}
    assert flood.fill(cells.limit(0)).count() == 0


@pytest.fixture(scope="module")
def acc(spark):
    rng = random.Random(8)
    cells = spark.createDataFrame([(i, i % W, i // W, (2 * W - i % W - i // W) * 8 + rng.randrange(40), W) for i in range(W * W)], "cell_id long, x long, y long, z long, w long")
    edges = flow.cut(flow.d8(cells))
    return flow.cut(flow.accumulate(edges).join(edges, "cell_id"))


def test_extract(acc):
    rows = {r.cell_id: r for r in acc.collect()}
    net = {i for i, r in rows.items() if r.acc >= 3}
    degree = {i: sum(1 for k in net if rows[k].parent_id == i) for i in net}
    want = {}
    for head in net:
        if degree[head] != 1:
            path = [head]
            while rows[path[-1]].parent_id in net:
                path.append(rows[path[-1]].parent_id)
                if degree[path[-1]] != 1:
                    break
            if len(path) > 1:
                want[head] = path
    found = reaches.extract(acc, 3)
    got = {}
    for r in found.orderBy("reach_id", "pos").collect():
        got.setdefault(r.reach_id, []).append(r.cell_id)
    assert got == want
    for r in reaches.summarise(found, acc).collect():
        p = want[r.reach_id]
        assert (r.cells, r.head, r.tail, r.up, r.dn) == (len(p), p[0], p[-1], rows[p[0]].acc, rows[p[-1]].acc)


def test_upstream(spark, acc):
    rows = {r.cell_id: r for r in acc.collect()}
    outlet = max((i for i, r in rows.items() if r.parent_id is not None), key=lambda i: rows[i].acc)
    want, jobs = {}, [(outlet, 0)]
    while jobs:
        start, depth = jobs.pop(0)
        path = [start]
        while ups := sorted((i for i, r in rows.items() if r.parent_id == path[-1] and r.acc >= 2), key=lambda i: (-rows[i].acc, i)):
            jobs += [(i, depth + 1) for i in ups[1:]]
            path.append(ups[0])
        if len(path) > 1:
            want[start] = (depth, path)
    got = {}
    points = spark.createDataFrame([(outlet,), (outlet,)], "outlet_id long").distinct()
    for r in reaches.upstream(acc, points, 2).orderBy("path_id", "pos").collect():
        got.setdefault(r.path_id, (r.depth, []))[1].append(r.cell_id)
    assert got == want


def test_names(spark):
    probes = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (1, 3, "a"), (2, 0, "c"), (3, 0, None)], "reach_id long, seq int, name string")
    assert [tuple(r) for r in reaches.vote(probes).collect()] == [(1, "a", 2)]
    rows = [(1, 10, 20, 1.0, 5.0, None), (2, 20, 30, 8.0, 9.0, None), (3, 30, 40, 9.0, 12.0, "Main"), (4, 11, 20, 1.0, 2.0, None)]
    out = reaches.propagate(spark.createDataFrame(rows, "reach_id long, head long, tail long, up double, dn double, name string"))
    assert {r.reach_id: r.name for r in out.collect()} == {1: "Main", 2: "Main", 3: "Main", 4: None}


def test_seasons(spark):
    rows = [(800.0, 0.2, 6.0, 4.0, 12.0, 300.0), (1500.0, 0.0, 0.0, -6.0, 8.0, 900.0), (0.0, 0.5, 3.0, 20.0, 5.0, 0.0)]
    names = ("precip", "season_amp", "season_phase", "temp", "temp_amp", "runoff")
    got = s.seasons(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))).collect()
    for row in got:
        temp = [row.temp + row.temp_amp * math.cos(math.pi / 6 * (m - 6)) for m in range(12)]
        rain = [row.precip / 12 * (1 + row.season_amp * math.cos(math.pi / 6 * (m - row.season_phase))) for m in range(12)]
        snow = [p * min(1, max(0, (3 - t) / 4)) for p, t in zip(rain, temp)]
        pack = store = 0.0
        melt, out = [0.0] * 12, [0.0] * 12
        for m in list(range(12)) * 3:
            pack += snow[m]
            melt[m] = min(pack, max(0, temp[m]) * 3 * s.DAYS[m])
            pack -= melt[m]
        gross = [p - a + b for p, a, b in zip(rain, snow, melt)]
        for m in list(range(12)) * 3:
            store += gross[m]
            out[m], store = store * 0.58, store * 0.42
        run = [v * row.runoff / (sum(gross) or 1) for v in out]
        assert row.season.runoff == pytest.approx(run) and row.season.melt == pytest.approx(melt)
        assert row.season.snow_share == pytest.approx(sum(melt) / (sum(gross) or 1))
        assert row.season.frozen_months == [m for m in range(12) if temp[m] < -2]


def test_climate(spark):
    cells = spark.createDataFrame([(1, 16.4, 48.2, 170.0, "x"), (2, 8.0, 46.5, 3000.0, "y"), (3, None, 50.0, 10.0, "z"), (4, 30.0, 50.0, None, "q")], "id int, lon double, lat double, elev double, w string")
    got = {r.id: r for r in climate.interpolate(cells).collect()}
    for i in (1, 2, 4):
        r, st = got[i], climate.station_rows()
        w = [1 / (((r.lon - t[0]) * math.cos(math.radians(r.lat))) ** 2 + (r.lat - t[1]) ** 2 + 0.02) ** 1.6 for t in st]
        mean = lambda k: sum(a * t[k] for a, t in zip(w, st)) / sum(w)  # noqa: B023, E731
        elev = max(r.elev or 0.0, 0.0)
        assert r.precip == pytest.approx(min(6000, max(20, mean(3) * min(3.2, max(0.35, 1 + 0.00055 * (elev - mean(2)))))))
        assert r.temp == pytest.approx(mean(4) - 0.0065 * elev) and r.season_amp == pytest.approx(mean(6))
        assert 0 < r.runoff <= r.precip
    assert got[3].precip is None and got[1].w == "x"
    gauged = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "river string, discharge double")
    basins = spark.createDataFrame([("a", 3.0, 20.0), ("a", 1.0, 99.0), ("b", 1.0, 5.0), (None, 1.0, 1.0)], "river string, area double, discharge double")
    assert tuple(climate.score(basins, gauged).first()) == (2, 1.5, pytest.approx(math.log(2) / 2))
    row = spark.createDataFrame([(REGIMES["alpine"],)], "v array<double>").select(s.harmonic(F.col("v")).alias("h")).first()
    assert tuple(row.h) == pytest.approx(climate.first_harmonic(REGIMES["alpine"]))


def test_hydraulics(spark):
    df = spark.createDataFrame([(0.4, 0.01), (10.0, 0.001), (90000.0, 0.3), (5.0, None), (float("nan"), 0.01)], "a double, s double")
    got = df.select(h.velocity(F.col("a"), F.col("s")).alias("v"), h.size_class(F.col("a")).alias("c")).collect()

    def speed(a, sl):
        sl = 1e-3 if sl is None else sl
        a = 1.0 if math.isnan(a) else a
        if a < 1:
            return min(0.6, max(0.03, 1.2 * math.sqrt(sl)))
        return min(4, max(0.05, (0.3 * max(a * 300 / 31557.6, 0.01) ** 0.3) ** (2 / 3) * math.sqrt(sl) / 0.04))

    assert [r.v for r in got] == pytest.approx([speed(*r) for r in df.collect()])
    assert [r.c for r in got][:3] == ["Overland flow", "Stream", "Great river"]
    one = spark.range(1).select(
        h.distance_label(F.lit(1234.0)), h.distance_label(F.lit(999.4)), h.distance_label(F.lit(2845678.0)), h.duration_label(F.lit(7200.0)), h.duration_label(F.lit(0.0)),
        h.area_label(F.lit(0.25)), h.area_label(F.lit(801463.0)), h.coordinate_label(F.lit(-12.5), "lat"), h.slope_label(F.lit(0.00123)), h.discharge_label(F.lit(0.5)),
    ).first()
    assert tuple(one) == ("1.2 km", "999 m", "2,846 km", "2.0 h", "—", "25 ha", "801,463 km²", "12° 30′ 0.0″ S", "1.23 ‰", "500 l/s")
    ramp = spark.range(1).select(h.ramp("precip", F.lit(300.0)).alias("r"), h.ramp("snow", F.lit(9999.0)).alias("q"), h.decode_area(h.encode_area(F.lit(1.0))).alias("a")).first()
    assert tuple(ramp.r) == (209.0, 177.0, 89.0) and tuple(ramp.q) == (255.0, 255.0, 255.0) and ramp.a == 1.0
