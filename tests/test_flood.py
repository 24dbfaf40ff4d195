"""Filling against sweeps over the whole grid, in tiles of several sizes; winding channels; tiles that are flooded again."""

from __future__ import annotations

import time

import numpy as np
import pytest

from thalweg.operators import flood


def swept(z, seed, eps=1e-3):
    """The least fixed point, by sweeps until nothing moves. NaN: no cell."""
    eps, (h, w) = np.float32(eps), z.shape
    level = np.where(seed, z, np.float32(np.inf)).astype("float32")
    while True:
        before = level.copy()
        for dx, dy in zip(flood.DX, flood.DY, strict=True):
            here = slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx))
            there = slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx))
            v = level[there]
            level[here] = np.where(seed[here] | np.isnan(z[here]), level[here], np.minimum(level[here], np.where(z[here] > v, z[here], v + eps)))
        if (level == before).all():
            return level


def filled(spark, z, seed, **more):
    h, w = z.shape
    rows = [(y * w + x, x, y, None if np.isnan(z[y, x]) else float(z[y, x]), bool(seed[y, x]) or None) for y in range(h) for x in range(w)]
    got = flood.fill(spark.createDataFrame(rows, "cell_id long, x long, y long, z double, seed boolean"), **more).collect()
    out = np.full(z.shape, np.inf, "float32")
    for r in got:
        out[r.cell_id // w, r.cell_id % w] = np.inf if r.filled is None else r.filled
    assert len(got) == z.size
    return out


@pytest.mark.parametrize("v", [0.0, 0.5, 1.0, -3.2, 1000.7, 0.0021, -0.0015, 8191.9])
def test_raised_as_by_single_steps(v):
    eps, v = float(np.float32(1e-3)), float(np.float32(v))
    for k in (0, 1, 2, 7, 100, 3000):
        w = np.float32(v)
        for _ in range(k):
            w = w + np.float32(eps)
        assert float(w) == flood.raised(v, k, eps)


def terrains():
    rng = np.random.RandomState(4)
    rough, gentle, lakes = rng.randint(0, 40, (33, 29)), np.cumsum(rng.randint(0, 2, (33, 29)), 1) / 256, rng.choice([0, 0, 0, 3, 9], (33, 29))
    for z in (rough, gentle, lakes):
        z = z.astype("float32")
        seed = np.zeros(z.shape, bool)
        seed[:, -1] = True
        seed[10:12, 5] = True
        yield z, seed
    holes = rough.astype("float32")
    holes[rng.rand(*holes.shape) < 0.3] = np.nan  # some cells are cut off
    seed = np.zeros(holes.shape, bool)
    seed[0] = ~np.isnan(holes[0])
    yield holes, seed
    yield np.zeros((20, 20), "float32"), np.zeros((20, 20), bool)  # no seed


@pytest.mark.parametrize("case", range(5))
def test_filling_in_tiles(spark, case):
    z, seed = list(terrains())[case]
    want = swept(z, seed)
    assert (filled(spark, z, seed, tile=8, piece=2) == want).all()


def winding(n):
    """A channel of one cell that goes to and fro over the grid, between walls; its mouth is the only seed."""
    z = np.full((n, n), 100, "float32")
    z[1::2, 1:-1] = 0
    for i, y in enumerate(range(2, n - 2, 2)):
        z[y, -2 if i % 2 == 0 else 1] = 0
    seed = np.zeros(z.shape, bool)
    seed[1, 1] = True
    return z, seed


def test_winding_channel_takes_few_passes(spark, monkeypatch):
    """Over a hundred borders of tiles: the graph has the channel's levels after the first flood, if not before."""
    turns = []
    plain = flood._graph
    monkeypatch.setattr(flood, "_graph", lambda *a: turns.append(1) or plain(*a))
    z, seed = winding(49)
    got = filled(spark, z, seed, tile=16, piece=8)
    assert (got == swept(z, seed)).all() and len(turns) <= 3


def test_long_channel_in_one_tile():
    """A tile of 256 by 256 cells whose channel is over 30,000 cells long."""
    import pandas as pd

    z, seed = winding(257)
    y, x = np.indices(z.shape)
    t = flood._Tile(pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": z.ravel()}))
    at, began = t.at.tolist(), time.time()
    free = [False] * t.n
    for i, s in zip(at, seed.ravel().tolist(), strict=True):
        free[i] = not s
    level, _ = flood._levels(t, {at[257 + 1]: 0.0}, free, float(np.float32(1e-3)))
    assert time.time() - began < 20
    steps, todo = {257 + 1: 0}, [257 + 1]
    for c in todo:  # breadth first
        for n in (c + a + b * 257 for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if z.flat[n] == 0 and n not in steps:
                steps[n] = steps[c] + 1
                todo.append(n)
    eps = float(np.float32(1e-3))
    assert max(steps.values()) > 30_000
    assert all(level[at[c]] == flood.raised(0.0, n, eps) for c, n in list(steps.items())[::500])
