"""Filling depressions: the least levels from which water always finds a way down to a seed.

Passes over the tiles of a grid, and a small graph between them:

- a tile is flooded from its rim and its seeds, lowest cell first. A cell that water reaches from the rim keeps the rim
  cell it came from (its root), and the level it takes as a function of the root's: max(c, the root's raised k times by eps);
- rim cells are the nodes of a graph; roots that meet, rim cells and their roots, and neighbours across a border are its edges:
  functions of the same form. Its least levels are found by Dijkstra's algorithm, in pieces of PIECE by PIECE tiles, again while
  levels move across the borders of pieces;
- these are levels of true ways to a seed, so no least level is above them. With them on the rims each tile is flooded for
  good. Where a rim cell ends lower (its shortest way through a lake or flat is not by the roots), that way is a new edge. The
  graph is solved again, and tiles beside a rim that moved are flooded again.

Ways of all tiles are mended at once, so passes follow neither the length of a river nor the tiles that it crosses: mostly one,
two or three. Levels are float32, and raising by eps rounds at each step, as the definition does."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import add, cut, drop

DX = (1, 1, 0, -1, -1, -1, 0, 1)
DY = (0, 1, 1, 1, 0, -1, -1, -1)
#: Tiles along a side of a piece of the graph; the root of what a seed floods; a way that does not depend on its start.
PIECE, SEED, FIXED = 8, -1, -1
_INF = float("inf")


def _next(v: float, eps: float) -> float:
    return float(np.float32(v) + np.float32(eps))


def raised(v: float, k: int, eps: float) -> float:
    """v after eps is added k times in float32. Between two powers of two each addition adds the same."""
    while k > 0 and math.isfinite(v):
        u = _next(v, eps)
        d = u - v
        if d == 0:
            return v
        e = math.frexp(v)[1]
        edge = math.ldexp(1, e) if v > 0 else -math.ldexp(1, e - 1) if v < 0 else 0
        n = min(k, int((edge - v) / d) - 1)
        if n > 1 and _next(u, eps) - u == d:
            v, k = v + n * d, k - n
        else:
            v, k = u, k - 1
    return v


class _Tile:
    """The cells of a tile (and of the rims around it) as lists; absent ones have no z."""

    def __init__(self, rows: pd.DataFrame):
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        self.wide = int(x.max() - x.min()) + 3  # an empty border, so that every cell has eight neighbours
        self.at = (y - y.min() + 1) * self.wide + x - x.min() + 1
        n = self.wide * (int(y.max() - y.min()) + 3)
        z = np.full(n, np.nan, "float32")
        z[self.at] = rows["z"].to_numpy("float32")
        self.z, self.n = z.tolist(), n
        self.around = [dy * self.wide + dx for dx, dy in zip(DX, DY)]


def _levels(tile: _Tile, start: dict[int, float], free: list[bool], eps: float) -> tuple[list[float], list[int]]:
    """Least levels of the free cells, from those that start with one, and the cell that each has its level from."""
    level, source = [_INF] * tile.n, [-1] * tile.n
    for i, v in start.items():
        level[i] = v
    heap = [(v, i) for i, v in start.items()]
    heapq.heapify(heap)
    z, around = tile.z, tile.around
    while heap:
        v, i = heapq.heappop(heap)
        if v > level[i]:
            continue
        up = None
        for o in around:
            j = i + o
            if free[j] and level[j] > v:
                new = z[j]
                if new <= v:
                    up = new = _next(v, eps) if up is None else up
                if new < level[j]:
                    level[j], source[j] = new, i
                    heapq.heappush(heap, (new, j))
    return level, source


def _way(tile: _Tile, source: list[int], i: int, eps: float) -> tuple[int, float, int]:
    """Where the level of a cell comes from, and what it is of the level there: c and k."""
    cells = []
    while source[i] >= 0:
        cells.append(i)
        i = source[i]
    c = -_INF
    for j in reversed(cells):
        c = max(tile.z[j], _next(c, eps)) if c > -_INF else tile.z[j]
    return i, c, len(cells)


def _roots(rows: pd.DataFrame, eps: float) -> pd.DataFrame:
    """One tile: cell_id, x, y, z, seed, rim, gx, gy. Rows of kind 0: its rim cells with root, c, k and r (the way back: from
    a level at the cell to one at the root, max(r, raised k times)); of kind 1: edges from the root in cell_id to `root`."""
    t = _Tile(rows)
    ids, at = rows["cell_id"].tolist(), t.at.tolist()
    cell = dict(zip(at, ids))
    seed, rim = rows["seed"].tolist(), rows["rim"].tolist()
    z, n = t.z, t.n
    root: list[int | None] = [None] * n
    c, k, r, level = [-_INF] * n, [0] * n, [-_INF] * n, [_INF] * n
    heap = []
    for i, s, edge in zip(at, seed, rim):
        if s or edge:
            level[i] = z[i]
            heap.append((z[i], not s, i))
        if s:
            root[i], c[i], k[i] = SEED, z[i], FIXED
    sown = {i for i, s in zip(at, seed) if s}
    heapq.heapify(heap)
    best: dict[tuple[int, int], list[tuple[float, int]]] = {}

    def edge(q: int, p: int) -> None:
        """From the root of q by q and p to the root of p."""
        via = max(z[p], _next(c[q], eps)) if c[q] > -_INF else z[p]
        way = max(r[p], raised(via, k[p], eps)), FIXED if k[q] == FIXED else k[q] + 1 + k[p]
        known = best.setdefault((root[q], root[p]), [way, way])
        known[0], known[1] = min(known[0], way), min(known[1], way, key=lambda e: e[::-1])

    done = [False] * n
    while heap:
        v, _, i = heapq.heappop(heap)
        if done[i]:
            continue
        done[i] = True
        if root[i] is None:
            root[i] = cell[i]
        fixed = k[i] == FIXED
        for o in t.around:
            j = i + o
            if z[j] != z[j]:
                continue
            if done[j]:
                if root[j] != root[i]:
                    if root[j] != SEED:
                        edge(i, j)
                    if not fixed:
                        edge(j, i)
                continue
            new = z[j] if z[j] > v else _next(v, eps)
            if j not in sown and (new < level[j] or new == level[j] and root[j] is None and v < z[j]):
                level[j], root[j] = new, root[i]
                c[j] = (z[j] if z[j] > c[i] else _next(c[i], eps)) if fixed else max(z[j], _next(c[i], eps)) if c[i] > -_INF else z[j]
                k[j] = FIXED if fixed else k[i] + 1
                r[j] = -_INF if fixed else max(r[i], raised(z[i], k[i], eps))
                heapq.heappush(heap, (new, True, j))
    out = [(0, cell[i], x, y, z[i], root[i], c[i], k[i], r[i]) for i, x, y, edge_ in zip(at, rows["x"].tolist(), rows["y"].tolist(), rim) if edge_]
    out += [(1, a, 0, 0, 0.0, b, w, steps, 0.0) for (a, b), ways in best.items() for w, steps in {*ways} if b != SEED]
    return pd.DataFrame(out, columns=["kind", "cell_id", "x", "y", "z", "root", "c", "k", "r"]).assign(gx=rows["gx"].iloc[0], gy=rows["gy"].iloc[0])


_ROOTS = "kind int, cell_id long, x long, y long, z float, root long, c float, k long, r float, gx long, gy long"


def _least(edges: pd.DataFrame, eps: float) -> pd.DataFrame:
    """One piece of the graph: a, b, c, k and u (the level of a, where it lies in another piece). The levels of all b."""
    level: dict[int, float] = dict.fromkeys(edges["b"].tolist(), _INF)
    out: dict[int, list[tuple[int, float, int]]] = {}
    for a, b, c, k, u in zip(*(edges[x].tolist() for x in ("a", "b", "c", "k", "u"))):
        if k == FIXED or u == u:
            level[b] = min(level[b], c if k == FIXED else max(c, raised(u, k, eps)))
        else:
            out.setdefault(a, []).append((b, c, k))
    heap = [(v, b) for b, v in level.items() if v < _INF]
    heapq.heapify(heap)
    while heap:
        v, a = heapq.heappop(heap)
        if v > level[a]:
            continue
        for b, c, k in out.get(a, ()):
            new = max(c, raised(v, k, eps))
            if new < level.get(b, -_INF):
                level[b] = new
                heapq.heappush(heap, (new, b))
    return pd.DataFrame({"root": [*level], "u": [*level.values()]}).assign(hx=edges["hx"].iloc[0], hy=edges["hy"].iloc[0])


def _edges(told: DataFrame, tile: int) -> DataFrame:
    """a, b, c, k and the tiles of both, of what _roots() says of all tiles."""
    near = [F.col("gx").alias("ax"), F.col("gy").alias("ay"), "gx", "gy"]
    rim = told.where("kind = 0")
    met = told.where("kind = 1").select(F.col("cell_id").alias("a"), F.col("root").alias("b"), "c", "k", *near)
    sown = rim.where(F.col("root") == SEED).select("root", "cell_id", "c", "k", *near)
    held = rim.where((F.col("root") != SEED) & (F.col("root") != F.col("cell_id")))
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(DX, DY)))
    q = rim.withColumn("o", F.explode(offsets)).select(F.col("cell_id").alias("a"), F.col("gx").alias("ax"), F.col("gy").alias("ay"), (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"))
    q = q.where((F.floor(F.col("x") / tile) != F.col("ax")) | (F.floor(F.col("y") / tile) != F.col("ay")))
    across = q.join(rim.select("x", "y", F.col("cell_id").alias("b"), "z", "gx", "gy"), ["x", "y"]).select("a", "b", F.col("z").alias("c"), F.lit(1).cast("long").alias("k"), "ax", "ay", "gx", "gy")
    return met.union(sown).union(held.select("root", "cell_id", "c", "k", *near)).union(held.select("cell_id", "root", "r", "k", *near)).union(across)


def _graph(edges: DataFrame, eps: float, piece: int) -> DataFrame:
    """edges: a, b, c, k, and the tiles of both. cell_id, u: the least level of each node that a seed is reached from."""
    h = lambda c: F.floor(F.col(c) / piece)
    edges = cut(edges.select("a", "b", "c", "k", h("ax").alias("fx"), h("ay").alias("fy"), h("gx").alias("hx"), h("gy").alias("hy")))
    across = (F.col("k") != FIXED) & ((F.col("fx") != F.col("hx")) | (F.col("fy") != F.col("hy")))
    own = edges.where(~across).withColumn("u", F.lit(None).cast("float")).drop("fx", "fy")
    outer = cut(edges.where(across).drop("fx", "fy"))
    solve = lambda rows: _least(rows, eps)
    schema = "root long, u float, hx long, hy long"
    state = cut(own.groupBy("hx", "hy").applyInPandas(solve, schema))
    told = None
    while True:
        lent = outer.join(state.where(F.col("u") < _INF).select(F.col("root").alias("a"), "u"), "a")
        fresh = cut(lent if told is None else lent.join(told.select("a", "b", "c", "k", F.col("u").alias("was")), ["a", "b", "c", "k"], "left").where("was is null or u < was").drop("was"))
        active = fresh.select("hx", "hy").distinct()
        if not fresh.take(1):
            drop(fresh, outer, edges)
            return state.where(F.col("u") < _INF).select(F.col("root").alias("cell_id"), "u")
        told = cut(lent.select("a", "b", "c", "k", "u"))
        given = own.select("a", "b", "c", "k", "u", "hx", "hy").union(lent.select("a", "b", "c", "k", "u", "hx", "hy")).join(active, ["hx", "hy"], "left_semi")
        state = cut(given.groupBy("hx", "hy").applyInPandas(solve, schema).union(state.join(active, ["hx", "hy"], "left_anti").select("root", "u", "hx", "hy")), state)
        drop(fresh)


def fill(cells: DataFrame, eps: float = 1e-3, tile: int = 256, piece: int = PIECE, max_rounds: int = 10000) -> DataFrame:
    """cells: cell_id, x, y, z, seed (boolean, null: false). Returns cell_id, filled (float). A seed keeps z; any other cell
    gets the least over its neighbours' levels v of z where z > v, of v + eps else, in float32. A cell with null z, or from
    which no seed can be reached, has a null level. A task holds one tile and its rim, or one piece of the graph."""
    small = float(np.float32(eps))
    px, py = F.pmod("x", F.lit(tile)), F.pmod("y", F.lit(tile))
    base = cut(cells.where("z is not null").select("cell_id", "x", "y", F.col("z").cast("float").alias("z"), F.coalesce("seed", F.lit(False)).alias("seed"), F.floor(F.col("x") / tile).alias("gx"), F.floor(F.col("y") / tile).alias("gy"), (px.isin(0, tile - 1) | py.isin(0, tile - 1)).alias("rim")))
    told = cut(base.groupBy("gx", "gy").applyInPandas(lambda rows: _roots(rows, small), _ROOTS))
    edges = cut(_edges(told, tile))
    rim = cut(told.where("kind = 0").select("cell_id", "x", "y", "z", "gx", "gy"), told)
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))

    def flood(rows: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(rows)
        at = t.at.tolist()
        mine, free = rows["inner"].to_numpy(bool), [False] * t.n
        start: dict[int, float] = {}
        sown = dict.fromkeys(at, False)
        for i, own, s, z, v in zip(at, mine.tolist(), rows["seed"].tolist(), rows["z"].tolist(), rows["level"].tolist()):
            if own and s:
                start[i], sown[i] = z, True
            elif own:
                free[i] = True
            elif v < _INF:
                start[i] = v
        found, source = _levels(t, start, free, small)
        out = rows[["cell_id", "x", "y", "gx", "gy", "rim"]].assign(level=np.array([found[i] for i in at], "float32"), src=-1, c=np.float32(0), k=0)
        ids = dict(zip(at, rows["cell_id"].tolist()))
        src, c, k = out["src"].tolist(), out["c"].tolist(), out["k"].tolist()
        for n, (i, own, edge, v) in enumerate(zip(at, mine.tolist(), rows["rim"].tolist(), rows["level"].tolist())):
            if own and edge and found[i] < (_INF if v is None or v != v else v):  # lower than the graph has it
                first, c[n], k[n] = _way(t, source, i, small)
                src[n] = ids[first] if first in start and not sown[first] else SEED
                if src[n] == SEED:
                    c[n], k[n] = found[i], FIXED
        return out.assign(src=src, c=np.array(c, "float32"), k=k)[mine]

    done: DataFrame | None = None
    before: DataFrame | None = None
    for turn in range(max_rounds):
        known = cut(rim.join(_graph(edges, small, piece), "cell_id", "left"))
        # the rim of a tile is known to its neighbours, under their numbers
        lent = known.withColumn("o", F.explode(near)).withColumns({"tx": F.floor((F.col("x") + F.col("o.a")) / tile), "ty": F.floor((F.col("y") + F.col("o.b")) / tile)})
        lent = lent.where(((F.col("tx") != F.col("gx")) | (F.col("ty") != F.col("gy"))) & F.col("u").isNotNull()).select("cell_id", "x", "y", "z", F.col("tx").alias("gx"), F.col("ty").alias("gy"), "u").distinct()
        mine = base.join(known.select("cell_id", "u"), "cell_id", "left").select("cell_id", "x", "y", "z", "seed", "gx", "gy", "rim", F.lit(True).alias("inner"), F.col("u").alias("level"))
        if before is not None:
            old = before.select("cell_id", F.col("u").alias("was"))
            active = cut(lent.join(old, "cell_id", "left").where("was is null or u < was").select("gx", "gy").distinct(), before)
            if not active.take(1):
                break
            lent, mine = (rows.join(active, ["gx", "gy"], "left_semi") for rows in (lent, mine))
        theirs = lent.select("cell_id", "x", "y", "z", F.lit(False).alias("seed"), "gx", "gy", F.lit(False).alias("rim"), F.lit(False).alias("inner"), F.col("u").alias("level"))
        flooded = mine.select(*theirs.columns).union(theirs).groupBy("gx", "gy").applyInPandas(flood, "cell_id long, x long, y long, gx long, gy long, rim boolean, level float, src long, c float, k long")
        done = add(done, flooded.withColumn("turn", F.lit(turn)))
        lower = cut(done.where((F.col("turn") == turn) & (F.col("k") != 0)).select(F.col("src").alias("a"), F.col("cell_id").alias("b"), "c", "k", "gx", "gy", "level"))
        if not lower.take(1):
            break
        placed = rim.select(F.col("cell_id").alias("a"), F.col("gx").alias("ax"), F.col("gy").alias("ay"))
        learnt = lower.join(placed, "a", "left").select("a", "b", "c", "k", F.coalesce("ax", "gx").alias("ax"), F.coalesce("ay", "gy").alias("ay"), "gx", "gy")
        # the level itself as well: where a cell is less than eps above its water, a function says more than the definition
        found = lower.select(F.lit(SEED).cast("long").alias("a"), "b", F.col("level").alias("c"), F.lit(FIXED).cast("long").alias("k"), F.col("gx").alias("ax"), F.col("gy").alias("ay"), "gx", "gy")
        edges, before = add(edges, learnt.union(found)), known
    else:
        raise RuntimeError(f"levels still move after {max_rounds} rounds")
    last = done.groupBy("gx", "gy").agg(F.max("turn").alias("turn"))
    settled = done.join(last, ["gx", "gy", "turn"]).select("cell_id", F.when(F.col("level") < _INF, F.col("level")).alias("filled"))
    return cells.select("cell_id").join(settled, "cell_id", "left")
