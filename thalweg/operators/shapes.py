"""Polygons and lines: points in polygons, nearest vertices, clipping to a box, rings of masks, simplification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINT = "struct<lon:double,lat:double>"
#: Steps of a line up to which its points are looked at one by one.
FEW = 12


def _inside(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule over a ring's edges, closed by itself."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, F.pmod(i + 1, n))
        at = p["lon"] + F.try_divide((lat - p["lat"]) * (q["lon"] - p["lon"]), q["lat"] - p["lat"])
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < at)

    return F.size(F.filter(F.transform(ring, crosses), lambda c: c)) % 2 == 1


def containing(points: DataFrame, polygons: DataFrame, step: float = 4.0) -> DataFrame:
    """points: point_id, lon, lat; polygons: poly_id, rings array<array<struct<lon,lat>>>, the first ring outside, others
    holes. Returns point_id, poly_id for every polygon that holds the point. An equi-join on square buckets that a polygon's
    box touches, then the exact test, all in the JVM. A null or empty polygon holds nothing."""
    outer = F.get("rings", F.lit(0))
    lons, lats = F.transform(outer, lambda p: p["lon"]), F.transform(outer, lambda p: p["lat"])
    box = polygons.where(F.size(outer) >= 3).select("poly_id", "rings", F.array_min(lons).alias("x0"), F.array_max(lons).alias("x1"), F.array_min(lats).alias("y0"), F.array_max(lats).alias("y1"))
    cell = lambda v: F.floor(v / step)
    box = box.withColumn("bx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("bky", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    spots = points.select("point_id", "lon", "lat", cell(F.col("lon")).alias("bx"), cell(F.col("lat")).alias("bky"))
    met = spots.join(box, ["bx", "bky"]).where(F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")))
    hole = F.exists(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: _inside(r, F.col("lon"), F.col("lat")))
    return met.where(_inside(F.get("rings", F.lit(0)), F.col("lon"), F.col("lat")) & ~hole).select("point_id", "poly_id")


def point_in_polygon(points: DataFrame, polygons: DataFrame, step: float = 4.0) -> DataFrame:
    """Returns point_id, poly_id: the smallest poly_id that holds the point (see containing()), null if none does."""
    held = containing(points, polygons, step).groupBy("point_id").agg(F.min("poly_id").alias("poly_id"))
    return points.select("point_id").join(held, "point_id", "left")


def _to_edge(p: Column, q: Column, lon: Column, lat: Column) -> Column:
    """The distance of a point to the segment from p to q, in degrees."""
    dx, dy = q["lon"] - p["lon"], q["lat"] - p["lat"]
    t = F.coalesce(F.try_divide((lon - p["lon"]) * dx + (lat - p["lat"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(lon - p["lon"] - t * dx, lat - p["lat"] - t * dy)


def nearest_polygon(points: DataFrame, polygons: DataFrame, reach: float) -> DataFrame:
    """Returns point_id, poly_id, d: the nearest polygon within `reach` degrees, d being 0 inside it, the smallest poly_id on
    ties; points without one are left out. Edges go to the square buckets that their boxes, widened by the reach, touch."""
    inside = containing(points, polygons).select("point_id", "poly_id", F.lit(0.0).alias("d"))
    ring = F.explode("rings").alias("ring")
    edge = F.explode(F.transform("ring", lambda p, i: F.struct(p.alias("p"), F.get(F.col("ring"), F.pmod(i + 1, F.size("ring"))).alias("q"))))
    edges = polygons.where("rings is not null").select("poly_id", ring).where(F.size("ring") > 0).select("poly_id", edge.alias("e"))
    cell = lambda v: F.floor(v / reach)
    span = lambda c: F.explode(F.sequence(cell(F.least(F.col(f"e.p.{c}"), F.col(f"e.q.{c}")) - reach), cell(F.greatest(F.col(f"e.p.{c}"), F.col(f"e.q.{c}")) + reach)))
    edges = edges.withColumn("bx", span("lon")).withColumn("bky", span("lat"))
    met = points.select("point_id", "lon", "lat", cell(F.col("lon")).alias("bx"), cell(F.col("lat")).alias("bky")).join(edges, ["bx", "bky"])
    near = met.withColumn("d", _to_edge(F.col("e")["p"], F.col("e")["q"], F.col("lon"), F.col("lat"))).where(F.col("d") <= reach).select("point_id", "poly_id", "d")
    best = inside.union(near).groupBy("point_id").agg(F.min(F.struct("d", "poly_id")).alias("b"))
    return best.select("point_id", "b.poly_id", "b.d")


def nearest_line(points: DataFrame, vertices: DataFrame, reach: float) -> DataFrame:
    """points: point_id, lon, lat; vertices of lines: owner, seq, lon, lat. Returns point_id, owner, d: the nearest line (by its
    segments) within `reach` degrees, the smallest owner on ties; points without one are left out."""
    way = W.partitionBy("owner").orderBy("seq")
    q = F.struct(F.lead("lon").over(way).alias("lon"), F.lead("lat").over(way).alias("lat"))
    edges = vertices.select("owner", F.struct("lon", "lat").alias("p"), q.alias("q")).where("q.lon is not null")
    cell = lambda v: F.floor(v / reach)
    span = lambda c: F.explode(F.sequence(cell(F.least(F.col(f"p.{c}"), F.col(f"q.{c}")) - reach), cell(F.greatest(F.col(f"p.{c}"), F.col(f"q.{c}")) + reach)))
    edges = edges.withColumn("bx", span("lon")).withColumn("bky", span("lat"))
    met = points.select("point_id", "lon", "lat", cell(F.col("lon")).alias("bx"), cell(F.col("lat")).alias("bky")).join(edges, ["bx", "bky"])
    near = met.withColumn("d", _to_edge(F.col("p"), F.col("q"), F.col("lon"), F.col("lat"))).where(F.col("d") <= reach)
    return near.groupBy("point_id").agg(F.min(F.struct("d", "owner")).alias("b")).select("point_id", "b.owner", "b.d")


def area(ring: Column) -> Column:
    """The area of a ring in square degrees, whichever way it runs."""
    n = F.size(ring)
    parts = F.transform(ring, lambda p, i: p["lon"] * F.get(ring, F.pmod(i + 1, n))["lat"] - F.get(ring, F.pmod(i + 1, n))["lon"] * p["lat"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)) / 2


def middle(rings: Column) -> Column:
    """struct lon, lat: the mean of the vertices of the ring that has most of them, the first on ties; null without rings."""
    most = F.array_max(F.transform(rings, lambda r: F.size(r)))
    ring = F.get(F.filter(rings, lambda r: F.size(r) == most), F.lit(0))
    mean = lambda c: F.aggregate(F.transform(ring, lambda p: p[c]), F.lit(0.0), lambda a, b: a + b) / F.size(ring)
    return F.when(most > 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")))


def dry_runs(vertices: DataFrame, wet: str) -> DataFrame:
    """vertices: owner, seq, and a boolean column `wet`. The runs of vertices that are not wet, of two or more: owner, run (from
    0), seq, and all other columns; null counts as dry."""
    dry = ~F.coalesce(F.col(wet), F.lit(False))
    way = W.partitionBy("owner").orderBy("seq")
    out = vertices.withColumn("__island", F.row_number().over(way) - F.row_number().over(W.partitionBy("owner", dry).orderBy("seq"))).where(dry)
    out = out.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("owner", "__island"))).where("__n > 1")
    return out.withColumn("run", F.dense_rank().over(W.partitionBy("owner").orderBy("__island")) - 1).drop("__island", "__n")


def _scaled(max_deg: float, points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs within max_deg of each other, longitudes scaled by the cosine of the point's latitude (so buckets across are as
    many as that latitude needs): point columns, owner, seq, d."""
    cell = lambda v: F.floor(v / max_deg)
    reach = F.ceil(1 / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))).cast("long")
    spots = points.withColumn("bx", F.explode(F.sequence(cell(F.col("lon")) - reach, cell(F.col("lon")) + reach))).withColumn("bky", F.explode(F.sequence(cell(F.col("lat")) - 1, cell(F.col("lat")) + 1)))
    ends = vertices.withColumnsRenamed({"lon": "__vx", "lat": "__vy"}).withColumn("bx", cell(F.col("__vx"))).withColumn("bky", cell(F.col("__vy")))
    # rows come of one point, which the planner does not count: it would take the points for a table small enough to broadcast
    met = spots.hint("merge").join(ends, ["bx", "bky"])
    dx, dy = (F.col("__vx") - F.col("lon")) * F.cos(F.radians("lat")), F.col("__vy") - F.col("lat")
    return met.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= max_deg)


def nearest(points: DataFrame, vertices: DataFrame, max_deg: float) -> DataFrame:
    """points: point_id, lon, lat; vertices: owner, seq, lon, lat. Returns point_id, owner, d: that of the nearest vertex
    within max_deg, the smallest (owner, seq) on ties; nulls where there is none."""
    best = _scaled(max_deg, points.select("point_id", "lon", "lat"), vertices.select("owner", "seq", "lon", "lat")).groupBy("point_id").agg(F.min(F.struct("d", "owner", "seq")).alias("b"))
    return points.select("point_id").join(best, "point_id", "left").select("point_id", "b.owner", "b.d")


def best_near(points: DataFrame, vertices: DataFrame, max_deg: float) -> DataFrame:
    """As `nearest`, but points have area and vertices up and dn: the least of distance weighed by how far the reach's mean
    area is from the point's."""
    met = _scaled(max_deg, points.select("point_id", "lon", "lat", "area"), vertices.select("owner", "seq", "lon", "lat", "up", "dn"))
    middle = F.greatest(F.lit(1.0), (F.col("up") + F.col("dn")) / 2)
    value = (F.col("d") + 0.08 * max_deg) * (1 + 1.6 * F.abs(F.log(middle / F.greatest(F.col("area"), F.lit(1e-9)))))
    best = met.withColumn("score", value).groupBy("point_id").agg(F.min(F.struct("score", "owner", "seq")).alias("b"))
    return points.select("point_id").join(best, "point_id", "left").select("point_id", "b.owner", "b.score")


def clip_ring(ring: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """Sutherland and Hodgman: the part of a ring within a box."""
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(ring[-1:] + ring[:-1], ring):
            ina, inb = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cut[axis] = bound
                out.append(tuple(cut))
            if inb:
                out.append(b)
        ring = out
    return ring


def clip(polygons: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """polygons with rings cut to a box; those with nothing left go. Rows are independent of each other."""

    @F.pandas_udf(f"array<array<{POINT}>>")
    def cut(rings: pd.Series) -> pd.Series:
        def one(value):
            done = [clip_ring([(p["lon"], p["lat"]) for p in r], x0, y0, x1, y1) for r in value] if value is not None else []
            return [[{"lon": x, "lat": y} for x, y in r] for r in done if len(r) >= 3] if done and len(done[0]) >= 3 else None

        return rings.map(one)

    return polygons.withColumn("rings", cut("rings")).where("rings is not null")


def _farthest(points: list[list[float]], a: int, b: int) -> tuple[int, float]:
    """The point between two that is farthest from the segment of these, the first on ties, and how far. For a few points, where a
    call of numpy takes longer than its work."""
    (px, py), (qx, qy) = points[a], points[b]
    sx, sy = qx - px, qy - py
    length, far, most = sx * sx + sy * sy, a + 1, -1.0
    for i in range(a + 1, b):
        x, y = points[i]
        t = min(max(((x - px) * sx + (y - py) * sy) / length, 0.0), 1.0) if length else 0.0
        off = math.hypot(x - (px + t * sx), y - (py + t * sy))
        if off > most:
            far, most = i, off
    return far, most


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer, Douglas and Peucker, with a stack; ends stay."""
    if len(points) < 3:
        return points
    keep, stack, listed = np.zeros(len(points), bool), [(0, len(points) - 1)], points.tolist()
    keep[[0, -1]] = True
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        if b - a <= FEW:
            far, off = _farthest(listed, a, b)
            if off > tolerance:
                keep[far] = True
                stack += [(a, far), (far, b)]
            continue
        p, q, mid = points[a], points[b], points[a + 1 : b]
        side = q - p
        length = side @ side
        t = np.clip((mid - p) @ side / length, 0, 1) if length else np.zeros(len(mid))
        off = np.hypot(*(mid - (p + t[:, None] * side)).T)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            stack += [(a, a + 1 + far), (a + 1 + far, b)]
    return points[keep]


def simplify(lines: DataFrame, tolerance: float, column: str = "coords") -> DataFrame:
    """lines with `column`, array<struct<lon,lat>>, simplified; null stays null."""

    @F.pandas_udf(f"array<{POINT}>")
    def thin(values: pd.Series) -> pd.Series:
        def one(v):
            return None if v is None else [{"lon": x, "lat": y} for x, y in simplify_line(np.array([(p["lon"], p["lat"]) for p in v], float).reshape(-1, 2), tolerance).tolist()]

        return values.map(one)

    return lines.withColumn(column, thin(column))


def _stitch(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of directed edges, each used once; where rings touch, the first edge on hand goes on."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for ax, ay, bx, by in reversed(edges):
        after.setdefault((ax, ay), []).append((bx, by))
    out = []
    for ax, ay, _, _ in edges:
        while after.get((ax, ay)):
            ring = [(ax, ay)]
            while after.get(ring[-1]):
                ring.append(after[ring[-1]].pop())
                if ring[-1] == ring[0]:
                    break
            out.append(ring)
    return out


def open_sides(cells: DataFrame) -> DataFrame:
    """cells: mask_id, x, y, which may repeat. mask_id, ax, ay, bx, b_y: their sides that no cell of the same mask lies beside, with the
    cell on the right hand. Cells are looked at in their rows, then in their columns: a row a cell is shuffled, not one a side."""
    row, column = W.partitionBy("mask_id", "y").orderBy("x"), W.partitionBy("mask_id", "x").orderBy("y")

    def ends(c: str, way: W) -> tuple[Column, Column]:
        """Whether a run of cells begins or ends here; of cells that repeat the first or the last one tells."""
        before, after = F.lag(c).over(way), F.lead(c).over(way)
        return F.coalesce(before < F.col(c) - 1, F.lit(True)), F.coalesce(after > F.col(c) + 1, F.lit(True))

    found = cells
    for (one, two), c, way in ((("__l", "__r"), "x", row), (("__t", "__b"), "y", column)):
        first, last = ends(c, way)
        found = found.select("*", first.alias(one), last.alias(two))
    sides = (("__t", 0, 0, 1, 0), ("__r", 1, 0, 1, 1), ("__b", 1, 1, 0, 1), ("__l", 0, 1, 0, 0))
    side = lambda on, *at: F.when(F.col(on), F.struct(*((F.col(c) + d).alias(n) for c, d, n in zip("xyxy", at, ("ax", "ay", "bx", "b_y")))))
    return found.where("__l or __r or __t or __b").select("mask_id", F.explode(F.array_compact(F.array(*(side(*s) for s in sides)))).alias("s")).select("mask_id", "s.*")


def rings(masks: DataFrame, zoom: int = 8, shrink: int = 1, tolerance: float = 0.004) -> DataFrame:
    """masks: mask_id, px, py: cells. Returns mask_id, ring (0 has the most vertices), coords array<struct<lon,lat>>: outlines,
    the inside on one hand all along. Cells are pooled by `shrink` first. Edges are found beforehand (see open_sides()), so that a
    task stitches a mask's outline only, not its area; rings of up to 6 points, and of up to 4 when simplified, go."""
    open_ = open_sides(masks.select("mask_id", F.floor(F.col("px") / shrink).alias("x"), F.floor(F.col("py") / shrink).alias("y")))
    scale = float(256 * 2**zoom)

    def outline(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ay", "ax", "b_y", "bx"])
        found = []
        for ring in _stitch(list(rows[["ax", "ay", "bx", "b_y"]].itertuples(index=False, name=None))):
            if len(ring) > 6:
                at = np.array([(x * shrink / scale * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y * shrink / scale))))) for x, y in ring])
                at = simplify_line(at, tolerance)
                if len(at) > 4:
                    found.append([{"lon": x, "lat": y} for x, y in at.tolist()])
        found.sort(key=len, reverse=True)
        return pd.DataFrame({"mask_id": [rows["mask_id"].iloc[0]] * len(found), "ring": range(len(found)), "coords": pd.Series(found, dtype=object)})

    # a ring of more than 6 points has 6 sides at least: masks of a cell, of which there may be many, are no groups
    open_ = open_.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("mask_id"))).where("__n >= 6").drop("__n")
    return open_.groupBy("mask_id").applyInPandas(outline, f"mask_id long, ring int, coords array<{POINT}>")
