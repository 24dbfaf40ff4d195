"""Simplifying lines that meet: ends stay where they are, and no two lines cross that did not before.

Each line is thinned by itself: the vertex whose triangle with its neighbours is smallest goes first, while that area is less
than the square of the line's tolerance (Visvalingam and Whyatt). Then segments of all lines meet by square buckets; lines of
pairs that cross, and didn't as they were given, get half the tolerance, and are thinned again from their own vertices, until
there is no such pair. At last a line stays as it is given, so that comes to an end. Only lines that changed are looked at again."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .shapes import POINT

#: Halvings after which a line is taken as it is given; buckets for a tolerance.
HALVINGS, BUCKETS = 12, 16


def thinned(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """The vertices that stay; both ends do. An area counts for no less than that of a vertex which went before it."""
    n = len(points)
    if n < 3 or tolerance <= 0:
        return points
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def area(i: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = points[before[i]], points[i], points[after[i]]
        return abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2

    size = {i: area(i) for i in range(1, n - 1)}
    heap = [(a, i) for i, a in size.items()]
    heapq.heapify(heap)
    gone, least = set(), tolerance * tolerance
    while heap:
        a, i = heapq.heappop(heap)
        if i in gone or size[i] != a:
            continue
        if a >= least:
            break
        gone.add(i)
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for j in (p, q):
            if 0 < j < n - 1:
                size[j] = max(area(j), a)
                heapq.heappush(heap, (size[j], j))
    return [p for i, p in enumerate(points) if i not in gone]


def _segments(lines: DataFrame, bucket: float) -> DataFrame:
    """A row for each segment and square bucket that its box touches."""
    at = F.transform(F.sequence(F.lit(0), F.size("coords") - 2), lambda i: F.struct(i.alias("i"), F.get("coords", i).alias("a"), F.get("coords", i + 1).alias("b")))
    rows = lines.where(F.size("coords") >= 2).select("line_id", F.explode(at).alias("s")).select("line_id", "s.i", "s.a", "s.b")
    span = lambda c: F.sequence(F.floor(F.least(f"a.{c}", f"b.{c}") / bucket), F.floor(F.greatest(f"a.{c}", f"b.{c}") / bucket))
    return rows.withColumn("bx", F.explode(span("lon"))).withColumn("bky", F.explode(span("lat")))


def _side(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (r["lon"] - p["lon"]) * (q["lat"] - p["lat"]))


def crossings(lines: DataFrame, bucket: float, fresh: DataFrame | None = None) -> DataFrame:
    """lines: line_id, coords. one, two: pairs of lines (or a line with itself) of which two segments cross in their inside; pairs
    that only touch in an end don't count. fresh: line_ids one of which a pair must have."""
    left = _segments(lines, bucket)
    right = left.select(*(F.col(c).alias(f"{c}2") for c in ("line_id", "i", "a", "b")), "bx", "bky")
    if fresh is not None:
        left = left.join(fresh, "line_id", "left_semi")
    met = left.join(right, ["bx", "bky"]).where((F.col("line_id") != F.col("line_id2")) | (F.col("i") + 1 < F.col("i2")))
    a, b, c, d = (F.col(x) for x in ("a", "b", "a2", "b2"))
    met = met.where((_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0))
    return met.select(F.least("line_id", "line_id2").alias("one"), F.greatest("line_id", "line_id2").alias("two")).distinct()


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """lines: line_id, coords array<struct<lon,lat>> and more columns. The same with coords simplified, and kept_tolerance: what each
    line was simplified with. Lines that cross each other as they are given may go on doing so. A bucket's segments meet
    in one task; after thinning they are few, as its side is BUCKETS tolerances."""
    bucket = tolerance * BUCKETS

    @F.pandas_udf(f"array<{POINT}>")
    def thin(coords: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(c, t):
            return None if c is None else [{"lon": x, "lat": y} for x, y in thinned([(p["lon"], p["lat"]) for p in c], t)]

        return pd.Series([one(c, t) for c, t in zip(coords, wanted)], dtype=object)

    given = cut(lines.select("line_id", "coords"))
    state = cut(given.select("line_id", thin("coords", F.lit(float(tolerance))).alias("coords"), F.lit(float(tolerance)).alias("kept_tolerance")))
    fresh = None
    for turn in range(HALVINGS + 1):
        new = cut(crossings(state, bucket, fresh))
        if not new.take(1):
            break
        named = new.select(F.col("one").alias("line_id")).union(new.select("two")).distinct()
        own = crossings(given.join(named, "line_id", "left_semi"), bucket)  # as they were given
        worse = cut(new.join(own, ["one", "two"], "left_anti"))
        hit = cut(worse.select(F.col("one").alias("line_id")).union(worse.select("two")).distinct(), new)
        if not hit.take(1):
            break
        less = F.when(F.lit(turn < HALVINGS - 1), F.col("kept_tolerance") / 2).otherwise(F.lit(0.0))
        again = state.join(hit, "line_id", "left_semi").select("line_id", less.alias("kept_tolerance")).join(given, "line_id")
        redone = again.select("line_id", thin("coords", "kept_tolerance").alias("coords"), "kept_tolerance")
        state = cut(state.join(hit, "line_id", "left_anti").select("line_id", "coords", "kept_tolerance").union(redone), state)
        fresh = hit
    return lines.drop("coords").join(state, "line_id")
