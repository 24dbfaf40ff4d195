"""Polygons of masks of cells: outlines with their holes, and which lies in which."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shapes import POINT, open_sides, simplify_line


def walked(edges: np.ndarray) -> list[list[tuple[int, int]]]:
    """edges: ax, ay, bx, b_y. The closed ways along them. Where two meet in a corner a way turns right, towards its own
    cell, so that cells that touch in a corner only lie in rings of their own."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for ax, ay, bx, by in edges.tolist():
        after.setdefault((ax, ay), []).append((bx - ax, by - ay))
    out, seen = [], set()
    for ax, ay, bx, by in edges.tolist():
        at, way, ring = (ax, ay), (bx - ax, by - ay), []
        while (at, way) not in seen:
            seen.add((at, way))
            ring.append(at)
            at = at[0] + way[0], at[1] + way[1]
            right = -way[1], way[0]
            way = right if right in after[at] else after[at][0]
        if ring:
            out.append(ring)
    return out


def twice_area(ring: np.ndarray) -> int:
    """Positive for outlines, negative for holes."""
    after = np.roll(ring, -1, 0)
    return int((ring[:, 0] * after[:, 1] - after[:, 0] * ring[:, 1]).sum())


def nested(rings: list[np.ndarray]) -> list[int | None]:
    """The ring that each one lies in, None for the outermost. From the first side of a ring (by rows, then from the left) the
    nearest side to the left tells: between them is either the inside of the ring on the left or what is around both."""
    sides = []
    for i, ring in enumerate(rings):
        for (x, y), (ax, ay) in zip(ring.tolist(), np.roll(ring, -1, 0).tolist()):
            if x == ax:
                sides += [(row, x, i) for row in range(min(y, ay), max(y, ay))]
    sides.sort()
    outer = [twice_area(r) > 0 for r in rings]
    over: list[int | None] = [None] * len(rings)
    seen: set[int] = set()
    for k, (y, _, i) in enumerate(sides):
        if i in seen:
            continue
        seen.add(i)
        if k and sides[k - 1][0] == y:
            beside = sides[k - 1][2]
            over[i] = beside if outer[beside] != outer[i] else over[beside]
    return over


def _corners(ring: list[tuple[int, int]]) -> np.ndarray:
    """A ring of unit steps without the points along its straight sides."""
    at = np.array(ring)
    turns = ((at - np.roll(at, 1, 0)) != (np.roll(at, -1, 0) - at)).any(1)
    return at[turns]


def polygons(masks: DataFrame, zoom: int = 8, shrink: int = 1, tolerance: float = 0.0) -> DataFrame:
    """masks: mask_id, px, py: cells. A row for each part of a mask that hangs together by sides: mask_id, part (0 has the most
    cells), depth (0; 2 for a part in a hole of another part, and so on), inside (that part), cells (pooled ones, holes not
    counted), border (their open sides), rings: the outline, then its holes, closed, as array<array<struct<lon,lat>>>. Cells are
    pooled by `shrink` first; a tolerance (degrees) simplifies rings, of which those of less than 4 points go.

    Open sides are found beforehand, so that a task holds a mask's outline, not its area."""
    open_ = open_sides(masks.select("mask_id", F.floor(F.col("px") / shrink).alias("x"), F.floor(F.col("py") / shrink).alias("y")))
    scale = float(256 * 2**zoom)

    def placed(ring: np.ndarray) -> list[dict] | None:
        at = np.array([(x * shrink / scale * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y * shrink / scale))))) for x, y in [*ring.tolist(), ring[0].tolist()]])
        at = simplify_line(at, tolerance) if tolerance else at
        return [{"lon": x, "lat": y} for x, y in at.tolist()] if len(at) >= 4 else None

    def outline(rows: pd.DataFrame) -> pd.DataFrame:
        ways = walked(rows.sort_values(["ay", "ax", "b_y", "bx"])[["ax", "ay", "bx", "b_y"]].to_numpy())
        rings = [_corners(w) for w in ways]
        over, size = nested(rings), [twice_area(r) // 2 for r in rings]
        holes: dict[int, list[int]] = {}
        for i, o in enumerate(over):
            if size[i] < 0:
                holes.setdefault(o, []).append(i)
        parts = [(i, size[i] + sum(size[h] for h in holes.get(i, ()))) for i in range(len(rings)) if size[i] > 0]
        parts.sort(key=lambda p: (-p[1], rings[p[0]][:, ::-1].tolist()))
        number = {i: k for k, (i, _) in enumerate(parts)}
        out = []
        for i, n in parts:
            depth, o = 0, over[i]
            while o is not None:
                depth, o = depth + 1, over[o]
            own = [i, *holes.get(i, ())]
            shown = [r for r in (placed(rings[h]) for h in own) if r]
            out.append((rows["mask_id"].iloc[0], number[i], depth, None if over[i] is None else number[over[over[i]]], n, sum(len(ways[h]) for h in own), shown))
        return pd.DataFrame(out, columns=["mask_id", "part", "depth", "inside", "cells", "border", "rings"]).astype({"inside": "Int32"})

    return open_.groupBy("mask_id").applyInPandas(outline, f"mask_id long, part int, depth int, inside int, cells long, border long, rings array<array<{POINT}>>")
