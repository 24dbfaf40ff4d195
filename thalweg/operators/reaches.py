"""Reaches of the network, their names, and the tributaries above points, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions.lineage import cut
from ..sources.rivers import canonical
from . import generalise, shapes
from .flow import chase, degrees, intervals, members, network


def extract(acc: DataFrame, threshold: float) -> DataFrame:
    """acc: cell_id, parent_id, acc. Returns reach_id (its first cell), pos, cell_id: the network of acc at least threshold,
    broken at confluences; a reach ends on the confluence that the next one starts with. Single cells are no reach."""
    net = acc.where(F.col("acc") >= threshold).select("cell_id", "parent_id")
    down = net.join(net.select(F.col("cell_id").alias("parent_id")), "parent_id", "left_semi").select("cell_id", "parent_id")
    feeds = down.groupBy(F.col("parent_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("above"))
    links = net.select("cell_id").join(feeds, "cell_id", "left").select(F.col("cell_id").alias("node"), F.when(F.col("n") == 1, F.col("above")).alias("to"), F.lit(1).alias("weight"))
    body = cut(chase(links).select(F.col("root").alias("reach_id"), F.col("total").alias("pos"), F.col("node").alias("cell_id")))
    heads = body.where("pos = 0").select(F.col("cell_id").alias("parent_id"))
    closing = body.join(down, "cell_id").join(heads, "parent_id", "left_semi").select("reach_id", (F.col("pos") + 1).alias("pos"), F.col("parent_id").alias("cell_id"))
    out = body.union(closing)
    several = closing.select("reach_id").union(body.where("pos > 0").select("reach_id")).distinct()
    return out.join(several, "reach_id", "left_semi")


def heads(acc: DataFrame, threshold: float) -> DataFrame:
    """cell_id, degree: the cells that a reach of extract() may start with: sources of the network, and where several cells of it
    meet."""
    net = network(acc, threshold)
    return net.select("cell_id").join(degrees(net), "cell_id", "left").select("cell_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree")).where("degree <> 1")


def summarise(reaches: DataFrame, acc: DataFrame) -> DataFrame:
    """A row a reach: reach_id, cells, head, tail, up and dn (acc at its ends)."""
    met = reaches.join(acc.select("cell_id", "acc"), "cell_id")
    out = met.groupBy("reach_id").agg(F.count(F.lit(1)).alias("cells"), F.min_by(F.struct("cell_id", "acc"), "pos").alias("a"), F.max_by(F.struct("cell_id", "acc"), "pos").alias("b"))
    return out.select("reach_id", "cells", F.col("a.cell_id").alias("head"), F.col("b.cell_id").alias("tail"), F.col("a.acc").alias("up"), F.col("b.acc").alias("dn"))


def lines(reaches: DataFrame, cells: DataFrame, zoom: int = 8, x0: int = 0, y0: int = 0) -> DataFrame:
    """reaches as from extract(); cells: cell_id, x, y. line_id (the reach) and coords, the middles of its cells in order; a reach
    is broken at confluences, so a line is as long as the network between two of them."""
    lon, lat = g.pixel_to_lon(F.col("x") + x0 + 0.5, zoom), g.pixel_to_lat(F.col("y") + y0 + 0.5, zoom)
    met = reaches.join(cells.select("cell_id", lon.alias("lon"), lat.alias("lat")), "cell_id")
    rows = met.groupBy(F.col("reach_id").alias("line_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("c"))
    return rows.select("line_id", F.transform("c", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))


def vote(probes: DataFrame) -> DataFrame:
    """probes: reach_id, seq, name (null: none near). Returns reach_id, name, votes: the most frequent name, the first met on
    ties, where it has at least two votes and a third of the probes."""
    sizes = probes.groupBy("reach_id").agg(F.count(F.lit(1)).alias("probes"))
    votes = probes.where("name is not null").groupBy("reach_id", "name").agg(F.count(F.lit(1)).alias("votes"), F.min("seq").alias("first"))
    best = votes.groupBy("reach_id").agg(F.max_by(F.struct("name", "votes"), F.struct("votes", -F.col("first"))).alias("b"))
    return best.join(sizes, "reach_id").where(F.col("b.votes") >= F.greatest(F.lit(2), F.floor(F.col("probes") / 3))).select("reach_id", "b.name", "b.votes")


def propagate(reaches: DataFrame, rounds: int = 4, share: float = 0.55) -> DataFrame:
    """reaches: reach_id, head, tail, up, dn, name. A reach without a name takes that of the reach that starts where it ends,
    if its dn is at least `share` of the other's up. Rounds are synchronous: the order of rows does not matter."""
    state = reaches
    for _ in range(rounds):
        ahead = state.where("name is not null").groupBy(F.col("head").alias("tail")).agg(F.max_by(F.struct("name", F.col("up").alias("u")), "reach_id").alias("next"))
        state = cut(state.join(ahead, "tail", "left").withColumn("name", F.when(F.col("name").isNull() & (F.col("dn") >= share * F.col("next.u")), F.col("next.name")).otherwise(F.col("name"))).select(*reaches.columns))
    return state


def upstream(acc: DataFrame, points: DataFrame, min_acc: float | None, max_paths: int | None = 3000, numbered: DataFrame | None = None) -> DataFrame:
    """acc: cell_id, parent_id, acc; points: outlet_id, and least (by point) where min_acc is None. Returns outlet_id, path_id
    (its lowest cell), depth, pos, cell_id, acc: the main stem above each point, following the largest child (the smallest id
    on ties), then its tributaries, and theirs. A child counts from min_acc. Single cells are no path; max_paths keeps the
    shallowest, largest paths of a point, and truncated says where there were more. numbered: flow.intervals() of acc.

    What is main and how deep a cell lies below the root follow from all cells, once for all points: each cell has the end of
    its stem and its depth below the root of its tree, so a point only takes the members of its catchment and subtracts. A stem
    also tells how much its second cell drains, which is whether it is a path for a point: acc must not fall on the way down. Only
    cells from the least `least` on are numbered, where numbered is not given."""
    known = stems(acc)
    at, low = _from_points(known, points, min_acc)
    numbered = intervals(acc.where(F.col("acc") >= low).select("cell_id", "parent_id")) if numbered is None else numbered
    met = members(numbered, at, known.select("cell_id", "stem", "pos", "depth", "acc", "second"))
    own = F.col("stem") == F.col("__stem")  # the stem that the point lies on begins at the point
    met = met.where((F.col("acc") >= F.col("least")) & (F.when(own, F.col("__second")).otherwise(F.col("second")) >= F.col("least")))
    out = met.select("outlet_id", F.when(own, F.col("outlet_id")).otherwise(F.col("stem")).alias("path_id"), (F.col("depth") - F.col("__depth")).alias("depth"), F.when(own, F.col("pos") - F.col("__pos")).otherwise(F.col("pos")).alias("pos"), "cell_id", "acc")
    if max_paths is None:
        return out.withColumn("truncated", F.lit(False))
    found = out.groupBy("outlet_id", "path_id").agg(F.min("depth").alias("d"), F.max("acc").alias("size"))
    order = W.partitionBy("outlet_id").orderBy("d", F.desc("size"), "path_id")
    found = found.withColumn("__r", F.row_number().over(order)).withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy("outlet_id")) > max_paths)
    return out.join(found.where(F.col("__r") <= max_paths).select("outlet_id", "path_id", "truncated"), ["outlet_id", "path_id"])


def stems(acc: DataFrame) -> DataFrame:
    """acc: cell_id, parent_id, acc. cell_id, acc, stem (its lowest cell), pos (steps to there), depth (stems to the end of the path), up (acc
    of the cell that the stem comes from, null at its top) and second (the same of the stem's lowest cell)."""
    rank = F.row_number().over(W.partitionBy("parent_id").orderBy(F.desc("acc"), "cell_id"))
    ranked = acc.withColumn("main", F.col("parent_id").isNotNull() & (rank == 1))
    ranked = cut(ranked.select(F.col("cell_id").alias("node"), F.col("parent_id").alias("below"), "acc", "main"))
    own = chase(ranked.select("node", F.when(F.col("main"), F.col("below")).alias("to"), F.lit(1).alias("weight")))
    depth = chase(ranked.select("node", F.col("below").alias("to"), (~F.col("main")).cast("int").alias("weight")))
    known = own.select(F.col("node").alias("cell_id"), F.col("root").alias("stem"), F.col("total").alias("pos")).join(depth.select(F.col("node").alias("cell_id"), F.col("total").alias("depth")), "cell_id")
    above = ranked.where("main").select(F.col("below").alias("cell_id"), F.col("acc").alias("up"))
    known = cut(known.join(acc.select("cell_id", "acc"), "cell_id").join(above, "cell_id", "left"), ranked)
    return cut(known.join(known.where("pos = 0").select("stem", F.col("up").alias("second")), "stem"), known)


def _from_points(known: DataFrame, points: DataFrame, min_acc: float | None) -> tuple[DataFrame, float]:
    """points (outlet_id, least) with what stems() knows of them, and the least of what counts."""
    least = F.lit(float(min_acc)) if min_acc is not None else F.col("least").cast("double")
    points = points.select("outlet_id", least.alias("least"))
    at = points.join(known.select(F.col("cell_id").alias("outlet_id"), F.col("stem").alias("__stem"), F.col("pos").alias("__pos"), F.col("depth").alias("__depth"), F.col("up").alias("__second")), "outlet_id")
    low = float(min_acc) if min_acc is not None else points.agg(F.min("least")).first()[0]
    return at, low if low is not None else 0.0


def stems_above(acc: DataFrame, points: DataFrame, named: DataFrame, min_acc: float | None) -> DataFrame:
    """outlet_id, path_id, depth, acc: the lowest cells of the paths of upstream() that are among `named` (cell_id), a row a path. Only cells
    that drain as much as the least of these are numbered."""
    known = stems(acc)
    at, _ = _from_points(known, points, min_acc)
    named = cut(named.select("cell_id").distinct())
    low = named.join(acc.select("cell_id", "acc"), "cell_id").agg(F.min("acc")).first()[0]
    net = acc.where(F.col("acc") >= (0 if low is None else low)).select("cell_id", "parent_id")
    lowest = known.join(named, "cell_id", "left_semi").where("cell_id = stem").select("cell_id", F.lit(True).alias("__lowest"))
    values = known.select("cell_id", "stem", "depth", "acc", "second").join(lowest, "cell_id", "left")
    met = members(intervals(net), at, values).where(F.col("__lowest") & (F.col("stem") != F.col("__stem")) & (F.col("second") >= F.col("least")))
    met = met.select("outlet_id", F.col("cell_id").alias("path_id"), (F.col("depth") - F.col("__depth")).alias("depth"), "acc")
    own = at.where(F.col("__second") >= F.col("least")).join(named.withColumnRenamed("cell_id", "outlet_id"), "outlet_id", "left_semi").select("outlet_id", F.col("outlet_id").alias("cell_id"))
    own = own.join(known.select("cell_id", "acc"), "cell_id").select("outlet_id", F.col("cell_id").alias("path_id"), F.lit(0).cast("long").alias("depth"), "acc")
    return met.union(own)


def levels(cells: DataFrame, thresholds: tuple[float, ...] = (20000.0, 1500.0, 250.0)) -> DataFrame:
    """cells as `api.build` makes them, with strahler or not. A row a reach and level of detail: lod, reach_id, cells, head, tail,
    up, dn (areas at its ends, to one place), so (the order at its end), x and y of its end."""
    acc = cells.select("cell_id", "parent_id", "acc")
    so = F.col("strahler") if "strahler" in cells.columns else F.lit(None).cast("int")
    ends = cells.select(F.col("cell_id").alias("tail"), so.alias("so"), "x", "y")
    out = None
    for lod, threshold in enumerate(thresholds):
        found = summarise(extract(acc, threshold), acc).join(ends, "tail").select(F.lit(lod).alias("lod"), "reach_id", "cells", "head", "tail", F.round("up", 1).alias("up"), F.round("dn", 1).alias("dn"), "so", "x", "y")
        out = found if out is None else out.union(found)
    return out


def rounded(point: Column, lod: int) -> Column:
    """A vertex as a level of layers() has it. Rounding twice is not rounding once, so what is compared with a level goes through
    this alone."""
    places = 5 if lod < 2 else 4
    return F.struct(F.round(point["lon"], places).alias("lon"), F.round(point["lat"], places).alias("lat"))


def layers(cells: DataFrame, thresholds: tuple[float, ...] = (20000.0, 1500.0, 250.0), tolerances: tuple[float, ...] = (0.02, 0.005, 0.0025), zoom: int = 8, x0: int = 0, y0: int = 0) -> DataFrame:
    """The reaches of levels() as lines to draw: lod, line_id, up, dn, so, coords, each level simplified with a tolerance (degrees)
    of its own, rounded to 5 places, and to 4 on the levels from 2 on. Ends of reaches that meet are the same vertex."""
    acc, out = cells.select("cell_id", "parent_id", "acc"), None
    known = levels(cells, thresholds)
    for lod, (threshold, tolerance) in enumerate(zip(thresholds, tolerances, strict=True)):
        given = cut(lines(extract(acc, threshold), cells, zoom, x0, y0))
        thin = generalise.simplified(given, tolerance)
        thin = thin.withColumn("coords", F.transform("coords", lambda p: rounded(p, lod)))
        own = known.where(F.col("lod") == lod).select("lod", F.col("reach_id").alias("line_id"), "up", "dn", "so")
        own = own.join(thin.select("line_id", "coords"), "line_id").select("lod", "line_id", "up", "dn", "so", "coords")
        out = own if out is None else out.union(own)
    return out


def probes(vertices: DataFrame, most: int = 8) -> DataFrame:
    """vertices: reach_id, seq, lon, lat. Up to eight of each reach, evenly from the first on."""
    n = F.count(F.lit(1)).over(W.partitionBy("reach_id"))
    out = vertices.withColumn("__i", F.row_number().over(W.partitionBy("reach_id").orderBy("seq")) - 1).withColumn("__k", F.greatest(F.lit(1), F.floor(n / most)))
    return out.where((F.col("__i") % F.col("__k") == 0) & (F.col("__i") < most * F.col("__k"))).drop("__i", "__k")


def centrelines(*layers: DataFrame) -> DataFrame:
    """layers: owner, seq, lon, lat, name, name_en, in the order in which they count. One table of vertices (owner, seq, lon,
    lat, name) of lines that have a name in either language, under its one name; owners of later layers follow."""
    out = None
    for k, layer in enumerate(layers):
        rows = layer.select((F.lit(k).cast("long") * 2**40 + F.col("owner")).alias("owner"), "seq", "lon", "lat", canonical(F.coalesce(F.nullif("name", F.lit("")), "name_en")).alias("name")).where("name is not null and name <> ''")
        out = rows if out is None else out.union(rows)
    return out


def named_by_lines(reaches: DataFrame, vertices: DataFrame, lines: DataFrame, reach: float = 0.06) -> DataFrame:
    """reaches (as from summarise()) with name: voted by their probes' nearest lines within `reach` degrees, then passed on from
    the reaches that they run into. vertices: reach_id, seq, lon, lat."""
    asked = probes(vertices).select(F.struct("reach_id", "seq").alias("point_id"), "lon", "lat")
    near = shapes.nearest_line(asked, lines, reach).join(lines.select("owner", "name").distinct(), "owner")
    met = asked.select("point_id").join(near.select("point_id", "name"), "point_id", "left").select("point_id.*", "name")
    return propagate(reaches.join(vote(met).select("reach_id", "name"), "reach_id", "left"))
