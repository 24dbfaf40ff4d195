"""Rows along paths (drop_id, step): distances, profiles, names of what they pass, tributaries, samples, travel times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import hydraulics as h
from ..functions.lineage import cut
from . import shapes
from .flow import chase, trace

# Classes of cells, the area (km2) from which a path has a river's name, reach of the search for it (degrees),
# samples of countries a path, reach of the search for a tributary's name and how far off its area may be.
OCEAN, LAKE = 1, 2
NAMED_AREA, NAME_REACH, SAMPLES, TRIBUTARY_REACH, TRIBUTARY_ERROR = 120, 0.045, 900, 0.07, 3


def order() -> W:
    return W.partitionBy("drop_id").orderBy("step")


def whole() -> W:
    return W.partitionBy("drop_id")


def carry(rows: DataFrame, column: str, gate: Column, backward: bool = False) -> DataFrame:
    """rows with nulls of `column` filled by the row before (after), as filled itself, while `gate` holds."""
    way = W.partitionBy("drop_id").orderBy(F.desc("step") if backward else "step")
    starts = F.col(column).isNotNull() | ~F.coalesce(gate, F.lit(False))
    rows = rows.withColumn("__start", starts).withColumn("__island", F.sum(F.col("__start").cast("int")).over(way))
    island = W.partitionBy("drop_id", "__island")
    return rows.withColumn(column, F.max(F.when(F.col("__start"), F.col(column))).over(island)).drop("__start", "__island")


def decorate(rows: DataFrame) -> DataFrame:
    """rows: drop_id, step, lon, lat, cls, area, elev (both nullable, NaN counts as null). Adds dist (metres along the path);
    elev never climbs: before its first value it takes that value, and 0 if there is none; area keeps its last value, 0
    before the first; sea_at: how many rows to draw. A path that ends in the ocean (its last class) leaves out trailing rows
    at -1 m or lower, three at most, but never the first two."""
    elev, area = (F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in ("elev", "area"))
    hop = F.coalesce(g.haversine(F.lag("lon").over(order()), F.lag("lat").over(order()), F.col("lon"), F.col("lat")), F.lit(0.0))
    out = rows.withColumns({"elev": elev, "area": area, "__hop": hop})
    out = out.withColumns({
        "dist": F.sum("__hop").over(order()),
        "area": F.coalesce(F.last("area", True).over(order()), F.lit(0.0)),
        "elev": F.coalesce(F.min("elev").over(order()), F.first("elev", True).over(order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0.0)),
        "__back": F.row_number().over(W.partitionBy("drop_id").orderBy(F.desc("step"))),
        "__n": F.count(F.lit(1)).over(whole()),
        "__end": F.max_by("cls", "step").over(whole()),
    })
    dry = F.min(F.when((F.col("elev") > -1) | F.col("elev").isNull(), F.col("__back"))).over(whole())
    wet = F.least(F.coalesce(dry - 1, F.col("__n")), F.lit(3), F.greatest(F.col("__n") - 2, F.lit(0)))
    out = out.withColumn("sea_at", (F.col("__n") - F.when(F.col("__end") == OCEAN, wet).otherwise(0)).cast("long"))
    return out.drop("__hop", "__back", "__n", "__end")


def named(paths: DataFrame, reaches: DataFrame | None = None, countries: DataFrame | None = None, lakes: DataFrame | None = None) -> DataFrame:
    """paths: drop_id, step, lon, lat, area, cls. reaches: vertices owner, seq, lon, lat, up, dn, name; countries, lakes:
    poly_id, rings, name. Adds river (even steps and the last one of over 120 km2, by the nearest reach of like area), country
    (some 900 samples a path, carried on) and lake (those samples on lake cells)."""
    n = F.max("step").over(whole())
    out = paths.withColumn("__last", F.col("step") == n).withColumn("__every", F.greatest(F.lit(1), F.floor((n + 1) / SAMPLES)))
    out = out.withColumn("__sample", (F.col("step") % F.col("__every") == 0) | F.col("__last"))
    key = F.struct("drop_id", "step").alias("point_id")
    blank = F.lit(None).cast("string")
    if reaches is None:
        out = out.withColumn("river", blank)
    else:
        asked = out.where((F.col("area") > NAMED_AREA) & ((F.col("step") % 2 == 0) | F.col("__last"))).select(key, "lon", "lat", "area")
        names = reaches.where("name is not null").select("owner", "name").distinct()
        found = shapes.best_near(asked, reaches, NAME_REACH).where("owner is not null").join(names, "owner").select("point_id.*", F.col("name").alias("river"))
        out = out.join(found, ["drop_id", "step"], "left")
    for column, polygons, some in (("country", countries, F.col("__sample")), ("lake", lakes, F.col("__sample") & (F.col("cls") == LAKE))):
        if polygons is None:
            out = out.withColumn(column, blank)
            continue
        found = shapes.point_in_polygon(out.where(some).select(key, "lon", "lat"), polygons).where("poly_id is not null")
        found = found.join(polygons.select("poly_id", "name"), "poly_id").select("point_id.*", F.col("name").alias(column))
        out = out.join(found, ["drop_id", "step"], "left")
    out = out.withColumn("country", F.last("country", True).over(order()))
    return out.drop("__last", "__every", "__sample")


def named_cells(cells: DataFrame, reaches: DataFrame, countries: DataFrame, lakes: DataFrame) -> DataFrame:
    """cells: cell_id, lon, lat, area, cls. cell_id, river, country, lake: what named() says of a step there, where it asks."""
    key = F.col("cell_id").alias("point_id")
    names = reaches.where("name is not null").select("owner", "name").distinct()
    rivers = shapes.best_near(cells.where(F.col("area") > NAMED_AREA).select(key, "lon", "lat", "area"), reaches, NAME_REACH).where("owner is not null")
    out = cells.select("cell_id").join(rivers.join(names, "owner").select(F.col("point_id").alias("cell_id"), F.col("name").alias("river")), "cell_id", "left")
    for column, polygons, some in (("country", countries, F.lit(True)), ("lake", lakes, F.col("cls") == LAKE)):
        held = shapes.point_in_polygon(cells.where(some).select(key, "lon", "lat"), polygons).join(polygons.select("poly_id", "name"), "poly_id")
        out = out.join(held.select(F.col("point_id").alias("cell_id"), F.col("name").alias(column)), "cell_id", "left")
    return out


def counted(runs: DataFrame) -> DataFrame:
    """runs: drop_id, first, last, label (river, country, lake, as of named_cells()). drop_id, river, country, lake, rows: how many
    steps named() would give these. A run is at most three pieces: what is before its first sample, which has the country
    before, what begins with it, and the last step of the path."""
    end = F.max("last").over(whole())
    runs = runs.select("drop_id", "label.*", "first", "last", end.alias("end"), F.greatest(F.lit(1), F.floor((end + 1) / SAMPLES)).alias("k"))
    k, until = F.col("k"), F.when(F.col("last") == F.col("end"), F.col("last") - 1).otherwise(F.col("last"))
    sample = F.ceil(F.col("first") / k) * k
    piece = lambda a, b, of, sampled: F.struct(a.alias("a"), b.alias("b"), F.lit(of).alias("ends"), F.when(F.lit(sampled), F.col("country")).alias("own"))
    pieces = F.array(piece(F.col("first"), F.least(sample - 1, until), False, False), piece(sample, until, False, True), piece(until + 1, F.col("last"), True, True))
    each = runs.select("drop_id", "river", "lake", "k", F.explode(F.filter(pieces, lambda p: p["a"] <= p["b"])).alias("p")).select("drop_id", "river", "lake", "k", "p.*")
    each = each.withColumn("country", F.last("own", True).over(W.partitionBy("drop_id").orderBy("a")))
    multiples = lambda m: F.floor(F.col("b") / m) - F.floor((F.col("a") - 1) / m)
    n = F.col("b") - F.col("a") + 1
    even, sampled, both = (F.when(F.col("ends"), n).otherwise(multiples(m)) for m in (F.lit(2), k, F.when(k % 2 == 0, k).otherwise(2 * k)))
    none = F.lit(None).cast("string")
    kinds = ((F.col("river"), F.col("lake"), both), (F.col("river"), none, even - both), (none, F.col("lake"), sampled - both), (none, none, n - even - sampled + both))
    told = F.explode(F.array(*(F.struct(r.alias("river"), l.alias("lake"), c.alias("rows")) for r, l, c in kinds))).alias("t")
    return each.select("drop_id", "country", told).select("drop_id", "t.river", "country", "t.lake", "t.rows").where("rows > 0").groupBy("drop_id", "river", "country", "lake").agg(F.sum("rows").alias("rows"))


def tributaries(paths: DataFrame, reaches: DataFrame | None = None, top: int = 6) -> DataFrame:
    """Where the area of a path jumps by more than 25 km2 and 8 %: drop_id, rank, step, dist, gain, lon, lat, the `top` largest
    a path, the first on ties; and with reaches their name, where a reach near by drains about that much."""
    met = paths.withColumn("__before", F.lag("area").over(order())).withColumn("gain", F.col("area") - F.col("__before"))
    met = met.where(F.col("gain") > F.greatest(F.lit(25.0), F.col("__before") * 0.08))
    rank = F.row_number().over(W.partitionBy("drop_id").orderBy(F.desc("gain"), "step"))
    met = met.withColumn("rank", rank).where(F.col("rank") <= top).select("drop_id", "rank", "step", "dist", "gain", *(c for c in ("lon", "lat") if c in paths.columns))
    if reaches is None:
        return met
    asked = met.select(F.struct("drop_id", "step").alias("point_id"), "lon", "lat", F.col("gain").alias("area"))
    ends = reaches.where("name is not null").groupBy("owner").agg(F.max("name").alias("name"), F.max("dn").alias("dn"))
    found = shapes.best_near(asked, reaches, TRIBUTARY_REACH).join(asked.select("point_id", "area"), "point_id").join(ends, "owner")
    found = found.where(F.abs(F.col("dn") - F.col("area")) / F.greatest(F.col("area"), F.lit(1.0)) < TRIBUTARY_ERROR)
    return met.join(found.select("point_id.*", "name"), ["drop_id", "step"], "left")


def slopes() -> Column:
    """The fall over twelve rows either way, by their distance, 0.00003 at least."""
    window = order().rowsBetween(-12, 12)
    run = F.last("dist").over(window) - F.first("dist").over(window)
    fall = F.first("elev").over(window) - F.last("elev").over(window)
    return F.when(run > 0, F.greatest(F.lit(3e-5), fall / run)).otherwise(F.lit(3e-5))


def travel(paths: DataFrame, runoff: Column | float = 300.0) -> DataFrame:
    """paths: drop_id, step, dist, area, elev. A row a path: drop_id, distance, seconds, mean_velocity, max_elev, min_elev,
    fall, slope, final_area, discharge. runoff: mm a year, a number or a column that is the same along a path."""
    return analysed(paths, runoff, 0)


def analysed(paths: DataFrame, runoff: Column | float = 300.0, top: int = 6) -> DataFrame:
    """What travel() says of each path and, unless top is 0, tributaries: an array of step, dist, gain (lon and lat, where there are
    such columns) of those of tributaries(), the largest first; countries, in the order of first sight, if there is such a column; and
    the box lon0, lat0, lon1, lat1. One pass: rows are dealt and sorted by path once, for all windows and the sums. An area
    that grows by 8 % each time can't do so often, so the array is short."""
    mm = runoff if isinstance(runoff, Column) else F.lit(float(runoff))
    before = F.lag("area").over(order())
    out = paths.withColumns({"__mm": mm, "__d": F.col("dist") - F.lag("dist").over(order()), "__s": slopes(), "__gain": F.col("area") - before, "__before": before})
    out = out.withColumn("__v", F.when(F.col("__d") > 0, h.velocity(F.col("area"), F.col("__s"), F.col("__mm"))))
    more, also = [], []
    if top:
        at = [c for c in ("lon", "lat") if c in paths.columns]
        met = F.when(F.col("__gain") > F.greatest(F.lit(25.0), F.col("__before") * 0.08), F.struct((-F.col("__gain")).alias("o"), "step", "dist", F.col("__gain").alias("gain"), *at))
        more.append(F.slice(F.sort_array(F.collect_list(met)), 1, top).alias("__t"))
        also.append(F.transform("__t", lambda x: F.struct(*(x[c].alias(c) for c in ("step", "dist", "gain", *at)))).alias("tributaries"))
        if "country" in paths.columns:
            out = out.withColumn("__new", F.col("country").isNotNull() & ~F.col("country").eqNullSafe(F.lag("country").over(order())))
            more.append(F.sort_array(F.collect_list(F.when(F.col("__new"), F.struct("step", "country")))).alias("__c"))
            also.append(F.array_distinct(F.transform("__c", lambda x: x["country"])).alias("countries"))
        if at:
            more += [f(c).alias(n) for f, c, n in ((F.min, "lon", "lon0"), (F.min, "lat", "lat0"), (F.max, "lon", "lon1"), (F.max, "lat", "lat1"))]
            also += ["lon0", "lat0", "lon1", "lat1"]
    out = out.groupBy("drop_id").agg(
        F.max("dist").alias("distance"), F.coalesce(F.sum(F.col("__d") / F.col("__v")), F.lit(0.0)).alias("seconds"), F.sum(F.col("__d") * F.col("__v")).alias("vd"),
        F.max("elev").alias("max_elev"), F.min("elev").alias("min_elev"), F.max_by("area", "step").alias("final_area"), F.max("__mm").alias("mm"), *more,
    )
    moved, fall = F.col("distance") > 0, F.col("max_elev") - F.col("min_elev")
    return out.select(
        "drop_id", "distance", "seconds", F.when(moved, F.col("vd") / F.col("distance")).otherwise(0.0).alias("mean_velocity"), "max_elev", "min_elev", fall.alias("fall"),
        F.when(moved, fall / F.col("distance")).otherwise(0.0).alias("slope"), "final_area", h.discharge(F.col("final_area"), F.col("mm")).alias("discharge"), *also,
    )


def extent(paths: DataFrame) -> DataFrame:
    """The box and profile of each path: drop_id, lon0, lat0, lon1, lat1, low, high and span (of elevations, 20 m at least)."""
    ends = paths.groupBy("drop_id").agg(*(f(c).alias(n) for f, c, n in ((F.min, "lon", "lon0"), (F.min, "lat", "lat0"), (F.max, "lon", "lon1"), (F.max, "lat", "lat1"), (F.min, "elev", "low"), (F.max, "elev", "high"))))
    return spanned(ends)


def spanned(ends: DataFrame) -> DataFrame:
    """ends: low, high. Adds span."""
    return ends.withColumn("span", F.greatest(F.col("high") - F.col("low"), F.lit(20.0)))


def resampled(paths: DataFrame, samples: int = 420) -> DataFrame:
    """Every k-th row and the last, so that a path has about `samples` rows."""
    n = F.count(F.lit(1)).over(whole())
    out = paths.withColumn("__k", F.greatest(F.lit(1), F.floor(n / samples))).withColumn("__last", F.max("step").over(whole()))
    return out.where((F.col("step") % F.col("__k") == 0) | (F.col("step") == F.col("__last"))).drop("__k", "__last")


def steps_of(acc: DataFrame, drops: DataFrame, every: Callable[[Column], Column]) -> DataFrame:
    """acc: cell_id, parent_id, acc, without cycles; drops: drop_id, cell_id. drop_id, step, cell_id: every k-th step of each path and the
    last one, k being every(steps to the end). What is listed between are stems, which a path passes few of: a stem goes on
    where most water comes from, so each one drains more than twice as much as the one before. A cell is known by its
    stem and its steps to the end."""
    rank = F.row_number().over(W.partitionBy("parent_id").orderBy(F.desc("acc"), "cell_id"))
    ranked = cut(acc.select(F.col("cell_id").alias("node"), F.col("parent_id").alias("to"), F.lit(1).alias("weight"), (F.col("parent_id").isNotNull() & (rank == 1)).alias("main")))
    stems = chase(ranked.select("node", F.when(F.col("main"), F.col("to")).alias("to"), "weight"))
    ends = chase(ranked.select("node", "to", "weight"))
    known = stems.select(F.col("node").alias("cell_id"), F.col("root").alias("stem")).join(ends.select(F.col("node").alias("cell_id"), F.col("total").alias("left")), "cell_id")
    known = cut(known)
    lows = known.where("cell_id = stem").join(ranked.where("not main").select(F.col("node").alias("cell_id"), F.col("to").alias("below")), "cell_id")
    after = known.select(F.col("cell_id").alias("below"), F.col("stem").alias("parent_id"))
    lows = cut(lows.join(after, "below", "left").select("stem", "parent_id", F.col("left").alias("low")))
    on = cut(drops.select("drop_id", "cell_id").join(known, "cell_id").select("drop_id", "stem", "left"))
    passed = trace(lows.select(F.col("stem").alias("cell_id"), "parent_id"), on.select("drop_id", F.col("stem").alias("cell_id"))).select("drop_id", F.col("step").alias("nth"), F.col("cell_id").alias("stem"))
    met = passed.join(lows.select("stem", "low"), "stem").join(on.select("drop_id", "left"), "drop_id")
    enters = F.coalesce(F.lag("low").over(W.partitionBy("drop_id").orderBy("nth")) - 1, F.col("left"))
    k = every(F.col("left")).cast("long")
    met = met.select("drop_id", "stem", "left", k.alias("k"), (F.col("left") - enters).alias("from"), (F.col("left") - F.col("low")).alias("until"))
    begin = F.ceil(F.col("from") / F.col("k")) * F.col("k")
    some = F.when(begin <= F.col("until"), F.sequence(begin, F.col("until"), F.col("k"))).otherwise(F.array().cast("array<bigint>"))
    last = F.when((F.col("until") == F.col("left")) & (F.col("left") % F.col("k") != 0), F.array("left")).otherwise(F.array().cast("array<bigint>"))
    asked = met.select("drop_id", "stem", "left", F.explode(F.concat(some, last)).alias("step")).select("drop_id", "step", "stem", (F.col("left") - F.col("step")).alias("left"))
    return asked.join(known, ["stem", "left"]).select("drop_id", "step", "cell_id")


def at_distance(paths: DataFrame, metres: float, *columns: str) -> DataFrame:
    """drop_id, step (the row before) and the columns, linear between the rows before and after `metres`; paths that end
    before are left out."""
    out = paths.select("drop_id", "step", "dist", F.lead("dist").over(order()).alias("__d"), *columns, *(F.lead(c).over(order()).alias(f"__{c}") for c in columns))
    out = out.where((F.col("dist") <= metres) & (F.col("__d") > metres)).withColumn("__t", (metres - F.col("dist")) / (F.col("__d") - F.col("dist")))
    return out.select("drop_id", "step", *((F.col(c) + (F.col(f"__{c}") - F.col(c)) * F.col("__t")).alias(c) for c in columns))


def ordered_distinct(paths: DataFrame, column: str) -> DataFrame:
    """drop_id, place (from 1) and what a path passes, in the order of first sight."""
    first = paths.where(F.col(column).isNotNull()).groupBy("drop_id", column).agg(F.min("step").alias("__first"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("drop_id").orderBy("__first"))).select("drop_id", "place", column)


def animation(paths: DataFrame, depth: Column | None = None) -> DataFrame:
    """at (seconds) and width of each row of upstream paths: a minute a depth and 0.8 s a row; 2.2 times the logarithm of the
    area, from 1.2 to 8."""
    deep = F.col("depth") if depth is None else depth
    return paths.withColumn("at", deep * 60 + F.col("step") * 0.8).withColumn("width", h.clip(2.2 * F.log10(F.greatest(F.col("area"), F.lit(1.0))), 1.2, 8))


def storm_layout(paths: DataFrame, group: int = 4096) -> DataFrame:
    """first: where the points of each path begin in a flat array of all of them, paths in the order of drop_id; drop_id, n,
    first."""
    return laid_out(paths.groupBy("drop_id").agg(F.count(F.lit(1)).alias("n")), group)


def laid_out(sizes: DataFrame, group: int = 4096) -> DataFrame:
    """sizes: drop_id, n. storm_layout() of paths of so many points. Sums are in two levels, so that no window holds more than a group of
    paths or a row for each group."""
    sizes = sizes.withColumn("__g", F.floor(F.col("drop_id") / group))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    base = sizes.groupBy("__g").agg(F.sum("n").alias("s"))
    base = base.select("__g", F.coalesce(F.sum("s").over(before(W.orderBy("__g"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(before(W.partitionBy("__g").orderBy("drop_id"))), F.lit(0))
    return sizes.withColumn("__in", within).join(base, "__g").select("drop_id", "n", (F.col("base") + F.col("__in")).alias("first"))
