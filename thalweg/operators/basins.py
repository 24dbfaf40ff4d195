"""Basins: their statistics, countries, seas, names, discharges and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import hydraulics as h
from ..sources.rivers import sea_of
from . import polygons as parts
from . import shapes
from .rasters import EDGE, ICE, LAKE, OCEAN

# km2 of a basin and of one that gets an outline; countries of a basin, and their least share in percent; reach
# of the search for a sea, degrees; share of the largest area that a river must have to name a basin.
LEAST, OUTLINED, COUNTRIES, SHARE, SEA_REACH, MAIN = 250, 3000, 6, 0.4, 1.5, 0.6


def outlets(cells: DataFrame, least: float = LEAST) -> DataFrame:
    """cell_id, acc of the cells where basins of `least` or more end."""
    return cells.where((F.col("dir") == 0) & (F.col("acc") >= least)).select("cell_id", "acc")


def statistics(cells: DataFrame, least: float = LEAST) -> DataFrame:
    """cells: cell_id, term, dir, acc, z, cls. A row a basin: basin_id (its outlet), area, cells, max_elev, min_elev, mean_elev,
    ice_pct, lake_pct."""
    sums = cells.groupBy(F.col("term").alias("basin_id")).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("z").alias("sum_z"), F.min("z").alias("min_elev"), F.max("z").alias("max_elev"),
        F.count_if(F.col("cls") == ICE).alias("ice"), F.count_if(F.col("cls") == LAKE).alias("lake"),
    )
    pct = lambda c: F.round(F.col(c) * 100.0 / F.col("cells"), 2).alias(f"{c}_pct")
    out = outlets(cells, least).withColumnsRenamed({"cell_id": "basin_id", "acc": "area"}).join(sums, "basin_id")
    return out.select("basin_id", "area", "cells", "max_elev", "min_elev", (F.col("sum_z") / F.col("cells")).alias("mean_elev"), pct("ice"), pct("lake"))


def countries(cells: DataFrame, basins: DataFrame, country: str = "country") -> DataFrame:
    """basin_id, country, cells, pct: the six countries of most cells in each basin, the smaller code on ties, from 0.4 % on;
    the share is of all cells of the basin."""
    counts = cells.where(F.col(country).isNotNull()).groupBy(F.col("term").alias("basin_id"), country).agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(basins.select("basin_id", F.col("cells").alias("__all")), "basin_id")
    met = met.withColumn("__share", F.col("n") * 100.0 / F.col("__all")).withColumn("__r", F.row_number().over(W.partitionBy("basin_id").orderBy(F.desc("n"), country)))
    return met.where((F.col("__r") <= COUNTRIES) & (F.col("__share") >= SHARE)).select("basin_id", country, F.col("n").alias("cells"), F.round("__share", 1).alias("pct"))


def seas(points: DataFrame, marine: DataFrame) -> DataFrame:
    """points: basin_id, lon, lat, cls of outlets; marine: poly_id, rings, name. Adds sea, sea_group: of the nearest marine
    area within 1.5 degrees of an outlet in the ocean (0 inside it, the smaller poly_id on ties); outlets at the edge, in
    lakes and elsewhere have names of their own."""
    at = points.where(F.col("cls") == OCEAN).select(F.col("basin_id").alias("point_id"), "lon", "lat")
    near = shapes.nearest_polygon(at, marine, SEA_REACH).join(marine.select("poly_id", "name"), "poly_id", "left")
    out = points.join(near.select(F.col("point_id").alias("basin_id"), F.col("name").alias("__m")), "basin_id", "left")
    inland = F.struct(F.lit("Inland sink").alias("sea"), F.lit("endorheic").alias("sea_group"))
    found = F.when(F.col("cls") == OCEAN, F.coalesce(sea_of(F.col("__m"), F.col("lon"), F.col("lat")), inland))
    found = found.when(F.col("cls") == EDGE, F.struct(F.lit("Beyond the map edge").alias("sea"), F.lit("offmap").alias("sea_group")))
    found = found.when(F.col("cls") == LAKE, F.struct(F.lit("Inland lake").alias("sea"), F.lit("lake").alias("sea_group"))).otherwise(inland)
    return out.withColumn("__s", found).select(*points.columns, "__s.sea", "__s.sea_group")


def main_stems(reaches: DataFrame) -> DataFrame:
    """reaches: basin_id, name, dn. basin_id, river: of the rivers with 0.6 of the largest area in a basin, the one of most
    reaches, then of most area, then the smaller name."""
    rivers = reaches.where("name is not null and basin_id is not null").groupBy("basin_id", "name").agg(F.max("dn").alias("dn"), F.count(F.lit(1)).alias("n"))
    best = rivers.withColumn("__most", F.max("dn").over(W.partitionBy("basin_id"))).where(F.col("dn") >= MAIN * F.col("__most"))
    first = F.row_number().over(W.partitionBy("basin_id").orderBy(F.desc("n"), F.desc("dn"), "name"))
    return best.withColumn("__r", first).where("__r = 1").select("basin_id", F.col("name").alias("river"), "dn", "n")


def labelled(basins: DataFrame) -> DataFrame:
    """basins (river, sea) with name."""
    name = F.coalesce(F.concat("river", F.lit(" basin")), F.concat(F.lit("Coastal basin ("), F.col("sea"), F.lit(")")))
    return basins.withColumn("name", name)


def build(cells: DataFrame, marine: DataFrame, reaches: DataFrame | None = None, least: float = LEAST, zoom: int = 8, x0: int = 0, y0: int = 0) -> DataFrame:
    """cells as `api.build` makes them, with country; reaches: reach_id, tail (a cell), name, dn. A row a basin with all of the
    above and an array of countries, the largest basin first."""
    found = statistics(cells, least)
    lon, lat = g.pixel_to_lon(F.col("x") + x0 + 0.5, zoom), g.pixel_to_lat(F.col("y") + y0 + 0.5, zoom)
    ends = cells.select(F.col("cell_id").alias("basin_id"), "x", "y", "cls", F.round(lon, 4).alias("lon"), F.round(lat, 4).alias("lat"))
    out = seas(found.join(ends, "basin_id"), marine)
    shares = countries(cells, found).groupBy("basin_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("cells")).alias("o"), "country", "pct"))).alias("__c"))  # six at most
    out = out.join(shares, "basin_id", "left").withColumn("countries", F.transform("__c", lambda c: F.struct(c["country"].alias("iso"), c["pct"].alias("pct")))).drop("__c")
    if reaches is None:
        out = out.withColumn("river", F.lit(None).cast("string"))
    else:
        placed = reaches.join(cells.select(F.col("cell_id").alias("tail"), F.col("term").alias("basin_id")), "tail").join(found.select("basin_id"), "basin_id", "left_semi")
        out = out.join(main_stems(placed).select("basin_id", "river"), "basin_id", "left")
    return labelled(out).orderBy(F.desc("area"), "basin_id")


def with_discharge(basins: DataFrame, q: DataFrame) -> DataFrame:
    """basins with discharge (m3/s at the outlet, from q: cell_id, q) and runoff (mm a year)."""
    out = basins.join(q.select(F.col("cell_id").alias("basin_id"), F.col("q").alias("__q")), "basin_id", "left")
    return out.withColumns({"discharge": F.round("__q", 2), "runoff": F.round(F.col("__q") * h.YEAR / F.greatest(F.col("area"), F.lit(1e-9)), 1)}).drop("__q")


def compared(basins: DataFrame, one: int, two: int) -> DataFrame:
    """area_ratio and discharge_ratio of two basins (basin_id); a missing discharge counts as 1."""
    side = lambda k: F.max_by(F.struct("area", F.coalesce(F.col("discharge"), F.lit(1.0)).alias("q")), F.col("basin_id") == k)
    both = basins.where(F.col("basin_id").isin(one, two)).agg(side(one).alias("a"), side(two).alias("b"), F.count_distinct("basin_id").alias("n"))
    return both.where(F.col("n") == (1 if one == two else 2)).select((F.col("a.area") / F.col("b.area")).alias("area_ratio"), (F.col("a.q") / F.col("b.q")).alias("discharge_ratio"))


def polygons(cells: DataFrame, basins: DataFrame, zoom: int = 8, x0: int = 0, y0: int = 0, factor: int = 4, least: float = OUTLINED, tolerance: float = 0.004) -> DataFrame:
    """Basins of `least` km2 or more as polygons with holes, from every `factor`-th cell either way, with what is known of each:
    basin_id, part, depth, inside, cells, rings and name, area, sea, sea_group, river (null where basins lack the column); the
    largest basin first, then the largest part. Write them with tiles.to_geojson()."""
    known = basins.where(F.col("area") >= least).select("basin_id", "area", *((F.col(c) if c in basins.columns else F.lit(None).cast("string")).alias(c) for c in ("name", "sea", "sea_group", "river")))
    some = cells.where((F.col("x") % factor == 0) & (F.col("y") % factor == 0)).select(F.col("term").alias("mask_id"), (F.col("x") + x0).alias("px"), (F.col("y") + y0).alias("py"))
    found = parts.polygons(some.join(known.select(F.col("basin_id").alias("mask_id")), "mask_id", "left_semi"), zoom, factor, tolerance)
    out = found.withColumnRenamed("mask_id", "basin_id").join(known, "basin_id")
    return out.select("basin_id", "part", "depth", "inside", "cells", "rings", "name", "area", "sea", "sea_group", "river").orderBy(F.desc("area"), "basin_id", "part")


def outlines(cells: DataFrame, basins: DataFrame, zoom: int = 8, x0: int = 0, y0: int = 0, factor: int = 4, least: float = OUTLINED) -> DataFrame:
    """mask_id (the basin), ring, coords: outlines of basins of `least` km2 or more, from every `factor`-th cell either way."""
    large = basins.where(F.col("area") >= least).select(F.col("basin_id").alias("mask_id"))
    some = cells.where((F.col("x") % factor == 0) & (F.col("y") % factor == 0)).select(F.col("term").alias("mask_id"), (F.col("x") + x0).alias("px"), (F.col("y") + y0).alias("py"))
    return shapes.rings(some.join(large, "mask_id", "left_semi"), zoom, factor)
