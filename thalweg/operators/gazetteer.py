"""Places and names to search for: a gazetteer of towns and rivers, an index of all kinds, layers cut from features, labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hydraulics as h
from ..sources.rivers import STUDY_AREA
from . import shapes
from .search import folded

# People from which a town is in the index, or in the layer of places; basins of the index; ranks of kinds that
# have one for all; sizes of the pools of labels; zooms from which a kind is labelled, and those of towns and rivers by rank.
INDEXED, LAYERED, BASINS = 20000, 25000, 400
RANKS = {"peak": 4, "lake": 4, "basin": 3}
POOLS = {"town": 900, "river": 420, "lake": 220, "peak": 130}
LEAST_ZOOM, BY_RANK = {"town": 4, "river": 5, "lake": 6, "peak": 7}, {"town": (3.2, 0.7), "river": (3.8, 0.8)}
SEA_ZOOM = (2.2, 0.75)


def in_study_area(lon: Column, lat: Column) -> Column:
    west, south, east, north = STUDY_AREA
    return lon.between(west, east) & lat.between(south, north)


def cities(raw: DataFrame) -> DataFrame:
    """raw: name, lng, lat, country, and id, their order, as they were read (strings or numbers). name, lon, lat, country of
    those in the study area that have a name and readable coordinates; of rows that agree in name and in coordinates to two
    places the first stays."""
    lon, lat = (F.expr(f"try_cast({c} AS double)") for c in ("lng", "lat"))
    rows = raw.select("id", F.trim("name").alias("name"), lon.alias("lon"), lat.alias("lat"), "country").where(in_study_area(F.col("lon"), F.col("lat")) & (F.col("name") != ""))
    once = rows.groupBy("name", F.round("lon", 2).alias("x"), F.round("lat", 2).alias("y")).agg(F.min_by(F.struct("lon", "lat", "country"), "id").alias("c"), F.min("id").alias("id"))
    return once.select("id", "name", F.round("c.lon", 4).alias("lon"), F.round("c.lat", 4).alias("lat"), "c.country")


def country_names(countries: DataFrame) -> DataFrame:
    """countries: poly_id, iso, name. iso, country: the first name of each code; those without one (null, '', -99) go."""
    fit = countries.where(F.col("iso").isNotNull() & ~F.col("iso").isin("", "-99"))
    return fit.groupBy("iso").agg(F.min_by("name", "poly_id").alias("country"))


def best_reaches(reaches: DataFrame) -> DataFrame:
    """reaches: reach_id, name, up, coords. name, size, lon, lat: of each name the reach that begins with the largest area, the
    first on ties, and the vertex in its middle; reaches without area go."""
    best = reaches.where("name is not null and up > 0").groupBy("name").agg(F.max_by(F.struct("up", "coords"), F.struct("up", -F.col("reach_id"))).alias("b"))
    middle = F.get("b.coords", F.floor(F.size("b.coords") / 2).cast("int"))
    return best.select("name", F.col("b.up").alias("size"), F.round(middle["lon"], 4).alias("lon"), F.round(middle["lat"], 4).alias("lat"))


def gazetteer(raw: DataFrame, countries: DataFrame, reaches: DataFrame | None = None) -> DataFrame:
    """name, kind (place or river), lon, lat, country, size (rounded area of rivers), rank (3 or 6): cities with the name of
    their country, if its code is known (else the code), and every named river."""
    places = cities(raw).withColumnRenamed("country", "__iso").join(country_names(countries), F.col("__iso") == F.col("iso"), "left")
    out = places.select("name", F.lit("place").alias("kind"), "lon", "lat", F.coalesce("country", "__iso").alias("country"), F.lit(None).cast("long").alias("size"))
    if reaches is not None:
        out = out.unionByName(best_reaches(reaches).select("name", F.lit("river").alias("kind"), "lon", "lat", F.lit(None).cast("string").alias("country"), F.bround("size").cast("long").alias("size")))
    return out.withColumn("rank", F.when(F.col("kind") == "river", 3).otherwise(6))


def index(towns: DataFrame, peaks: DataFrame, lakes: DataFrame, reaches: DataFrame, basins: DataFrame) -> DataFrame:
    """towns: name, lon, lat, country, population; peaks: name, lon, lat, elevation; lakes: name, rings; reaches as for
    best_reaches(); basins: name, river, lon, lat, area, sea. name, folded, kind, lon, lat, description, size, rank, by rank and
    population: towns of 20,000 in the study area, peaks there, lakes, rivers, and of the 400 largest basins those of a river."""
    four = lambda c: F.round(c, 4).alias(c)
    none = F.lit(None).cast("double")
    area = F.concat(F.format_number(F.bround("size"), 0), F.lit(" km² basin"))
    parts = [
        towns.where((F.col("population") >= INDEXED) & in_study_area(F.col("lon"), F.col("lat"))).select("name", F.lit("town").alias("kind"), four("lon"), four("lat"), F.col("country").alias("description"), F.col("population").cast("double").alias("size"), h.town_rank(F.col("population")).alias("rank")),
        peaks.where(in_study_area(F.col("lon"), F.col("lat"))).select("name", F.lit("peak").alias("kind"), four("lon"), four("lat"), F.concat(F.col("elevation").cast("string"), F.lit(" m")).alias("description"), none.alias("size"), F.lit(RANKS["peak"]).alias("rank")),
        lakes.select("name", F.lit("lake").alias("kind"), shapes.middle(F.col("rings")).alias("m")).where("m is not null").select("name", "kind", F.round("m.lon", 4).alias("lon"), F.round("m.lat", 4).alias("lat"), F.lit("Lake").alias("description"), none.alias("size"), F.lit(RANKS["lake"]).alias("rank")),
        best_reaches(reaches).select("name", F.lit("river").alias("kind"), "lon", "lat", area.alias("description"), F.bround("size").alias("size"), h.river_rank(F.greatest(F.col("size"), F.lit(1.0))).alias("rank")),
        basins.orderBy(F.desc("area"), "name").limit(BASINS).where("river is not null").select("name", F.lit("basin").alias("kind"), four("lon"), four("lat"), F.concat(F.lit("drains to the "), F.col("sea")).alias("description"), F.col("area").cast("double").alias("size"), F.lit(RANKS["basin"]).alias("rank")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    people = F.when(F.col("kind") == "town", F.col("size")).otherwise(0)
    return out.where("name is not null and name <> ''").withColumn("folded", folded("name")).orderBy("rank", F.desc(people), "kind", "name")


def layer(features: DataFrame, keep: dict[str, str], margin: float = 2.0, least_area: float = 0.0, tolerance: float = 0.0, where: Column | None = None, places: int = 4) -> DataFrame:
    """features: rings and properties (columns). Those that meet the study area widened by `margin`, cut to it, of at least
    `least_area` square degrees, simplified; `keep` renames properties, '' becomes null, numbers are rounded to two places."""
    west, south, east, north = STUDY_AREA
    rows = features if where is None else features.where(where)
    rows = shapes.clip(rows, west - margin, south - margin, east + margin, north + margin)
    if least_area:
        rows = rows.where(shapes.area(F.get("rings", F.lit(0))) >= least_area)
    if tolerance:
        thin = rows.withColumn("__id", F.monotonically_increasing_id()).select("*", F.posexplode("rings").alias("__at", "coords"))
        thin = shapes.simplify(thin, tolerance).groupBy(*[c for c in rows.columns if c != "rings"], "__id").agg(F.sort_array(F.collect_list(F.struct("__at", "coords"))).alias("__r"))
        rows = thin.withColumn("rings", F.transform("__r", lambda r: r["coords"])).drop("__id", "__r")
    kinds = dict(rows.dtypes)
    value = lambda c: F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.round(c, 2) if kinds[c] in ("double", "float") else F.col(c)
    point = lambda p: F.struct(F.round(p["lon"], places).alias("lon"), F.round(p["lat"], places).alias("lat"))
    return rows.select(*(value(a).alias(b) for a, b in keep.items()), F.transform("rings", lambda r: F.transform(r, point)).alias("rings"))


def pools(entries: DataFrame, sizes: dict[str, int] = POOLS) -> DataFrame:
    """entries: id, kind, rank, size. The first of each kind, by rank and size: id, kind, place (from 1). One pass a kind keeps
    the first in each task before any of them meet."""
    parts = []
    for kind, n in sizes.items():
        first = entries.where(F.col("kind") == kind).orderBy("rank", F.desc(F.coalesce("size", F.lit(0))), "id").limit(n)
        way = W.partitionBy("kind").orderBy("rank", F.desc(F.coalesce("size", F.lit(0))), "id")
        parts.append(first.withColumn("place", F.row_number().over(way)).select("id", "kind", "place"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def visible(entries: DataFrame, zoom: float) -> DataFrame:
    """entries (kind, rank) that a map of a zoom shows: seas by their rank; others from the zoom of their kind on, two or one
    earlier for the first ranks; towns and rivers by their rank as well."""
    rank, kind = F.col("rank"), F.col("kind")
    least = F.create_map(*[F.lit(x) for kv in LEAST_ZOOM.items() for x in kv])
    early = F.when(rank <= 1, 2).when(rank <= 3, 1).otherwise(0)
    fit = F.when(kind == "sea", zoom >= SEA_ZOOM[0] + rank * SEA_ZOOM[1]).otherwise(zoom >= F.coalesce(F.try_element_at(least, kind), F.lit(6)) - early)
    for name, (base, step) in BY_RANK.items():
        fit = fit & ((kind != name) | (zoom >= base + rank * step))
    return entries.where(fit)


def placed_labels(labels: DataFrame, width: float, height: float, most: int = 62) -> DataFrame:
    """labels: view (a map), place (the order in which they are tried), name, kind, px, py (pixels). view, place, name, kind, px,
    py of those that keep clear of the sides of a view of width by height and of the labels before, up to `most` of them.
    The boxes of a view are few: a group is a pool of labels."""

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        half = np.where(rows["kind"] == "sea", 7.4, 5.6) * rows["name"].str.len().to_numpy() / 2 + 7
        x, y = rows["px"].to_numpy(), rows["py"].to_numpy()
        fit = (x - half >= 10) & (x + half <= width - 10) & (y >= 62) & (y <= height - 70)
        held = np.zeros(0, int)
        for i in np.flatnonzero(fit):
            if len(held) > most:
                break
            apart = (np.abs(x[held] - x[i]) > half[held] + half[i]) | (np.abs(y[held] - y[i]) > 18)
            if apart.all():
                held = np.append(held, i)
        return rows.iloc[held]

    kept = labels.select("view", "place", "name", "kind", "px", "py")
    return kept.groupBy("view").applyInPandas(place, kept.schema)
