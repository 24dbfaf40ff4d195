"""All queries by name, and the same in DuckDB's SQL where it can say them.

The driver's tables hold no rasters, so the queries derive a grid, classes, countries and drops from orders and events by
arithmetic. Queries call the library, and their oracles are SQL of their own (core, surface, hydrology); plain joins and
groupings are statements that both engines read. In SQL {name} stands for a derived table: a DataFrame in Spark, a
subquery in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as g
from . import core, hydrology, layers, network, surface
from .statements import STATEMENTS
from .tables import BASE, Tables, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = core.QUERIES | surface.QUERIES | hydrology.QUERIES | layers.QUERIES | network.QUERIES
ORACLE_SQL: dict[str, str] = core.ORACLE_SQL | surface.ORACLE_SQL | hydrology.ORACLE_SQL | layers.ORACLE_SQL | network.ORACLE_SQL


def _statement(name: str, text: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(text)
    ORACLE_SQL[name] = duck(text)


for _name, _text in STATEMENTS.items():
    if _name not in QUERIES:
        _statement(_name, _text)


def lonlat_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir)("cells").select("cell_id", (F.lit(36352) + F.col("x")).alias("px"), (F.lit(19968) + F.col("y")).alias("py"))
    lon, lat = g.pixel_to_lon(F.col("px") + 0.5, 8), g.pixel_to_lat(F.col("py") + 0.5, 8)
    back = [F.floor(f(v, 8)).cast("long").alias(n) for f, v, n in ((g.lon_to_pixel, F.col("lon"), "back_x"), (g.lat_to_pixel, F.col("lat"), "back_y"))]
    c = c.withColumn("lon", lon).withColumn("lat", lat)
    return c.select("cell_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), *back, F.round(g.cell_size(F.col("py"), 8), 4).alias("size_m"), F.round(g.haversine(F.col("lon"), F.col("lat"), F.lit(10.0), F.lit(50.0)), 3).alias("dist_m"))


QUERIES["lonlat_pixels"] = lonlat_pixels
ORACLE_SQL["lonlat_pixels"] = duck("""
    WITH c AS (SELECT cell_id, 36352 + x AS px, 19968 + y AS py FROM {cells}),
    l AS (SELECT *, (px + 0.5) / 65536.0 * 360.0 - 180.0 AS lon, degrees(atan(sinh(pi() * (1 - 2 * (py + 0.5) / 65536.0)))) AS lat FROM c)
    SELECT cell_id, round(lon, 6) AS lon, round(lat, 6) AS lat, CAST(floor((lon + 180.0) / 360.0 * 65536.0) AS BIGINT) AS back_x,
        CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 65536.0) AS BIGINT) AS back_y,
        round(40075016.686 / 65536.0 * cos(radians(lat)), 4) AS size_m,
        round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(50.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50.0)) * pow(sin(radians(10.0 - lon) / 2), 2))), 3) AS dist_m FROM l""")
