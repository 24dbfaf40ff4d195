"""Web Mercator pixels, cell sizes and great-circle distances as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_LAT, EARTH_RADIUS, EQUATOR = 85.05112878, 6371008.8, 40075016.686
TILE = 256


def lon_to_pixel(lon: Column, zoom: int) -> Column:
    return (lon + 180.0) / 360.0 * float(TILE * 2**zoom)


def lat_to_pixel(lat: Column, zoom: int) -> Column:
    # greatest and least would make a null a bound
    s = F.sin(F.radians(F.when(lat.isNotNull(), F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))))
    return (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * float(TILE * 2**zoom)


def pixel_to_lon(x: Column, zoom: int) -> Column:
    return x / float(TILE * 2**zoom) * 360.0 - 180.0


def pixel_to_lat(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / float(TILE * 2**zoom)))))


def cell_size(y: Column, zoom: int) -> Column:
    """Metres across a pixel of row y."""
    return F.lit(EQUATOR / (TILE * 2**zoom)) * F.cos(F.radians(pixel_to_lat(y + 0.5, zoom)))


def cell_of(lon: Column, lat: Column, zoom: int) -> Column:
    """struct px, py by truncation, as against floor: they differ west of the date line's pixel 0 only."""
    return F.struct(lon_to_pixel(lon, zoom).cast("long").alias("px"), lat_to_pixel(lat, zoom).cast("long").alias("py"))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees from north, east being positive, of the way from the first point to the second."""
    turn = F.radians(lon2 - lon1)
    east, north = F.sin(turn) * F.cos(F.radians(lat2)), F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.degrees(F.atan2(east, north))


def shortest_turn(start: Column, end: Column) -> Column:
    """Degrees from one angle to another the short way round, over -180 to 180."""
    d = (end - start) % 360
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def to_mercator(lon: Column, lat: Column) -> Column:
    """struct x, y in metres."""
    y = F.log(F.tan(F.radians((90 + F.when(lat.isNotNull(), F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))) / 2)))
    return F.struct((lon * (EQUATOR / 360)).alias("x"), (y * (EQUATOR / 2 / math.pi)).alias("y"))


def from_mercator(x: Column, y: Column) -> Column:
    """struct lon, lat."""
    return F.struct((x / (EQUATOR / 360)).alias("lon"), F.degrees(2 * F.atan(F.exp(y / (EQUATOR / 2 / math.pi))) - math.pi / 2).alias("lat"))


def grid_transform(px0: int, py0: int, zoom: int) -> tuple[float, float, float, float]:
    """Left, top and size (x, y) of a grid's pixels in metres of the projection."""
    size = EQUATOR / (TILE * 2**zoom)
    return -EQUATOR / 2 + px0 * size, EQUATOR / 2 - py0 * size, size, -size


def grid_of(west: float, south: float, east: float, north: float, zoom: int, supertile: int = 512) -> tuple[int, int, int, int]:
    """First pixel (x, y), width and height of the grid over a box, widened to whole supertiles."""
    n = TILE * 2**zoom
    x = lambda lon: (lon + 180.0) / 360.0 * n
    y = lambda lat: (0.5 - math.atanh(math.sin(math.radians(max(-MAX_LAT, min(MAX_LAT, lat))))) / (2 * math.pi)) * n
    low = [math.floor(math.floor(v / TILE) * TILE / supertile) * supertile for v in (x(west), y(north))]
    size = [-(-(math.ceil(v / TILE) * TILE - o) // supertile) * supertile for v, o in zip((x(east), y(south)), low)]
    return (*low, *size)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points; null if any of the four is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.when(a.isNotNull(), F.least(F.lit(1.0), a))))
