"""Neighbourhoods and blocks of cells (x, y): pools, gradients, overviews, masks, rasters of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hydraulics as h
from . import shapes

# Offset of elevations in overviews; offsets and scales of climate rasters; classes of cells.
ELEVATION_OFFSET, TEMP_OFFSET, TEMP_SCALE, AMP_SCALE, PHASE_SCALE, SEASON_SCALE = 1000, 40, 4, 6, 20, 255
LAND, OCEAN, LAKE, SINK, EDGE, ICE = range(6)


def block(factor: int) -> list[Column]:
    return [F.floor(F.col("x") / factor).alias("bx"), F.floor(F.col("y") / factor).alias("bky")]


def pooled(cells: DataFrame, factor: int, **aggregates: Column) -> DataFrame:
    """A row a block of factor by factor cells: bx, bky and name=aggregate."""
    return cells.groupBy(*block(factor)).agg(*(a.alias(n) for n, a in aggregates.items()))


def arg_max(cells: DataFrame, factor: int, value: str, *columns: str) -> DataFrame:
    """bx, bky, value and the columns of the cell with the largest value in each block, the smallest cell_id on ties."""
    best = F.max_by(F.struct(value, *columns), F.struct(F.col(value), -F.col("cell_id")))
    return cells.groupBy(*block(factor)).agg(best.alias("__b")).select("bx", "bky", "__b.*")


def _beside(cells: DataFrame, value: str) -> DataFrame:
    """cells with east, west, south, north (the value of a neighbour, the cell's own beyond the edge) and nx, ny: how many
    cells apart the pairs are. Neighbours come by equi-joins on coordinates."""
    out = cells
    for name, dx, dy in (("east", 1, 0), ("west", -1, 0), ("south", 0, 1), ("north", 0, -1)):
        out = out.join(cells.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.struct(value).alias(f"__{name}")), ["x", "y"], "left")
    there = lambda n: F.col(f"__{n}").isNotNull().cast("int")
    out = out.withColumns({"nx": there("east") + there("west"), "ny": there("south") + there("north")})
    return out.withColumns({n: F.when(F.col(f"__{n}").isNotNull(), F.col(f"__{n}")[value]).otherwise(F.col(value)) for n in ("east", "west", "south", "north")}).drop("__east", "__west", "__south", "__north")


def gradient(cells: DataFrame, size: float | Column, value: str = "z") -> DataFrame:
    """cells with gx (east), gy (south): central differences by their distance, one-sided at the edge; 0 where a cell has no
    neighbour on either side. size: metres a cell."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    out = _beside(cells, value)
    part = lambda a, b, n: F.when(F.col(n) > 0, (F.col(a) - F.col(b)).cast("double") / (size * F.col(n))).otherwise(0.0)
    return out.withColumns({"gx": part("east", "west", "nx"), "gy": part("south", "north", "ny")}).drop("east", "west", "south", "north", "nx", "ny")


def slope_degrees(cells: DataFrame, size: float | Column, value: str = "z") -> DataFrame:
    """cells with slope_degrees, by differences over two cells; beyond the edge the cell's own value counts."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    out = _beside(cells, value)
    rise = F.hypot((F.col("east") - F.col("west")).cast("double"), (F.col("south") - F.col("north")).cast("double"))
    return out.withColumn("slope_degrees", F.degrees(F.atan(rise / (2 * size)))).drop("east", "west", "south", "north", "nx", "ny")


def relief(cells: DataFrame, size: float | Column, value: str = "z") -> DataFrame:
    """cells with red, green, blue: tints by height under light from the north-west; the sea is lit less."""
    lit = gradient(cells, size, value).withColumn("__s", h.hillshade(F.col("gx"), F.col("gy"))).withColumn("__c", h.ramp("relief", F.col(value)))
    light = F.when(F.col(value) <= 0, 0.92 + 0.16 * F.col("__s")).otherwise(0.55 + 0.85 * F.col("__s"))
    out = lit.withColumns({n: F.floor(h.clip(F.col("__c")[c] * light, 0, 255)).cast("int") for n, c in (("red", "r"), ("green", "g"), ("blue", "b"))})
    return out.drop("gx", "gy", "__s", "__c")


def relief_levels(cells: DataFrame, size: float | Column, zoom: int, lowest: int = 3, value: str = "z") -> DataFrame:
    """The pyramid of relief(): zoom, x, y, red, green, blue, means of four cells of the zoom above from step to step."""
    level = relief(cells, size, value).select("x", "y", "red", "green", "blue")
    out = level.withColumn("zoom", F.lit(zoom))
    for z in range(zoom - 1, lowest - 1, -1):
        level = pooled(level, 2, **{c: F.round(F.avg(c)).cast("int") for c in ("red", "green", "blue")}).withColumnsRenamed({"bx": "x", "bky": "y"})
        out = out.unionByName(level.withColumn("zoom", F.lit(z)))
    return out.select("zoom", "x", "y", "red", "green", "blue")


def overviews(cells: DataFrame, factor: int = 8) -> DataFrame:
    """bx, bky, flow (the largest encoded area) and elev (the mean, rounded, with an offset) of whole blocks only."""
    out = pooled(cells, factor, n=F.count(F.lit(1)), flow=F.max(h.encode_area(F.col("acc"))), elev=F.avg("z"))
    return out.where(F.col("n") == factor * factor).select("bx", "bky", "flow", h.clip(F.bround("elev") + ELEVATION_OFFSET, 0, 65535).cast("int").alias("elev"))


def high_low(v: Column) -> list[Column]:
    """The two bytes of a 16-bit value."""
    return [F.shiftright(v, 8), v.bitwiseAND(255)]


def encode_climate(blocks: DataFrame) -> DataFrame:
    """blocks (precip, season_amp, season_phase, temp, temp_amp, runoff) as three rasters of three bytes, a column each:
    precip_rgb, temp_rgb, runoff_rgb."""
    whole = lambda c: F.floor(h.clip(F.col(c), 0, 65535)).cast("int")
    byte = lambda v: F.floor(h.clip(v, 0, 255)).cast("int")
    out = blocks.withColumn("precip_rgb", F.array(*high_low(whole("precip")), byte(F.col("season_amp") * SEASON_SCALE)))
    out = out.withColumn("temp_rgb", F.array(byte((F.col("temp") + TEMP_OFFSET) * TEMP_SCALE), byte(F.col("temp_amp") * AMP_SCALE), byte(F.col("season_phase") * PHASE_SCALE)))
    return out.withColumn("runoff_rgb", F.array(*high_low(whole("runoff")), F.lit(0)))


def decode_climate(rasters: DataFrame) -> DataFrame:
    """What encode_climate() wrote: precip, season_amp, temp, temp_amp, season_phase, runoff, spec_runoff. A column spec_rgb
    that is missing altogether is replaced by runoff_rgb."""
    spec = "spec_rgb" if "spec_rgb" in rasters.columns else "runoff_rgb"
    join = lambda c: F.shiftleft(F.get(c, F.lit(0)), 8).bitwiseOR(F.get(c, F.lit(1)))
    out = rasters.withColumns({
        "precip": join("precip_rgb"), "season_amp": F.get("precip_rgb", F.lit(2)) / float(SEASON_SCALE), "temp": F.get("temp_rgb", F.lit(0)) / float(TEMP_SCALE) - TEMP_OFFSET,
        "temp_amp": F.get("temp_rgb", F.lit(1)) / float(AMP_SCALE), "season_phase": F.get("temp_rgb", F.lit(2)) / float(PHASE_SCALE), "runoff": join("runoff_rgb"), "spec_runoff": join(spec),
    })
    return out.drop("precip_rgb", "temp_rgb", "runoff_rgb", "spec_rgb")


def specific_runoff(cells: DataFrame, factor: int = 8) -> DataFrame:
    """cells: x, y, cell_id, acc (km2), q (m3/s). bx, bky, spec: mm a year at the cell of most area of each block."""
    best = arg_max(cells, factor, "acc", "q")
    spec = F.when(F.col("acc") > 0, F.col("q") * h.YEAR / F.greatest(F.col("acc"), F.lit(1e-9))).otherwise(0.0)
    return best.select("bx", "bky", F.floor(h.clip(spec, 0, 65535)).cast("int").alias("spec"))


def classes(cells: DataFrame, ocean: Column, lake: Column, ice: Column, edge: Column) -> DataFrame:
    """cells with cls: ice gives way to lakes, those to the ocean; the edge is what isn't ocean there."""
    held = lambda c: F.coalesce(c, F.lit(False))
    return cells.withColumn("cls", F.when(held(ocean), OCEAN).when(held(edge), EDGE).when(held(lake), LAKE).when(held(ice), ICE).otherwise(LAND))


def rasterised(cells: DataFrame, polygons: DataFrame, value: str, fill) -> DataFrame:
    """cells: cell_id, lon, lat of their middles; polygons: poly_id, rings and `value`. Returns cell_id and value: that of the
    last polygon (largest poly_id) that holds the middle, else `fill`."""
    held = shapes.containing(cells.select(F.col("cell_id").alias("point_id"), "lon", "lat"), polygons)
    last = held.groupBy("point_id").agg(F.max("poly_id").alias("poly_id")).join(polygons.select("poly_id", value), "poly_id")
    return cells.select("cell_id").join(last.select(F.col("point_id").alias("cell_id"), value), "cell_id", "left").fillna({value: fill})


def country_codes(countries: DataFrame) -> DataFrame:
    """countries: iso. code (from 1, in the order of iso) of each distinct code; the codes are some hundreds."""
    from pyspark.sql import Window as W

    return countries.select(F.coalesce("iso", F.lit("??")).alias("iso")).distinct().withColumn("code", F.row_number().over(W.orderBy("iso")))
