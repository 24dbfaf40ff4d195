"""Climate of coarse cells from stations, water balance, and the score of a calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import hydraulics as h
from ..functions import seasons as s
from ..functions.lineage import cut
from ..sources.stations import REGIMES, STATIONS
from . import flow, rasters

POWER, NEAR = 1.6, 0.02


def first_harmonic(shares: list[float]) -> tuple[float, float]:
    c = sum(v * math.cos(math.pi / 6 * m) for m, v in enumerate(shares))
    d = sum(v * math.sin(math.pi / 6 * m) for m, v in enumerate(shares))
    return 2 * math.hypot(c, d) / sum(shares), math.degrees(math.atan2(d, c)) / 30 % 12


def station_rows(stations=STATIONS, regimes=REGIMES) -> list[tuple]:
    """(lon, lat, elevation, precipitation, temperature at sea level, amplitude, season amplitude, cos and sin of its phase)"""
    out = []
    for _, lon, lat, elev, precip, temp, amp, regime in stations:
        season, phase = first_harmonic(regimes[regime])
        out.append((lon, lat, elev, precip, temp + s.LAPSE * elev, amp, season, math.cos(math.radians(phase * 30)), math.sin(math.radians(phase * 30))))
    return out


def interpolate(cells: DataFrame, stations=STATIONS, regimes=REGIMES, omega: float = s.OMEGA, pet_scale: float = s.PET_SCALE) -> DataFrame:
    """cells: any columns with lon, lat, elev (metres, null: none). Adds precip, temp, temp_amp, season_amp, season_phase, pet
    and runoff. The stations are a literal array, so a cell is one row all along and nothing is shuffled. A null lon or lat
    gives nulls."""
    rows = station_rows(stations, regimes)
    if not rows:
        raise ValueError("no stations")
    fields = ("lon", "lat", "z", "p", "t", "a", "sa", "sc", "ss")
    array = F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {float(v)!r}D" for n, v in zip(fields, row)) + ")" for row in rows) + ")")

    def weigh(st: Column) -> Column:
        lon, lat = F.coalesce("lon", F.lit(0.0)), F.coalesce("lat", F.lit(0.0))
        dx, dy = (lon - st["lon"]) * F.cos(F.radians(lat)), lat - st["lat"]
        w = 1 / F.pow(dx * dx + dy * dy + NEAR, F.lit(POWER))
        return F.struct(w.alias("w"), *((w * st[n]).alias(n) for n in fields[2:]))

    kept = ("w", *fields[2:])
    zero = F.struct(*(F.lit(0.0).alias(n) for n in kept))
    total = F.aggregate(F.transform(array, weigh), zero, lambda a, b: F.struct(*((a[n] + b[n]).alias(n) for n in kept)))
    out = cells.withColumn("__sum", total)
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    mean = {n: F.when(placed, F.col("__sum")[n] / F.col("__sum")["w"]) for n in kept[1:]}
    high = F.greatest(F.coalesce(F.col("elev"), F.lit(0)).cast("double"), F.lit(0.0))
    out = out.withColumns({
        "precip": s.orographic(mean["p"], high, mean["z"]), "temp": mean["t"] - s.LAPSE * high, "temp_amp": mean["a"], "season_amp": mean["sa"],
        "season_phase": F.pmod(F.degrees(F.atan2(mean["ss"], mean["sc"])) / 30, F.lit(12.0)),
    }).drop("__sum")
    out = out.withColumn("pet", F.when(placed, s.evapotranspiration(F.col("lat"), F.col("temp"), F.col("temp_amp"), pet_scale)))
    return out.withColumn("runoff", F.when(placed, s.runoff(F.col("precip"), F.col("pet"), F.col("temp"), omega)))


def blocks(cells: DataFrame, zoom: int = 8, x0: int = 0, y0: int = 0, factor: int = 8, height: float = 1.0) -> DataFrame:
    """cells: x, y, z. A row a block of factor by factor cells: bx, bky, elev (mean z times `height`), lon, lat of its middle."""
    pooled = rasters.pooled(cells, factor, elev=F.avg("z") * height)
    lon, lat = (f(o + (F.col(b) + 0.5) * factor, zoom) for f, o, b in ((g.pixel_to_lon, x0, "bx"), (g.pixel_to_lat, y0, "bky")))
    return pooled.withColumn("lon", lon).withColumn("lat", lat)


def runoff_weights(cells: DataFrame, climate: DataFrame, factor: int = 8, **more: str) -> DataFrame:
    """cell_id, weight: the water of each cell, m3/s: its km2 (size_m) times the runoff of its block. more: names of weights, in
    place of weight, and the columns that they are made of."""
    named = more or {"weight": "runoff"}
    at = cells.select("cell_id", "size_m", F.floor(F.col("x") / factor).alias("bx"), F.floor(F.col("y") / factor).alias("bky")).join(climate.select("bx", "bky", *named.values()), ["bx", "bky"])
    return at.select("cell_id", *((F.pow("size_m", F.lit(2)) / 1e6 * F.col(c) * 1000 / (h.YEAR * 1000)).alias(n) for n, c in named.items()))


def calibrate(cells: DataFrame, basins: DataFrame, gauged: DataFrame, grid: list[tuple[float, float]], zoom: int = 8, x0: int = 0, y0: int = 0, factor: int = 8, height: float = 1.0) -> DataFrame:
    """cells as `api.build` makes them, with size_m; basins: basin_id, river, area; gauged: river, discharge. A row for each
    (omega, pet_scale): n, median_ratio, mean_error, best (the least mean_error, the first on ties). Water is added up once
    for all pairs, looked up at the outlets of the largest basin of each river."""
    middles = cut(blocks(cells, zoom, x0, y0, factor, height))
    runoffs, out, names = middles.select("bx", "bky"), None, {f"q{i}": f"runoff{i}" for i in range(len(grid))}
    for (omega, scale), column in zip(grid, names.values()):
        runoffs = runoffs.join(interpolate(middles, omega=omega, pet_scale=scale).select("bx", "bky", F.col("runoff").alias(column)), ["bx", "bky"])
    weights = runoff_weights(cells, cut(runoffs), factor, **names)
    q = flow.totals(cells.select("cell_id", "parent_id"), weights, **{n: ("sum", n) for n in names})
    found = cut(basins.join(q.withColumnRenamed("cell_id", "basin_id"), "basin_id").select("river", "area", *names))
    for i, ((omega, scale), name) in enumerate(zip(grid, names)):
        modelled = found.select("river", "area", F.col(name).alias("discharge"))
        row = score(modelled, gauged).select(F.lit(i).alias("run"), F.lit(float(omega)).alias("omega"), F.lit(float(scale)).alias("pet_scale"), "n", "median_ratio", "mean_error")
        out = row if out is None else out.union(row)
    out = cut(out)
    best = out.orderBy("mean_error", "run").limit(1).select(F.col("run").alias("__best"))
    return out.join(F.broadcast(best), F.col("run") == F.col("__best"), "left").withColumn("best", F.col("__best").isNotNull()).drop("__best", "run")


def worst(ratios: DataFrame, n: int = 10) -> DataFrame:
    """ratios: river, ratio. The n rivers that are furthest off, by the absolute logarithm."""
    return ratios.withColumn("error", F.abs(F.log("ratio"))).orderBy(F.desc("error"), "river").limit(n)


def ratios(modelled: DataFrame, gauged: DataFrame) -> DataFrame:
    """river, ratio: the modelled discharge of the largest basin of each river (the smaller discharge on ties) over its gauge."""
    best = modelled.where("river is not null").groupBy("river").agg(F.max_by("discharge", F.struct("area", -F.col("discharge"))).alias("q"))
    return best.join(gauged.select("river", F.col("discharge").alias("g")), "river").where("q > 0 and g > 0").select("river", (F.col("q") / F.col("g")).alias("ratio"))


def score(modelled: DataFrame, gauged: DataFrame) -> DataFrame:
    """modelled: river, area, discharge; gauged: river, discharge. The largest basin of each river against its gauge: one row
    with n, median_ratio, mean_error (of absolute logarithms)."""
    r = ratios(modelled, gauged)
    return r.agg(F.count("ratio").alias("n"), F.median("ratio").alias("median_ratio"), F.avg(F.abs(F.log("ratio"))).alias("mean_error"))
