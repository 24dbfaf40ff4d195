"""Climate and water balance as Column expressions: radiation, evapotranspiration, runoff, months of a year."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hydraulics import clip

# Fixed values of the model.
DAYS = (31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
MELT_A_DEGREE_DAY, KEPT_IN_STORE, LAPSE, OROGRAPHY, OMEGA, PET_SCALE = 3.0, 0.42, 0.0065, 0.00055, 2.6, 2.0


def months() -> Column:
    return F.sequence(F.lit(0), F.lit(11))


def harmonic(shares: Column) -> Column:
    """struct amp, phase (month): the first Fourier harmonic of twelve shares, none of them null."""
    part = lambda f: F.aggregate(F.transform(shares, lambda v, m: v * f(m * (math.pi / 6))), F.lit(0.0), lambda a, b: a + b)
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    c, s = part(F.cos), part(F.sin)
    return F.struct((2 * F.hypot(c, s) / total).alias("amp"), F.pmod(F.degrees(F.atan2(s, c)) / 30, F.lit(12.0)).alias("phase"))


def radiation(lat: Column, day: Column) -> Column:
    """Extraterrestrial radiation of a day, MJ a square metre."""
    phi, turn = F.radians(lat), day * (2 * math.pi / 365)
    tilt = 0.409 * F.sin(turn - 1.39)
    sunset = F.acos(clip(-F.tan(phi) * F.tan(tilt), -1, 1))
    return (24 * 60 / math.pi) * 0.082 * (1 + 0.033 * F.cos(turn)) * (sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset))


def evapotranspiration(lat: Column, temp: Column, amplitude: Column, scale: float = PET_SCALE) -> Column:
    """Potential, mm a year, by temperature and radiation of twelve months."""

    def month(m: Column) -> Column:
        t = temp + amplitude * F.cos((m - 6) * (math.pi / 6))
        return F.when(t > -5, F.greatest(radiation(lat, 15 + 30 * m) * (t + 5) / 245, F.lit(0.0)) * 30.44).otherwise(F.lit(0.0))

    return F.aggregate(F.transform(months(), month), F.lit(0.0), lambda a, b: a + b) * scale


def runoff(precip: Column, pet: Column, temp: Column, omega: float = OMEGA) -> Column:
    """What evaporation leaves, mm a year; frozen ground loses little."""
    dry = pet / F.greatest(precip, F.lit(1.0))
    share = clip(1 + dry - F.pow(1 + F.pow(dry, F.lit(omega)), F.lit(1 / omega)), 0, 1)
    out = F.greatest(precip - share * precip, F.lit(2.0))
    return F.when(temp < -2, F.greatest(out, 0.85 * precip)).otherwise(out)


def orographic(precip: Column, elev: Column, station_elev: Column) -> Column:
    return clip(precip * clip(1 + OROGRAPHY * (elev - station_elev), 0.35, 3.2), 20, 6000)


def monthly_precip(precip: Column, amp: Column, phase: Column) -> Column:
    return F.transform(months(), lambda m: F.greatest(F.lit(0.0), precip / 12 * (1 + amp * F.cos((m - phase) * (math.pi / 6)))))


def monthly_temp(temp: Column, amp: Column) -> Column:
    return F.transform(months(), lambda m: temp + amp * F.cos((m - 6) * (math.pi / 6)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _no_rows() -> Column:
    return F.array().cast("array<double>")


def snow_fraction(temp: Column) -> Column:
    """The share of precipitation that falls as snow."""
    return clip((3 - temp) / 4, 0, 1)


def melt_potential(temp: Column, days: Column | float) -> Column:
    """What a month of so many days can melt, mm."""
    return F.greatest(temp, F.lit(0.0)) * MELT_A_DEGREE_DAY * days


def shares(season: Column) -> Column:
    """struct snowmelt, rain, groundwater: where the water of a year comes from, as shares of all."""
    rest = 1 - season["snow_share"]
    return F.struct(season["snow_share"].alias("snowmelt"), (rest * (1 - season["baseflow_share"])).alias("rain"), (rest * season["baseflow_share"]).alias("groundwater"))


def seasons(df, precip="precip", season_amp="season_amp", season_phase="season_phase", temp="temp", temp_amp="temp_amp", mm="runoff"):
    """df with a struct `season`: monthly precip, temp, snowfall, melt, snowpack, runoff, discharge (mean 1), and snow_share,
    baseflow_share, frozen_months. Snow and the groundwater store run through three years; the last one stays. A null in any
    of the six columns gives a null season."""
    c, given = F.col, [precip, season_amp, season_phase, temp, temp_amp, mm]
    v = {n: F.coalesce(F.col(n), F.lit(0)).cast("double") for n in given}
    out = df.withColumn("__season_p", monthly_precip(v[precip], v[season_amp], v[season_phase])).withColumn("__season_t", monthly_temp(v[temp], v[temp_amp]))
    out = out.withColumn("__season_snow", F.transform("__season_p", lambda p, m: p * snow_fraction(F.get(c("__season_t"), m))))
    days = F.array(*(F.lit(float(d)) for d in DAYS))
    out = out.withColumn("__season_can", F.transform("__season_t", lambda t, m: melt_potential(t, F.get(days, m))))

    def snow_month(state: Column, i: Column) -> Column:
        m = i % 12
        held = state["pack"] + F.get(c("__season_snow"), m)
        gone = F.least(held, F.get(c("__season_can"), m))
        return F.struct((held - gone).alias("pack"), F.concat(state["melt"], F.array(gone)).alias("melt"), F.concat(state["packs"], F.array(held - gone)).alias("packs"))

    three_years = F.sequence(F.lit(0), F.lit(35))
    start = F.struct(F.lit(0.0).alias("pack"), _no_rows().alias("melt"), _no_rows().alias("packs"))
    out = out.withColumn("__season_s", F.aggregate(three_years, start, snow_month))
    out = out.withColumn("__season_melt", F.slice("__season_s.melt", 25, 12)).withColumn("__season_packs", F.slice("__season_s.packs", 25, 12))
    out = out.withColumn("__season_gross", F.transform("__season_p", lambda p, m: p - F.get(c("__season_snow"), m) + F.get(c("__season_melt"), m)))

    def store_month(state: Column, i: Column) -> Column:
        full = state["store"] + F.get(c("__season_gross"), i % 12)
        return F.struct((full * KEPT_IN_STORE).alias("store"), F.concat(state["out"], F.array(full * (1 - KEPT_IN_STORE))).alias("out"))

    out = out.withColumn("__season_out", F.slice(F.aggregate(three_years, F.struct(F.lit(0.0).alias("store"), _no_rows().alias("out")), store_month)["out"], 25, 12))
    gross = F.coalesce(F.nullif(_total(c("__season_gross")), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("__season_gs", gross).withColumn("__season_run", F.transform("__season_out", lambda q: q * (v[mm] / c("__season_gs"))))
    out = out.withColumn("__season_mean", F.coalesce(F.nullif(_total(c("__season_run")) / 12, F.lit(0.0)), F.lit(1.0)))
    season = F.struct(
        c("__season_p").alias("precip"), c("__season_t").alias("temp"), c("__season_snow").alias("snowfall"), c("__season_melt").alias("melt"), c("__season_packs").alias("snowpack"), c("__season_run").alias("runoff"),
        F.transform("__season_run", lambda q: q / c("__season_mean")).alias("discharge"), (_total(c("__season_melt")) / c("__season_gs")).alias("snow_share"), F.lit(KEPT_IN_STORE).alias("baseflow_share"),
        F.filter(months(), lambda m: F.get(c("__season_t"), m) < -2).alias("frozen_months"),
    )
    season = F.when(~reduce(operator.or_, (c(n).isNull() for n in given)), season)
    return out.withColumn("season", season).drop("__season_p", "__season_t", "__season_snow", "__season_can", "__season_s", "__season_melt", "__season_packs", "__season_gross", "__season_out", "__season_gs", "__season_run", "__season_mean")
