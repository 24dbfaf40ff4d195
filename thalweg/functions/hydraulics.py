"""Size classes, velocity, discharge, encodings, colour ramps and labels as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds in km2 and names of size classes; seconds of a year over 1000.
SIZE_CLASSES = ((0.5, "Overland flow"), (5, "Headwater stream"), (50, "Stream"), (500, "Small river"), (5000, "River"), (50000, "Major river"))
LARGEST = "Great river"
YEAR = 31557.6
ACC_SCALE = 11

# Colour ramps, (value, (red, green, blue)).
RAMPS = {
    "precip": [
        (0, (120, 60, 25)), (200, (190, 140, 60)), (400, (228, 214, 118)), (600, (150, 205, 108)), (800, (64, 180, 140)),
        (1200, (38, 138, 202)), (1800, (48, 78, 210)), (2800, (122, 58, 200)), (4500, (220, 90, 190)),
    ],
    "snow": [(0, (10, 20, 40)), (20, (40, 80, 140)), (80, (90, 150, 210)), (250, (170, 210, 240)), (600, (230, 245, 255)), (1500, (255, 255, 255))],
    "runoff": [(0, (80, 50, 30)), (50, (140, 120, 70)), (150, (110, 170, 130)), (350, (50, 150, 180)), (700, (40, 90, 200)), (1500, (120, 70, 210))],
    "elevation": [
        (-500, (12, 30, 55)), (0, (70, 120, 150)), (1, (70, 110, 70)), (250, (130, 155, 95)), (700, (190, 175, 110)), (1400, (170, 130, 95)),
        (2200, (160, 150, 150)), (3200, (235, 240, 245)), (4500, (255, 255, 255)),
    ],
    "relief": [
        (-8000, (10, 22, 48)), (-2000, (16, 42, 78)), (-200, (26, 68, 112)), (-20, (44, 100, 150)), (0, (150, 190, 214)), (1, (118, 148, 106)),
        (150, (150, 172, 116)), (400, (188, 186, 128)), (900, (196, 166, 118)), (1600, (172, 132, 100)), (2400, (170, 152, 148)), (3200, (222, 226, 232)),
        (5000, (255, 255, 255)),
    ],
}


def clip(v: Column, low: float, high: float) -> Column:
    """v within low and high; null stays null."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def size_class(area: Column) -> Column:
    out = None
    for bound, name in SIZE_CLASSES:
        out = F.when(area < bound, name) if out is None else out.when(area < bound, name)
    return out.otherwise(LARGEST)


def velocity(area: Column, slope: Column, runoff: Column | float = 300.0) -> Column:
    """Metres a second: over the hillslope below 1 km2, by Manning's equation above. Null and NaN fall back to a lowland."""
    s = F.coalesce(F.greatest(F.nanvl(slope.cast("double"), F.lit(1e-3)), F.lit(1e-5)), F.lit(1e-3))
    s = F.when(slope.isNull(), F.lit(1e-3)).otherwise(s)
    a = F.coalesce(F.nanvl(area.cast("double"), F.lit(1.0)), F.lit(1.0))
    radius = 0.3 * F.pow(F.greatest(discharge(a, runoff), F.lit(0.01)), F.lit(0.3))
    return F.when(a < 1, clip(1.2 * F.sqrt(s), 0.03, 0.6)).otherwise(clip(F.pow(radius, F.lit(2 / 3)) * F.sqrt(s) / 0.04, 0.05, 4.0))


def discharge(area: Column, runoff: Column | float) -> Column:
    """Cubic metres a second of km2 and mm a year."""
    return area * runoff / YEAR


def encode_area(area: Column, scale: int = ACC_SCALE) -> Column:
    return F.floor(clip(F.log2(1 + area) * scale, 0, 255)).cast("int")


def decode_area(v: Column, scale: int = ACC_SCALE) -> Column:
    return F.when(v == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), v / float(scale)) - 1)


def pack_flow(direction: Column, cls: Column) -> Column:
    return direction.bitwiseOR(F.shiftleft(cls, 4))


def ramp(name: str, v: Column) -> Column:
    """struct r, g, b (doubles): linear between stops, clamped at the ends."""
    stops = RAMPS[name]

    def channel(c: int) -> Column:
        out = F.when(v <= stops[0][0], F.lit(float(stops[0][1][c])))
        for (v0, a), (v1, b) in zip(stops, stops[1:]):
            out = out.when(v <= v1, a[c] + (b[c] - a[c]) * ((v - v0) / float(v1 - v0)))
        return out.otherwise(F.lit(float(stops[-1][1][c])))

    return F.struct(*(channel(c).alias(n) for c, n in enumerate("rgb")))


def hillshade(gx: Column, gy: Column, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 2.2) -> Column:
    """Light on a slope of gradient gx (east), gy (south), 0 to 1."""
    x, y = gx * exaggeration, gy * exaggeration
    slope, aspect = F.atan(F.sqrt(x * x + y * y)), F.atan2(-y, x)
    turn, up = math.radians(450.0 - azimuth), math.radians(altitude)
    return clip(math.sin(up) * F.cos(slope) + math.cos(up) * F.sin(slope) * F.cos(F.lit(turn) - aspect), 0, 1)


def town_rank(population: Column) -> Column:
    return F.greatest(F.lit(0), 8 - F.floor(F.pow(population / 1e6, F.lit(0.3)) * 4)).cast("int")


def river_rank(area: Column) -> Column:
    """Halves round to even."""
    return clip(F.bround(8.6 - F.log10(area) * 1.55), 0, 7).cast("int")


def snap_radius(zoom: Column) -> Column:
    return clip(F.floor(14 / F.pow(F.lit(2.0), zoom - 8) + 0.5), 1, 12).cast("int")


def play_seconds(metres: Column) -> Column:
    return clip(9 + metres / 55000.0, 11, 95)


def shrink_factor(cells: Column) -> Column:
    return F.when(cells > 4000000, 8).when(cells > 800000, 4).when(cells > 120000, 2).otherwise(1)


# -- labels -----------------------------------------------------------------------------------------------------------
def _unknown(v: Column, label: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")), F.lit("—")).otherwise(label)


def _fixed(v: Column, places: int) -> Column:
    """Halves round away from zero; thousands are grouped."""
    return F.format_number(F.round(v.cast("decimal(30,8)"), places), places)


def distance_label(m: Column) -> Column:
    km = m / 1000
    return _unknown(m, F.when(m < 1000, F.concat(_fixed(m, 0), F.lit(" m"))).when(m < 100000, F.concat(_fixed(km, 1), F.lit(" km"))).otherwise(F.concat(_fixed(km, 0), F.lit(" km"))))


def area_label(km2: Column) -> Column:
    wide = F.when(km2 < 10, _fixed(km2, 1)).otherwise(_fixed(km2, 0))
    return _unknown(km2, F.when(km2 < 1, F.concat(_fixed(km2 * 100, 0), F.lit(" ha"))).otherwise(F.concat(wide, F.lit(" km²"))))


def duration_label(seconds: Column) -> Column:
    hours, days = seconds / 3600, seconds / 86400
    label = F.when(hours < 1, F.concat(_fixed(seconds / 60, 0), F.lit(" min"))).when(hours < 48, F.concat(_fixed(hours, 1), F.lit(" h")))
    label = label.when(days < 10, F.concat(_fixed(days, 1), F.lit(" days"))).when(days < 90, F.concat(_fixed(days, 0), F.lit(" days")))
    return F.when(seconds <= 0, F.lit("—")).otherwise(_unknown(seconds, label.otherwise(F.concat(_fixed(days / 30.4, 1), F.lit(" months")))))


def elevation_label(m: Column) -> Column:
    return _unknown(m, F.concat(F.format_number(F.floor(m + 0.5), 0), F.lit(" m")))


def discharge_label(q: Column) -> Column:
    label = F.when(q < 1, F.concat(_fixed(q * 1000, 0), F.lit(" l/s"))).when(q < 10, F.concat(_fixed(q, 1), F.lit(" m³/s")))
    return _unknown(q, label.otherwise(F.concat(_fixed(q, 0), F.lit(" m³/s"))))


def slope_label(ratio: Column) -> Column:
    return _unknown(ratio, F.concat(_fixed(ratio * 1000, 2), F.lit(" ‰")))


def coordinate_label(v: Column, axis: str) -> Column:
    """Degrees, minutes, seconds and the hemisphere."""
    positive, negative = ("N", "S") if axis == "lat" else ("E", "W")
    a = F.abs(v)
    minutes = (a - F.floor(a)) * 60
    parts = (F.floor(a).cast("int"), F.floor(minutes).cast("int"), (minutes - F.floor(minutes)) * 60, F.when(v >= 0, positive).otherwise(negative))
    return F.format_string("%d° %02d′ %.1f″ %s", *parts)
