"""The query surface over a built grid: trace, watershed, upstream, rain, probe, point, basins, health, search, overlays."""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geodesy as g
from .functions import hydraulics as h
from .functions.lineage import cut
from .functions.seasons import seasons
from .operators import basins as basin_ops
from .operators import climate as climate_ops
from .operators import flood, flow, journeys, paths, rasters, reaches, search, shapes, walks
from .operators.rasters import EDGE, LAKE, OCEAN, SINK
from .stages import Stage, Store

THEMES = ("relief", "dark", "light", "satellite")
#: Names of classes, as answers give them. Fixed values.
CLASSES = {0: "land", OCEAN: "ocean", LAKE: "lake", SINK: "sink", EDGE: "edge", 5: "ice"}
#: mm a year where none is known; km2 from which a network has an order. Fixed values.
RUNOFF, STREAM = 300.0, 2.0
STAGES = ("hydro", "tiles", "relief", "rivers", "basins", "climate")


def at_edge(cells: DataFrame) -> Column:
    """Whether a cell is on the border of the grid."""
    high = cells.agg(F.max("y")).first()[0]
    return (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.lit(high))


def build(cells: DataFrame, fill: bool = True, eps: float = 1e-3, stream: float | None = None) -> DataFrame:
    """cells: cell_id, x, y, z, w, cls, and size_m where areas are known. Fills depressions from the ocean and the border, lets
    water run down from all other cells, and adds dir, parent_id, acc (km2, or cells where there is no size_m), term, and
    strahler for areas from `stream` on, if that is given. z stays as it was."""
    seed = (F.col("cls") == OCEAN) | at_edge(cells)
    level = cells.withColumn("terminal", F.coalesce(seed, F.lit(False)))
    if fill:
        filled = flood.fill(level.withColumn("seed", F.col("terminal")), eps)
        level = level.drop("z").join(filled.withColumnRenamed("filled", "z"), "cell_id")
    edges = cut(flow.d8(level))
    weights = cells.select("cell_id", (F.pow("size_m", F.lit(2)) / 1e6).alias("weight")) if "size_m" in cells.columns else None
    acc = cut(flow.accumulate(edges, weights))
    out = cells.join(edges, "cell_id").join(acc, "cell_id").join(flow.terminals(edges), "cell_id")
    if stream is not None:
        out = out.join(flow.strahler(edges, acc, stream).withColumnRenamed("so", "strahler"), "cell_id")
    return cut(out)


def build_all(cells: DataFrame, marine: DataFrame, stages: tuple[str, ...] = STAGES, zoom: int = 8, x0: int = 0, y0: int = 0, least: float = basin_ops.LEAST, thresholds: tuple[float, ...] = (20000.0, 1500.0, 250.0), store: Store | None = None) -> dict[str, DataFrame]:
    """The stages of a build by name, each made of those before: hydro (cells as build() makes them), tiles (flow, area and
    elevation), relief, rivers (reaches of each level), basins, climate (blocks). Those that are not asked for are left out. In a
    store, stages whose inputs and parameters are those of an earlier build are read instead of run."""
    return {k: v.table if isinstance(v, Stage) else v for k, v in _staged(cells, marine, stages, zoom, x0, y0, least, thresholds, store).items() if k in stages}


def _staged(cells: DataFrame, marine: DataFrame, stages: tuple[str, ...], zoom: int, x0: int, y0: int, least: float, thresholds: tuple[float, ...], store: Store | None) -> dict[str, Stage | DataFrame]:
    from .sources import tiles

    sized = "size_m" in cells.columns

    def placed(hydro: DataFrame, x0: int, y0: int) -> DataFrame:
        return hydro.withColumns({"px": F.col("x") + x0, "py": F.col("y") + y0})

    def drawn(hydro: DataFrame, x0: int, y0: int) -> DataFrame:
        grid = placed(hydro, x0, y0)
        return tiles.flow_tiles(grid).unionByName(tiles.area_tiles(grid)).unionByName(tiles.elevation_tiles(grid), allowMissingColumns=True)

    def relief(hydro: DataFrame, zoom: int, x0: int, y0: int) -> DataFrame:
        return rasters.relief_levels(placed(hydro, x0, y0), F.col("size_m") if sized else F.lit(1.0), zoom)

    def basins(hydro: DataFrame, rivers: DataFrame, marine: DataFrame, least: float, zoom: int, x0: int, y0: int) -> DataFrame:
        lod = rivers.where("lod = 1").select("reach_id", "tail", F.lit(None).cast("string").alias("name"), "dn")
        return basin_ops.build(hydro.withColumn("country", F.lit(None).cast("string")), marine, lod, least, zoom, x0, y0)

    def climate(hydro: DataFrame, zoom: int, x0: int, y0: int) -> DataFrame:
        return climate_ops.interpolate(climate_ops.blocks(placed(hydro, x0, y0), zoom, x0, y0))

    made: dict[str, Stage | DataFrame] = {}

    def stage(name: str, make, *made_of, **parameters) -> None:
        made[name] = store.run(name, make, *made_of, **parameters) if store else make(*made_of, **parameters)

    at = {"x0": x0, "y0": y0}
    stage("hydro", build, cells, stream=STREAM)
    if "tiles" in stages:
        stage("tiles", drawn, made["hydro"], **at)
    if "relief" in stages:
        stage("relief", relief, made["hydro"], zoom=zoom, **at)
    if "rivers" in stages or "basins" in stages:
        stage("rivers", reaches.levels, made["hydro"], thresholds=thresholds)
    if "basins" in stages:
        stage("basins", basins, made["hydro"], made["rivers"], marine, least=least, zoom=zoom, **at)
    if "climate" in stages:
        stage("climate", climate, made["hydro"], zoom=zoom, **at)
    return made


class Engine:
    """Queries on cells as `build` makes them. x0, y0: the grid's first pixel at `zoom`. Points are rows drop_id, lon, lat. What
    else there is gives names: reaches (vertices owner, seq, lon, lat, up, dn, name), countries and lakes (poly_id, rings,
    name), basins (basin_id, name, sea, sea_group, and runoff), climate (bx, bky and a sample; blocks of `factor` cells), and a
    gazetteer. What is missing leaves nulls."""

    def __init__(self, cells: DataFrame, zoom: int = 8, x0: int = 0, y0: int = 0, gazetteer: DataFrame | None = None, reaches: DataFrame | None = None, countries: DataFrame | None = None, lakes: DataFrame | None = None, basins: DataFrame | None = None, climate: DataFrame | None = None, factor: int = 8):
        self.cells, self.zoom, self.x0, self.y0, self.gazetteer = cells, zoom, x0, y0, gazetteer
        self.reaches, self.countries, self.lakes, self.known_basins, self.climate, self.factor = reaches, countries, lakes, basins, climate, factor

    @cached_property
    def width(self) -> int:
        row = self.cells.select("w").first()
        return int(row.w) if row else 0

    @cached_property
    def edges(self) -> DataFrame:
        return self.cells.select("cell_id", "parent_id")

    @cached_property
    def apart(self) -> bool:
        """Whether cells are told apart by their ids, as walks take them."""
        return flow.distinct(self.cells, "cell_id")

    @cached_property
    def numbered(self) -> DataFrame:
        return flow.intervals(self.edges)

    def _pixel(self) -> tuple[Column, Column]:
        return F.floor(g.lon_to_pixel(F.col("lon"), self.zoom)) - self.x0, F.floor(g.lat_to_pixel(F.col("lat"), self.zoom)) - self.y0

    def _located(self, rows: DataFrame) -> DataFrame:
        lon, lat = g.pixel_to_lon(F.col("x") + self.x0 + 0.5, self.zoom), g.pixel_to_lat(F.col("y") + self.y0 + 0.5, self.zoom)
        return rows.withColumn("lon", lon).withColumn("lat", lat)

    def locate(self, points: DataFrame, snap: int = 0) -> DataFrame:
        """drop_id, cell_id of points within the grid; with `snap`, the cell of most flow near by: the logarithm of its area
        less its distance over the radius, taken only where it drains at least 4 km2 and five times as much; of equal scores
        the first by rows (see flow.snapped())."""
        x, y = self._pixel()
        at = points.select("drop_id", x.cast("long").alias("x"), y.cast("long").alias("y")).where((F.col("x") >= 0) & (F.col("x") < self.width) & (F.col("y") >= 0))
        at = at.join(self.cells.select("x", "y", "cell_id", F.col("acc").alias("here")), ["x", "y"])
        if not snap:
            return at.select("drop_id", "cell_id")
        # what is near is the same for all points of a cell
        best = flow.snapped(self.cells, at.select("cell_id", "x", "y", "here").distinct(), snap)
        return at.join(best, "cell_id", "left").select("drop_id", F.coalesce("best", "cell_id").alias("cell_id"))

    def trace(self, points: DataFrame, snap: int = 0, max_steps: int = 40000) -> DataFrame:
        """drop_id, step, cell_id, lon, lat, cls, area, elev (it never climbs), dist, sea_at, and of the whole path: terminal
        (the class it ends in; a sink where water would go round) and truncated (it goes on after max_steps)."""
        path = flow.trace(self.edges, self.locate(points, snap), max_steps)
        rows = self._located(path.join(self.cells.select("cell_id", "x", "y", F.col("z").alias("elev"), "cls", F.col("acc").alias("area"), "parent_id"), "cell_id"))
        last = lambda c: F.max_by(c, "step").over(paths.whole())
        end = F.max("step").over(paths.whole())
        out = paths.decorate(rows).withColumns({"truncated": last(F.col("parent_id").isNotNull()) & (end == max_steps), "__goes": last(F.col("parent_id").isNotNull()), "__cls": last("cls")})
        terminal = F.when(F.col("truncated"), F.lit(None)).when(F.col("__goes"), F.lit(SINK)).otherwise(F.col("__cls")).cast("int")
        return out.withColumn("terminal", terminal).select("drop_id", "step", "cell_id", "lon", "lat", "cls", "area", "elev", "dist", "sea_at", "terminal", "truncated")

    def named(self, traced: DataFrame) -> DataFrame:
        """A trace with river, country, lake, destination and destination_kind: the sea of the basin that it ends in, or what
        its last class says."""
        rows = paths.named(traced, self.reaches, self.countries, self.lakes)
        ends = rows.groupBy("drop_id").agg(F.max_by("cell_id", "step").alias("basin_id"), F.max_by("lake", "step").alias("__lake"), F.max("terminal").alias("__t"))
        return rows.join(self._told(ends).drop("basin_id"), "drop_id")

    def _told(self, ends: DataFrame) -> DataFrame:
        """ends: drop_id, basin_id, __lake, __t (terminal). drop_id, basin_id, destination, destination_kind."""
        if self.known_basins is None:
            ends = ends.withColumns({"sea": F.lit(None).cast("string"), "sea_group": F.lit(None).cast("string")})
        else:
            ends = ends.join(self.known_basins.select("basin_id", "sea", "sea_group"), "basin_id", "left")
        kinds = {LAKE: ("lake", F.coalesce("__lake", F.lit("an inland lake"))), EDGE: ("edge", F.lit("beyond the mapped area")), SINK: ("sink", F.lit("an endorheic sink"))}
        kind, where = F.when(F.col("sea_group") == "caspian", "endorheic").when(F.col("sea").isNotNull(), "sea"), F.col("sea")
        for t, (k, w) in kinds.items():
            kind, where = kind.when(F.col("__t") == t, k), F.coalesce(where, F.when(F.col("__t") == t, w))
        return ends.select("drop_id", "basin_id", F.coalesce(where, F.lit("the sea")).alias("destination"), kind.otherwise("sea").alias("destination_kind"))

    def ends(self, points: DataFrame, snap: int = 0, max_steps: int = 40000) -> DataFrame:
        """Where the path of each point ends, as trace() and named() say of its last row: drop_id, cell_id, step, lon, lat, terminal,
        truncated, destination, destination_kind. A row a point: no path is listed."""
        at = flow.ends(self.edges, self.locate(points, snap), max_steps).join(self.cells.select("cell_id", "x", "y", "cls", F.col("parent_id").isNotNull().alias("goes")), "cell_id")
        terminal = F.when(F.col("truncated"), F.lit(None)).when(F.col("goes"), F.lit(SINK)).otherwise(F.col("cls")).cast("int")
        at = self._located(at).select("drop_id", "cell_id", F.col("steps").alias("step"), "lon", "lat", "cls", terminal.alias("terminal"), "truncated")
        if self.lakes is not None:
            held = shapes.point_in_polygon(at.where(F.col("cls") == LAKE).select(F.col("drop_id").alias("point_id"), "lon", "lat"), self.lakes)
            lake = held.join(self.lakes.select("poly_id", "name"), "poly_id").select(F.col("point_id").alias("drop_id"), F.col("name").alias("__lake"))
            told = at.join(lake, "drop_id", "left")
        else:
            told = at.withColumn("__lake", F.lit(None).cast("string"))
        told = self._told(told.select("drop_id", F.col("cell_id").alias("basin_id"), "__lake", F.col("terminal").alias("__t")))
        return at.drop("cls").join(told.drop("basin_id"), "drop_id")

    def spec_runoff(self, traced: DataFrame) -> DataFrame:
        """drop_id, runoff (mm a year): that of the block where a path ends; 300 where there is none or it isn't above 0. It
        counts for the speed along the whole path."""
        ends = traced.groupBy("drop_id").agg(F.max_by(F.struct("lon", "lat"), "step").alias("e")).select("drop_id", "e.*")
        found = self.sample(ends)
        return found.select("drop_id", F.when(F.col("climate.spec_runoff") > 0, F.col("climate.spec_runoff")).otherwise(RUNOFF).cast("double").alias("runoff"))

    def analyse(self, traced: DataFrame, runoff: float | None = None) -> DataFrame:
        """A row a path: distance, seconds, mean_velocity, heights, slope, final_area and discharge; without a runoff, that of
        the climate where it ends."""
        if runoff is not None or self.climate is None:
            return paths.travel(traced, RUNOFF if runoff is None else runoff)
        return paths.travel(traced.join(self.spec_runoff(traced), "drop_id"), F.col("runoff"))

    def report(self, points: DataFrame, snap: int = 0, runoff: float | None = None) -> DataFrame:
        """The whole answer for each drop in a row: where it ends (destination, destination_kind, terminal, truncated), what
        paths.analysed() says of its path, the names of its tributaries, and its stages (as of journeys.journey()) as an array."""
        rows = cut(self.named(self.trace(points, snap)))
        if runoff is None and self.climate is not None:
            found = paths.analysed(rows.join(self.spec_runoff(rows), "drop_id"), F.col("runoff"))
        else:
            found = paths.analysed(rows, RUNOFF if runoff is None else runoff)
        ends = rows.groupBy("drop_id").agg(*(F.first(c).alias(c) for c in ("destination", "destination_kind", "terminal", "truncated")))
        fields = ("stage", "label", "kind", "name", "from_m", "to_m", "area", "fall", "countries")
        told = journeys.journey(rows).groupBy("drop_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("stages"))  # of one path
        out = found.join(ends, "drop_id").join(told, "drop_id", "left")
        if self.reaches is None:
            return out
        names = paths.tributaries(rows, self.reaches).groupBy("drop_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("tributary_names"))
        return out.join(names, "drop_id", "left")

    def sample(self, points: DataFrame) -> DataFrame:
        """points with a struct `climate` of the block that each lies in; null off the grid."""
        if self.climate is None:
            return points.withColumn("climate", F.lit(None).cast("struct<precip:double,spec_runoff:double>"))
        x, y = self._pixel()
        fields = [c for c in self.climate.columns if c not in ("bx", "bky")]
        fields = [F.col(c) for c in fields] + ([] if "spec_runoff" in fields else [F.col("runoff").alias("spec_runoff")])
        at = points.withColumns({"bx": F.floor(x / self.factor), "bky": F.floor(y / self.factor)})
        return at.join(self.climate.select("bx", "bky", F.struct(*fields).alias("climate")), ["bx", "bky"], "left").select(*points.columns, "climate")

    def watershed(self, points: DataFrame, snap: int = 0) -> DataFrame:
        """drop_id, cells, area, and the box x0, y0, x1, y1 of all that drains through each point: sums for every cell by
        doubling, looked up; no member is listed."""
        spots = self.locate(points, snap)
        size = F.pow("size_m", F.lit(2)) / 1e6 if "size_m" in self.cells.columns else F.lit(1.0)
        values = self.cells.select("cell_id", F.lit(1).cast("long").alias("one"), size.alias("size"), "x", "y")
        sums = flow.totals(self.edges, values, cells=("sum", "one"), area=("sum", "size"), x0=("min", "x"), y0=("min", "y"), x1=("max", "x"), y1=("max", "y"))
        return spots.join(sums, "cell_id").drop("cell_id")

    def members(self, points: DataFrame, snap: int = 0) -> DataFrame:
        """drop_id, cell_id: all cells that drain through each point."""
        spots = self.locate(points, snap)
        found = flow.catchment(self.edges, spots.select(F.col("cell_id").alias("outlet_id")).distinct(), self.numbered)
        return spots.withColumnRenamed("cell_id", "outlet_id").join(found, "outlet_id").select("drop_id", "cell_id")

    def outlines(self, points: DataFrame, snap: int = 0) -> DataFrame:
        """mask_id (the drop), ring, coords: outlines of catchments; larger ones are pooled."""
        rows = self.members(points, snap).join(self.cells.select("cell_id", "x", "y"), "cell_id")
        sizes = rows.groupBy("drop_id").agg(h.shrink_factor(F.count(F.lit(1))).alias("f"))
        rows = rows.join(sizes, "drop_id").select(F.col("drop_id").alias("mask_id"), "f", (F.col("x") + self.x0).alias("px"), (F.col("y") + self.y0).alias("py"))
        out = None
        for f in (1, 2, 4, 8):
            some = shapes.rings(rows.where(F.col("f") == f), self.zoom, f, 0.01 if f > 2 else 0.004)
            out = some if out is None else out.union(some)
        return out

    def upstream(self, points: DataFrame, snap: int = 0, min_area: float | None = None, max_paths: int | None = 3000) -> DataFrame:
        """The stems above each point with depth, the area of each cell, and the name of the reach near a path's lowest cell.
        min_area: by default 1.5 km2, or a 700th of the point's area if that is more. truncated: there are more than
        max_paths."""
        spots, outlets = self._outlets(points, snap, min_area)
        found = reaches.upstream(self.cells.select("cell_id", "parent_id", "acc"), outlets, None, max_paths, self.numbered)
        out = spots.join(found, "outlet_id")
        if self.reaches is None:
            return out.withColumn("name", F.lit(None).cast("string"))
        starts = self._located(out.select(F.col("path_id").alias("cell_id")).distinct().join(self.cells.select("cell_id", "x", "y"), "cell_id"))
        near = shapes.nearest(starts.select(F.col("cell_id").alias("point_id"), "lon", "lat"), self.reaches, 0.05)
        names = near.join(self.reaches.select("owner", "name").distinct(), "owner").select(F.col("point_id").alias("path_id"), "name")
        return out.join(names, "path_id", "left")

    def named_stems(self, points: DataFrame, names: DataFrame, snap: int = 0, min_area: float | None = None) -> DataFrame:
        """names: path_id, name. drop_id, path_id, depth, acc, name: the stems of upstream(), all of them, whose lowest cell has a name, a
        row a stem: what feeders() needs."""
        spots, outlets = self._outlets(points, snap, min_area)
        found = reaches.stems_above(self.cells.select("cell_id", "parent_id", "acc"), outlets, names.where("name is not null").select(F.col("path_id").alias("cell_id")), None)
        return spots.join(found, "outlet_id").join(names, "path_id").select("drop_id", "path_id", "depth", "acc", "name")

    def _outlets(self, points: DataFrame, snap: int, min_area: float | None) -> tuple[DataFrame, DataFrame]:
        """drop_id, outlet_id of the points; and outlet_id, least of each outlet."""
        spots = self.locate(points, snap).join(self.cells.select("cell_id", "acc"), "cell_id")
        least = F.greatest(F.lit(1.5), F.col("acc") / 700) if min_area is None else F.lit(float(min_area))
        return spots.select("drop_id", F.col("cell_id").alias("outlet_id")), spots.select(F.col("cell_id").alias("outlet_id"), least.alias("least")).distinct()

    def feeders(self, stems: DataFrame, top: int = 14) -> DataFrame:
        """drop_id, place, name, area, depth: the rivers that feed a point, by the largest area of each name."""
        from pyspark.sql import Window as W

        sums = stems.where("name is not null").groupBy("drop_id", "name").agg(F.max("acc").alias("area"), F.max("depth").alias("depth"))
        place = F.row_number().over(W.partitionBy("drop_id").orderBy(F.desc("area"), "name"))
        return sums.withColumn("place", place).where(F.col("place") <= top).select("drop_id", "place", "name", "area", "depth")

    def rain(self, seeds: DataFrame, stride: int = 3, max_points: int = 1200, max_steps: int = 30000) -> DataFrame:
        """drop_id, step, lon, lat: every third step of each seed's path, at most 1200 of them; truncated: the path goes on."""
        spots = self.locate(seeds)
        if self.apart:
            spots = cut(spots)
            if flow.distinct(spots, "drop_id"):
                return walks.sampled(self._located(self.cells).select("cell_id", "parent_id", "acc", "lon", "lat"), spots, stride, max_points, max_steps)
        path = flow.trace(self.edges, spots, max_steps)
        rows = path.join(self.cells.select("cell_id", "x", "y", "parent_id"), "cell_id")
        goes = F.max_by(F.col("parent_id").isNotNull(), "step").over(paths.whole()) | (F.max("step").over(paths.whole()) >= stride * max_points)
        rows = rows.withColumn("truncated", goes).where((F.col("step") % stride == 0) & (F.col("step") < stride * max_points))
        return self._located(rows).select("drop_id", "step", "lon", "lat", "truncated")

    def point(self, points: DataFrame) -> DataFrame:
        """drop_id, inside, elev, area, cls, water: points off the grid have nulls and inside false."""
        at = self.locate(points).join(self.cells.select("cell_id", "z", "acc", "cls"), "cell_id")
        out = points.select("drop_id").join(at, "drop_id", "left")
        return out.select("drop_id", F.col("cell_id").isNotNull().alias("inside"), F.col("z").alias("elev"), F.col("acc").alias("area"), "cls", F.col("cls").isin(OCEAN, LAKE).alias("water"))

    def probe(self, points: DataFrame) -> DataFrame:
        """point() with the climate, country and lake of each point."""
        out = self.point(points).join(self.sample(points.select("drop_id", "lon", "lat")).select("drop_id", "climate"), "drop_id")
        for column, polygons in (("country", self.countries), ("lake", self.lakes)):
            if polygons is None:
                out = out.withColumn(column, F.lit(None).cast("string"))
                continue
            held = shapes.point_in_polygon(points.select(F.col("drop_id").alias("point_id"), "lon", "lat"), polygons).join(polygons.select("poly_id", "name"), "poly_id")
            out = out.join(held.select(F.col("point_id").alias("drop_id"), F.col("name").alias(column)), "drop_id", "left")
        return out

    def drop_at(self, points: DataFrame, snap: int = 0) -> tuple[DataFrame, DataFrame]:
        """A trace and a probe of the same points."""
        return self.trace(points, snap), self.probe(points)

    def answer(self, points: DataFrame, max_steps: int = 80000) -> DataFrame:
        """A row a point: status (200, or 400 off the grid), cells, terminal (by name; a path that is cut or leaves the grid ends
        at the edge), basin_id, sea, area_at_end, and coords, rounded to five places. max_steps is 10 to 200,000."""
        if not 10 <= max_steps <= 200000:
            raise ValueError("max_steps must be from 10 to 200000")
        spots = cut(self.locate(points))
        rows = self._located(flow.trace(self.edges, spots, max_steps - 1).join(self.cells.select("cell_id", "x", "y"), "cell_id"))
        at = F.array(F.round("lon", 5), F.round("lat", 5))
        lines = rows.groupBy("drop_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", at.alias("at")))), lambda s: s["at"]).alias("coords"))
        return self._answers(points, spots, max_steps).join(lines, "drop_id", "left")

    def answers(self, points: DataFrame, max_steps: int = 80000) -> DataFrame:
        """answer() without coords, for which no path is listed."""
        if not 10 <= max_steps <= 200000:
            raise ValueError("max_steps must be from 10 to 200000")
        return self._answers(points, self.locate(points), max_steps)

    def _answers(self, points: DataFrame, spots: DataFrame, max_steps: int) -> DataFrame:
        out = flow.ends(self.edges, spots, max_steps - 1).join(self.cells.select("cell_id", "cls", "acc", "parent_id"), "cell_id")
        names = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])
        terminal = F.when(F.col("parent_id").isNotNull(), CLASSES[EDGE]).otherwise(F.coalesce(F.try_element_at(names, F.col("cls").cast("int")), F.lit("unknown")))
        out = out.select("drop_id", (F.col("steps") + 1).alias("cells"), terminal.alias("terminal"), F.col("cell_id").alias("basin_id"), F.round("acc", 2).alias("area_at_end"))
        if self.known_basins is None:
            out = out.withColumn("sea", F.lit(None).cast("string"))
        else:
            out = out.join(self.known_basins.select("basin_id", "sea"), "basin_id", "left")
        out = points.select("drop_id").join(out, "drop_id", "left").withColumn("status", F.when(F.col("cells").isNull(), 400).otherwise(200))
        return out.select("drop_id", "status", "cells", "terminal", "basin_id", "sea", "area_at_end")

    def basins(self, limit: int = 50) -> DataFrame:
        """The largest basins: basin_id, cells, acc. A limit is 1 to 2000."""
        if not 1 <= limit <= 2000:
            raise ValueError("limit must be from 1 to 2000")
        tops = self.cells.groupBy(F.col("term").alias("basin_id")).agg(F.count(F.lit(1)).alias("cells"), F.max("acc").alias("area"))
        return tops.orderBy(F.desc("area"), "basin_id").limit(limit)

    def health(self) -> DataFrame:
        return self.cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("parent_id").isNull()).alias("terminals"))

    def search(self, term: str) -> DataFrame:
        return search.search(self.gazetteer, term)


def random_seeds(spark: SparkSession, n: int, west: float, south: float, east: float, north: float, seed: int = 0) -> DataFrame:
    """drop_id, lon, lat: n points spread evenly over a box, the same for the same seed however the work is dealt."""
    part = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(2**53)).cast("double") / 2.0**53
    return spark.range(n).select(F.col("id").alias("drop_id"), (west + (east - west) * part(1)).alias("lon"), (south + (north - south) * part(2)).alias("lat"))


# Metres below which the sea is left out; tints of slopes and flows as (red, green, blue, alpha) at 0 and at 1,
# the slope and the power of ten that count as 1 (for colour and for alpha), and the least area, snow and alphas that are drawn.
DEEP = -20
SLOPE_TINT, FLOW_TINT = ((30, 200, 255, 60), (255, 50, 55, 250)), ((40, 150, 220, 60), (100, 240, 255, 255))
STEEP, FLOW_FULL, FLOW_OPAQUE, LEAST_FLOW, LEAST_SNOW = 32, 6, 3.2, 3, 2
RAMP_ALPHA, SNOW_ALPHA = {"elevation": 215.0, "precip": 205.0, "runoff": 205.0}, (60, 235)


def _tint(ends: tuple, t: Column, alpha: Column) -> tuple[Column, Column]:
    low, high = ends
    parts = [low[i] + (high[i] - low[i]) * (alpha if i == 3 else t) for i in range(4)]
    return F.struct(*(p.alias(n) for p, n in zip(parts, "rgb"))), parts[3]


def overlay(blocks: DataFrame, kind: str, month: int = 0, seasonal: bool = False) -> DataFrame:
    """blocks with the columns a kind needs (elev; slope_degrees; area; precip, season_amp, season_phase, temp, temp_amp,
    runoff) and r, g, b, alpha added: precip, snow, runoff, flowacc, elevation, slope. What is not drawn has alpha 0."""
    sea = F.coalesce(F.col("elev") < DEEP, F.lit(True))
    clear = F.struct(*(F.lit(0.0).alias(c) for c in "rgb"))
    full = lambda v: F.least(F.lit(1.0), v)
    if kind == "slope":
        steep = full(F.col("slope_degrees") / STEEP)
        (colour, alpha), hidden = _tint(SLOPE_TINT, steep, steep), F.col("elev") <= 0
    elif kind == "flowacc":
        size = F.log10(F.greatest(F.col("area"), F.lit(1.0)))
        (colour, alpha), hidden = _tint(FLOW_TINT, full(size / FLOW_FULL), full(size / FLOW_OPAQUE)), sea | (F.col("area") < LEAST_FLOW)
    elif kind == "snow":
        blocks = seasons(blocks).withColumn("__pack", F.get("season.snowpack", F.lit(month))).drop("season")
        pack, (least, most) = F.col("__pack"), SNOW_ALPHA
        colour, alpha, hidden = h.ramp("snow", pack), F.least(F.lit(float(most)), least + pack), sea | F.coalesce(pack < LEAST_SNOW, F.lit(True))
    elif kind in RAMP_ALPHA:
        value = F.col({"elevation": "elev"}.get(kind, kind))
        if kind == "precip" and seasonal:
            value = value * (1 + F.col("season_amp") * F.cos((month - F.col("season_phase")) * (math.pi / 6)))
        colour, alpha, hidden = h.ramp(kind, value), F.lit(RAMP_ALPHA[kind]), F.lit(False) if kind == "elevation" else sea
    else:
        raise ValueError(f"no overlay {kind!r}")
    out = blocks.withColumn("__c", F.when(hidden, clear).otherwise(colour)).withColumn("alpha", F.when(hidden, 0.0).otherwise(alpha))
    return out.withColumns({c: F.col("__c")[c] for c in "rgb"}).drop("__c", "__pack")


def read_fragment(fragment: str) -> dict:
    """d=lon,lat, t=theme, o=overlay of a URL fragment; what cannot be read is left out."""
    found = dict(p.split("=", 1) for p in fragment.lstrip("#").split("&") if "=" in p)
    out: dict = {}
    if met := re.fullmatch(r"(-?[\d.]+),(-?[\d.]+)", found.get("d", "")):
        out["drop"] = (float(met[1]), float(met[2]))
    if found.get("t") in THEMES:
        out["theme"] = found["t"]
    if found.get("o"):
        out["overlay"] = found["o"]
    return out


def write_fragment(lon: float | None = None, lat: float | None = None, theme: str = "relief", overlay: str = "none") -> str:
    """The fragment that read_fragment reads: four decimal places, defaults left out."""
    parts = [f"d={lon:.4f},{lat:.4f}"] if lon is not None and lat is not None else []
    parts += [f"t={theme}"] if theme != "relief" else []
    parts += [f"o={overlay}"] if overlay != "none" else []
    return "&".join(parts)
