"""The story of a path: names smoothed along it, lakes bridged, and the stages that a reader sees.

A path is a row of runs: rows that follow each other with one label. All rules are stated on runs and on the runs beside
them, as windows over tables of runs, so a path is never gathered:

- a river's name goes on over rows without one while the area does not fall by a tenth;
- a run between two runs of one other label takes that label if it is a single row (twice over), then if it is shorter than
  25 km. Of such runs in a row every other one gives way, the first of them first, as the next one has lost its neighbour;
- a lake counts from 2 km on; two of them with less than 8 km between are one, and with less than 40 km if both have the
  same name; its name reaches over its rows without one;
- stages are runs of one label. One of less than 1500 m without a name belongs to the stage before; of the rest, those of
  2500 m or less go, unless they are lakes, the first or the last.

A row may stand for several steps, from `step` to `last`, along which river, lake, country, the class and the size class of the
area are the same, the area does not fall and the elevation does not climb; dist, area and elev are then those of its first
step, and dist_to, area_to and elev_to those of its last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hydraulics as h
from ..functions.lineage import cut
from .flow import chase, trace
from .paths import LAKE, carry, order, travel, whole

# Metres.
SHORT_RUN, LAKE_RUN, LAKE_GAP, SAME_LAKE_GAP, SHORT_STAGE, FRAGMENT = 25000, 2000, 8000, 40000, 1500, 2500

__all__ = ["absorbed", "journey", "lake_passages", "lake_runs", "river_runs", "runs", "travel"]


def _by(first: str) -> W:
    return W.partitionBy("drop_id").orderBy(first)


def _changes(label: Column, way: W) -> Column:
    """The number of the run that a row is in, from 1."""
    return F.sum((~label.eqNullSafe(F.lag(label).over(way)) | (F.row_number().over(way) == 1)).cast("int")).over(way)


def _spread(rows: DataFrame) -> DataFrame:
    """rows with last, dist_to, area_to and elev_to; those of single steps where they have none."""
    own = {"last": "step", **{f"{c}_to": c for c in ("dist", "area", "elev")}}
    return rows.withColumns({c: F.col(o) for c, o in own.items() if c not in rows.columns and o in rows.columns})


def river_runs(rows: DataFrame) -> DataFrame:
    """rows: drop_id, step, dist, area, river. Runs of the river's name as it is carried on: drop_id, first, last, n, label,
    from_m, to_m."""
    rows = _spread(rows)
    filled = carry(rows, "river", F.col("area") >= 0.9 * F.lag("area_to").over(order()))
    filled = filled.withColumn("run", _changes(F.col("river"), order()))
    return filled.groupBy("drop_id", "run").agg(F.min("step").alias("first"), F.max("last").alias("last"), F.sum(F.col("last") - F.col("step") + 1).alias("n"), F.max("river").alias("label"), F.min("dist").alias("from_m"), F.max("dist_to").alias("to_m")).drop("run")


def runs(edges: DataFrame, drops: DataFrame, cells: DataFrame) -> DataFrame:
    """edges: cell_id, parent_id, without cycles; drops: drop_id, cell_id; cells: cell_id, label (of any type), hop (metres to the next
    cell). The runs of equal labels along the path of each drop: drop_id, run (from 1), first, last (steps), label, from_m, to_m, and
    what else cells has, of its first cell and, with _to, of its last one. A cell knows where its run ends and the next one begins, so what is listed is a row a run, not a row a step."""
    label = cells.select("cell_id", "label")
    goes_on = edges.where("parent_id is not null").join(label, "cell_id").join(label.select(F.col("cell_id").alias("parent_id"), F.col("label").alias("__below")), "parent_id")
    within = edges.select("cell_id").join(goes_on.where(F.col("label").eqNullSafe(F.col("__below"))).select("cell_id", "parent_id"), "cell_id", "left")
    steps = chase(edges.select(F.col("cell_id").alias("node"), F.col("parent_id").alias("to"), F.lit(1).alias("weight")))
    metres = chase(edges.join(cells.select("cell_id", "hop"), "cell_id").select(F.col("cell_id").alias("node"), F.col("parent_id").alias("to"), F.col("hop").alias("weight")))
    way = cut(steps.select(F.col("node").alias("cell_id"), F.col("total").alias("depth")).join(metres.select(F.col("node").alias("cell_id"), F.col("total").alias("way")), "cell_id"))
    ends = edges.select(F.col("cell_id").alias("term"), F.col("parent_id").alias("next")).join(way.select(F.col("cell_id").alias("term"), F.col("way").alias("__rest")), "term")
    more = [c for c in cells.columns if c not in ("cell_id", "label", "hop")]
    if more:
        ends = ends.join(cells.select(F.col("cell_id").alias("term"), *(F.col(c).alias(f"{c}_to") for c in more)), "term")
    same = chase(within.select(F.col("cell_id").alias("node"), F.col("parent_id").alias("to"), F.lit(1).alias("weight")))
    known = cut(same.select(F.col("node").alias("cell_id"), F.col("root").alias("term"), F.col("total").alias("__n")).join(ends, "term").drop("term"))
    begin = known.where("next is not null").select(F.col("next").alias("cell_id")).union(drops.select("cell_id")).distinct()
    starts = cut(known.join(begin, "cell_id", "left_semi").join(way, "cell_id").join(cells.drop("hop"), "cell_id"), known)
    listed = trace(starts.select("cell_id", F.col("next").alias("parent_id")), drops.select("drop_id", "cell_id"))
    own = drops.select("drop_id", "cell_id").join(way, "cell_id").select("drop_id", F.col("depth").alias("__depth"), F.col("way").alias("__way"))
    first = F.col("__depth") - F.col("depth")
    out = listed.join(starts.drop("next"), "cell_id").join(own, "drop_id")
    return out.select("drop_id", (F.col("step") + 1).alias("run"), first.alias("first"), (first + F.col("__n")).alias("last"), "label", (F.col("__way") - F.col("way")).alias("from_m"), (F.col("__way") - F.col("__rest")).alias("to_m"), *more, *(f"{c}_to" for c in more))


def absorbed(runs: DataFrame, small: Column) -> DataFrame:
    """runs as from river_runs(), those that are `small` between two runs of one label merged with both."""
    way = _by("first")
    before, after = F.lag("label").over(way), F.lead("label").over(way)
    inner = F.lag("first").over(way).isNotNull() & F.lead("first").over(way).isNotNull()
    out = runs.withColumn("__c", small & inner & before.eqNullSafe(after)).withColumn("__before", before)
    out = out.withColumn("__streak", F.sum((~F.col("__c")).cast("int")).over(way))
    place = F.row_number().over(W.partitionBy("drop_id", "__streak").orderBy("first")) - 1  # a streak begins with a run that stays
    out = out.withColumn("label", F.when(F.col("__c") & (place % 2 == 1), F.col("__before")).otherwise(F.col("label")))
    out = out.withColumn("__run", _changes(F.col("label"), way))
    return out.groupBy("drop_id", "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("label").alias("label"), F.min("from_m").alias("from_m"), F.max("to_m").alias("to_m")).drop("__run")


def lake_runs(rows: DataFrame) -> DataFrame:
    """rows: drop_id, step, dist, cls, and lake (a name or null). Runs of lake cells of 2 km or more: drop_id, first, last,
    from_m, to_m, name_in, name_out (of their first and last row), dist_in (that of the row before)."""
    rows = _spread(rows if "lake" in rows.columns else rows.withColumn("lake", F.lit(None).cast("string")))
    wet = F.coalesce(F.col("cls") == LAKE, F.lit(False))
    marked = rows.withColumn("run", _changes(wet, order())).withColumn("__ahead", F.lag("dist_to").over(order())).where(wet)
    out = marked.groupBy("drop_id", "run").agg(
        F.min("step").alias("first"), F.max("last").alias("last"), F.min("dist").alias("from_m"), F.max("dist_to").alias("to_m"),
        F.min_by("lake", "step").alias("name_in"), F.max_by("lake", "step").alias("name_out"), F.min_by("__ahead", "step").alias("dist_in"),
    )
    return out.where(F.col("to_m") - F.col("from_m") >= LAKE_RUN).drop("run")


def lake_passages(rows: DataFrame) -> DataFrame:
    """drop_id, first, until: the rows from `first` to `until` pass through a lake; gaps between lakes that count as one are
    part of the passage that begins before them."""
    runs, way = lake_runs(rows), _by("first")
    gap = F.lead("from_m").over(way) - F.col("to_m")
    near = F.lead("dist_in").over(way) - F.col("to_m") < SAME_LAKE_GAP
    one = near & ((gap < LAKE_GAP) | F.coalesce(F.col("name_out") == F.lead("name_in").over(way), F.lit(False)))
    return runs.select("drop_id", "first", F.when(one, F.lead("first").over(way) - 1).otherwise(F.col("last")).alias("until"))


def _on_rows(rows: DataFrame, runs: DataFrame, column: str, name: str) -> DataFrame:
    """rows with `name`: the column of the run that began last. They meet by path, as both are dealt by it, and not by path and step, for
    which all rows would be shuffled before and after; runs are few a path."""
    spans = runs.select(F.col("drop_id").alias("__drop"), F.col("first").alias("__first"), F.lead("first").over(_by("first")).alias("__next"), F.col(column).alias(name))
    within = (F.col("drop_id") == F.col("__drop")) & (F.col("step") >= F.col("__first")) & (F.col("__next").isNull() | (F.col("step") < F.col("__next")))
    return rows.join(spans, within, "left").drop("__drop", "__first", "__next")


def smoothed(rows: DataFrame) -> DataFrame:
    """rows (drop_id, step, dist, area, cls, river, lake) with `river` smoothed, `inside` (whether a row passes through a
    lake) and `lake` filled there. Rows are dealt by path, and windows and joins find them so."""
    rows = rows.repartition("drop_id")
    runs = river_runs(rows)
    for _ in range(2):
        runs = absorbed(runs, F.col("n") == 1)
    runs = absorbed(runs, F.col("to_m") - F.col("from_m") < SHORT_RUN)
    out = _on_rows(rows.drop("river"), runs.withColumnRenamed("label", "river"), "river", "river")
    out = _on_rows(out, lake_passages(rows), "until", "__until")
    out = out.withColumn("inside", F.coalesce(F.col("step") <= F.col("__until"), F.lit(False))).drop("__until")
    return carry(carry(out, "lake", F.col("inside")), "lake", F.col("inside"), backward=True)


def journey(paths: DataFrame) -> DataFrame:
    """paths: drop_id, step, dist, area, elev, cls, river, lake, country (nulls where not known), destination,
    destination_kind. Returns drop_id, stage, label, kind, name, from_m, to_m, area, fall, countries (in the order of first
    sight): rain, the stages, the destination. Null dist, area and elev count as 0; empty names as null."""
    columns = ["drop_id", "step", "dist", "area", "elev", "cls", "river", "lake", "country", "destination", "destination_kind"]
    spread = ["last", "dist_to", "area_to", "elev_to"]
    rows = _spread(paths).select(*columns, *spread).fillna(0, ["dist", "area", "elev", *spread[1:]]).withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("river", "lake", "country")})
    rows = smoothed(rows)
    name = F.when(F.col("inside"), F.col("lake")).otherwise(F.col("river"))
    rows = rows.withColumn("name", name).withColumn("label", F.coalesce("name", F.when(F.col("inside"), F.lit("Lake")).otherwise(h.size_class(F.col("area")))))
    kind = F.when(F.col("inside"), "lake").when(F.col("area") < 0.5, "overland").when(F.col("area") < 50, "stream").otherwise("river")
    rows = rows.withColumns({
        "kind": kind, "__from": F.coalesce(F.lag("dist_to").over(order()), F.lit(0.0)),
        "__fall": F.greatest(F.coalesce(F.lag("elev_to").over(order()) - F.col("elev"), F.lit(0.0)), F.lit(0.0)) + F.greatest(F.col("elev") - F.col("elev_to"), F.lit(0.0)),
        "run": _changes(F.col("label"), order()), "__new": ~F.col("country").eqNullSafe(F.lag("country").over(order())) | F.lag("country").over(order()).isNull(),
        "__run": _changes(F.col("label"), order()), "__end": F.col("step") == F.max("step").over(whole()),
    })
    rows = rows.withColumn("__new", F.col("country").isNotNull() & (F.col("__new") | (F.row_number().over(W.partitionBy("drop_id", "run").orderBy("step")) == 1)))
    seen = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("__new"), F.struct("step", "country")))), lambda c: c["country"]))
    first = lambda c: F.min_by(c, "step")
    runs = rows.groupBy("drop_id", "run").agg(
        first("label").alias("label"), first("kind").alias("kind"), first("name").alias("name"), first("__from").alias("from_m"), F.max("dist_to").alias("to_m"),
        F.max_by("area_to", "step").alias("area"), F.sum("__fall").alias("fall"), seen.alias("countries"),
    )
    zero, one = F.lit(0.0), F.array_compact(F.array("country"))
    rain = rows.where("step = 0").select("drop_id", F.lit(0).cast("long").alias("run"), F.lit("Rainfall").alias("label"), F.lit("rain").alias("kind"), F.lit(None).cast("string").alias("name"), zero.alias("from_m"), zero.alias("to_m"), "area", zero.alias("fall"), one.alias("countries"))
    arrival = F.when(F.col("destination_kind") == "lake", "lake").otherwise("sea")
    end = rows.where("__end").select("drop_id", F.lit(2**62).alias("run"), F.col("destination").alias("label"), arrival.alias("kind"), F.lit(None).cast("string").alias("name"), F.col("dist_to").alias("from_m"), F.col("dist_to").alias("to_m"), F.col("area_to").alias("area"), zero.alias("fall"), one.alias("countries"))
    return _told(rain.union(runs.select(*rain.columns)).union(end))


def _told(stages: DataFrame) -> DataFrame:
    """Short stages joined to the one before, fragments left out, numbered from 0."""
    way = _by("run")
    short = (F.col("to_m") - F.col("from_m") < SHORT_STAGE) & ~F.col("kind").isin("sea", "rain") & F.col("name").isNull()
    stages = stages.withColumn("__short", short)
    held = F.last(F.when(~F.col("__short"), F.struct("label")), True).over(way.rowsBetween(W.unboundedPreceding, -1))["label"]
    stages = stages.withColumn("__begins", ~F.col("__short") & ~F.col("label").eqNullSafe(held) | (F.row_number().over(way) == 1))
    stages = stages.withColumn("__group", F.sum(F.col("__begins").cast("int")).over(way))
    first, last = (lambda c: F.min_by(c, "run").alias(c)), (lambda c: F.max_by(c, "run").alias(c))
    merged = stages.groupBy("drop_id", "__group").agg(*map(first, ("label", "kind", "name", "from_m", "countries")), *map(last, ("to_m", "area")), F.sum("fall").alias("fall"))
    ends = (F.col("__group") == F.min("__group").over(whole())) | (F.col("__group") == F.max("__group").over(whole()))
    kept = merged.where(F.lit(True)).withColumn("__kept", ends | (F.col("to_m") - F.col("from_m") > FRAGMENT) | (F.col("kind") == "lake")).where("__kept")
    numbered = kept.withColumn("stage", (F.row_number().over(_by("__group")) - 1).cast("int"))
    return numbered.select("drop_id", "stage", "label", "kind", "name", "from_m", "to_m", "area", "fall", "countries")
