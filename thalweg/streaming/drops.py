"""Drops that arrive as a stream, traced against a built grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def destinations(drops: DataFrame, cells: DataFrame) -> DataFrame:
    """drops: drop_id, cell_id, streaming or not; cells: cell_id, term, acc, cls as built. Adds basin_id, start_area and
    end_cls: two joins with static tables, so there is no state, no watermark, and late rows are as good as others. Drops
    off the grid keep nulls."""
    at = cells.select("cell_id", F.col("term").alias("basin_id"), F.col("acc").alias("start_area"))
    end = cells.select(F.col("cell_id").alias("basin_id"), F.col("cls").alias("end_cls"))
    return drops.join(at, "cell_id", "left").join(end, "basin_id", "left").select(*drops.columns, "basin_id", "start_area", "end_cls")
