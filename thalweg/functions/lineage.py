"""Cutting lineage in loops through the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PATH = "_thalweg_cut"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a single machine, else an error."""
    scala = spark.sparkContext._jsc.sc()
    if not scala.getCheckpointDir().isDefined():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="thalweg-"))
    return scala.getCheckpointDir().get()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run within go when it has run, as nothing reads them again, and not when their tables are collected."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, *replaces: DataFrame) -> DataFrame:
    """df written as a table under spark.checkpoint.dir and read again. A table rather than a checkpoint: the plan runs once,
    and the sizes that the planner sees are those of files, where those carried by checkpoints multiply from join to join of
    a loop. replaces: tables of cut() that nothing reads any more once df is written; they are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with passing(spark):
        df.write.parquet(path)
    drop(*replaces)
    return _read(spark, df, path)


def add(table: DataFrame | None, df: DataFrame) -> DataFrame:
    """df appended to a table of cut(), or to a new one."""
    path = getattr(table, _PATH, None)
    if path is None:
        return cut(df)
    with passing(df.sparkSession):
        df.write.mode("append").parquet(path)
    return _read(df.sparkSession, df, path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut()."""
    for t in tables:
        if path := getattr(t, _PATH, None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def _read(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out
