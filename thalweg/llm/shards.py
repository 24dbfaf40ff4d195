"""Files that executors write beside each other: temporary names, a row of the manifest for each, and a commit.

A task writes under names of its own and gives back manifest rows; those of successful attempts make up a table. Tasks over
that table rename the files, which may be done again after a loss, and write the manifest, which one rename makes valid. Readers
follow the manifest, so a lost or repeated attempt leaves nothing that is read. Nothing is collected: names, sizes and
places of files stay in tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import file_system

#: Shards whose sums make one row of the upper level of a prefix sum.
GROUP = 4096


class ShardFile:
    """A file under a temporary name in `root`/_temporary."""

    def __init__(self, root: str, name: str):
        self.name, self.temporary = name, f"_temporary/{name}.{uuid.uuid4().hex}"
        fs, base = file_system(root)
        fs.create_dir(f"{base}/_temporary", recursive=True)
        self.out, self.size = fs.open_output_stream(f"{base}/{self.temporary}", compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def commit(root: str, written: DataFrame) -> DataFrame:
    """written: temporary, name and more, a row for each file. Renames the files, writes the manifest, returns it: a table of
    those columns without `temporary`."""
    spark = written.sparkSession
    fs, base = file_system(root)
    fs.create_dir(base, recursive=True)
    written.write.mode("overwrite").parquet(f"{root}/_written")
    listed = spark.read.schema(written.schema).parquet(f"{root}/_written")
    kept = [c for c in listed.columns if c != "temporary"]

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        there, top = file_system(root)
        for b in batches:
            for before, after in zip(b.column("temporary").to_pylist(), b.column("name").to_pylist(), strict=True):
                if there.get_file_info(f"{top}/{before}").type != files.FileType.NotFound:  # else an attempt before has done it
                    there.move(f"{top}/{before}", f"{top}/{after}")
            yield b.select(kept)

    listed.mapInArrow(rename, listed.select(*kept).schema).write.mode("overwrite").parquet(f"{root}/_manifest")
    fs.move(f"{base}/_manifest", f"{base}/manifest")
    for rest in ("_temporary", "_written"):
        if fs.get_file_info(f"{base}/{rest}").type:
            fs.delete_dir(f"{base}/{rest}")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/manifest")


def with_starts(rows: DataFrame, shard: str, amount: str) -> DataFrame:
    """Adds start: the sum of `amount` over all smaller shards. Two levels, so that no window holds more than GROUP rows, or
    a row for each GROUP shards."""
    group = F.floor(F.col(shard) / GROUP)
    sums = rows.groupBy(group.alias("__g")).agg(F.sum(amount).alias("__sum"))
    sums = sums.select("__g", F.coalesce(F.sum("__sum").over(W.orderBy("__g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum(amount).over(W.partitionBy("__g").orderBy(shard).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__g", group).withColumn("__in", within).join(sums, "__g").withColumn("start", (F.col("__base") + F.col("__in")).cast("long")).drop("__g", "__in", "__base")
