"""Shared pieces: table access, scratch tables in the shared folder, deterministic key ranges, file system access.

What reaches the driver grows with the number of shards only, which is a matter of a parameter.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes that separate words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as a URI. Where it is unset, a temporary one on a single machine, else an error."""
    current = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not made.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = made.get() if made.isDefined() else "file://" + tempfile.mkdtemp(prefix="thalweg-")
        spark.conf.set("spark.checkpoint.dir", current)
    return current if "://" in current or current.startswith("file:") else "file://" + current


class Scratch:
    """Tables of one operator run, written as Parquet to the shared folder so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """Appends to a table of this run."""
        df.write.mode("append").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def keep(self, *names: str) -> None:
        """Drops all tables of this run but these."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if found.exists(root):
            self.drop(*({x.getPath().getName() for x in found.listStatus(root)} - set(names)))


def file_system(uri: str):
    """A pyarrow file system that executors and the driver can both open, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Small tables are broadcast up to so many bytes, by their count and width; beyond, they come in COPIES.
BROADCAST, COPIES = 8 << 20, 16


def looked_up(left: DataFrame, right: DataFrame, key: list[str], width: int, deal: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for each key, of about `width` bytes; a key may hold a third of left. Where
    right is too large to broadcast, it comes in copies, over which left is dealt by a hash of its columns `deal`."""
    if right.count() * width <= BROADCAST:
        return left.join(F.broadcast(right), key, how)
    copies = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return left.withColumn("__copy", F.pmod(F.xxhash64(*deal), F.lit(COPIES)).cast("int")).join(copies, [*key, "__copy"], how).drop("__copy")


def numbered(scratch: Scratch, docs: DataFrame, name: str) -> DataFrame:
    """docs as a table, with a number of its own for each row, so that rows of equal ids are told apart."""
    return scratch.save(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def number_among_equals(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows: a table. Adds a number from 0 on among the rows of equal keys, dense, so that how many have which does not depend on
    how rows lie in files. Each file numbers its own; a key adds up its files, not its rows."""
    rows = rows.withColumns({"__file": F.col("_metadata.file_name"), "__at": F.col("_metadata.row_index")})
    own = rows.withColumn(name, F.row_number().over(W.partitionBy(*keys, "__file").orderBy("__at")) - 1)
    sums = rows.groupBy(*keys, "__file").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__file").rowsBetween(W.unboundedPreceding, -1))
    later = sums.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), F.col("__file").alias("__f"), before.alias("__before")).where("__before > 0")
    same = F.col("__file") == F.col("__f")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__{i}"))
    out = own.join(later, same, "left").withColumn(name, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("long"))
    return out.select(*(c for c in rows.columns if c not in ("__file", "__at")), name)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, so few at a time that what is made of them is small beside the batch."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def column_values(column: pa.ChunkedArray | pa.Array) -> list:
    return column.to_pylist()


@dataclass
class KeyRanges:
    """Disjoint ranges of a long key, in ascending order; range i holds the shards base[i] .. base[i] + splits[i] - 1."""

    starts: np.ndarray
    base: np.ndarray
    splits: np.ndarray
    null_splits: int
    shards: int

    def shard(self, key: Column, tie: Column) -> Column:
        """The shard of a row. tie: a long that deals out the rows of a single heavy key, which no range can part."""
        shared = SparkSession.active().sparkContext.broadcast((self.starts, self.base, self.splits, self.null_splits))

        @F.pandas_udf("int")
        def find(k: pd.Series, t: pd.Series) -> pd.Series:
            starts, base, splits, nulls = shared.value
            missing = k.isna().to_numpy()
            at = np.searchsorted(starts, k.fillna(0).astype("int64").to_numpy(), side="right") - 1
            at = np.clip(at, 0, max(len(starts) - 1, 0))
            u = t.to_numpy().astype("int64").view("uint64")
            out = base[at] + (u % splits[at].astype("uint64")).astype("int64") if len(starts) else np.zeros(len(k), "int64")
            return pd.Series(np.where(missing, (u % np.uint64(max(nulls, 1))).astype("int64"), out).astype("int32"))

        return find(key.cast("long"), tie.cast("long"))


#: Bits of a key that a level of histograms tells apart; buckets that a level may send to the driver.
RADIX, MOST_BUCKETS = 12, 1 << 20
_SIGN = -(2**63)


def key_ranges(scratch: Scratch, df: DataFrame, key: str, weight: Column, target: float) -> KeyRanges:
    """Cuts the values of `key` into ranges of about `target` weight each, by exact histograms, so reruns give the same cuts.

    Buckets are prefixes of the key's bits. Those heavier than `target` (fewer than there will be shards) are cut again, all
    of them by one job, until they are light or hold a single value; such a value gets several shards. So a job is run for
    each level, 6 at most, whatever the data, over a table that holds keys and weights alone."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").bitwiseXOR(F.lit(_SIGN)).alias("u"), F.coalesce(weight, F.lit(0)).cast("double").alias("w"))
    rows = scratch.save(rows, "weights")  # u: as an unsigned number, in the order of the keys
    bound = F.col("u").bitwiseXOR(F.lit(_SIGN))
    lo, hi, nulls = rows.agg(F.min(bound), F.max(bound), F.sum(F.when(F.col("u").isNull(), F.col("w")))).first()
    null_splits = int((nulls or 0) // target) + 1 if nulls is not None else 0
    leaves: list[tuple[int, float, bool]] = []
    if lo is not None:
        shift = max(1, ((lo ^ hi) % 2**64).bit_length())  # all keys agree in the bits above
        heavy = [(lo ^ _SIGN) % 2**64 >> shift]
        while heavy:
            step = min(shift, RADIX, max(1, (MOST_BUCKETS // len(heavy)).bit_length() - 1))
            cut = rows.where("u is not null")
            if shift < 64:
                prefixes = spark.createDataFrame([(p,) for p in heavy], "p long")
                cut = cut.withColumn("p", F.shiftrightunsigned("u", shift)).join(F.broadcast(prefixes), "p", "left_semi")  # fewer than shards
            found = cut.groupBy((F.shiftrightunsigned("u", shift - step) if shift > step else F.col("u")).alias("p")).agg(F.sum("w").alias("w")).collect()
            shift, heavy = shift - step, []
            for r in found:
                p = r.p % 2**64
                if r.w > target and shift:
                    heavy.append(p)
                else:
                    leaves.append((p << shift, r.w, shift == 0 and r.w > target))
    scratch.drop("weights")
    starts, base, splits, shard, load = [], [], [], null_splits, 0.0
    for first, w, single in sorted(leaves):
        if starts and not single and load + w <= target:
            load += w
            continue
        n = int(w // target) + 1 if single else 1
        starts.append(first + _SIGN), base.append(shard), splits.append(n)
        shard, load = shard + n, target if single else w
    as_long = lambda x: np.array(x, dtype="int64")
    return KeyRanges(as_long(starts), as_long(base), as_long(splits), null_splits, max(shard, 1))
