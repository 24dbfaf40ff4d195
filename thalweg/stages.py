"""Stages of a build that are kept: a stage runs again only when its inputs or parameters are others than before.

A store is a folder that all executors share. The table of a stage lies under root/name/key, the key being a digest of the
stage's name, parameters and version, of the keys of the stages it is made of, and of the tables that come from outside. It is
written under a name of its own and renamed, so that a table which is there is whole; two runs at once write the same."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = "name string, key string, path string, parameters string, made_of array<string>, columns array<string>, rows long, bytes long"


def digest(df: DataFrame) -> str:
    """A digest of a table's schema and rows, whatever their order: their number and two sums of hashes."""
    hashes = df.select(F.xxhash64(*df.columns).alias("a"), F.hash(*df.columns).cast("long").alias("b")) if df.columns else df.select(F.lit(0).alias("a"), F.lit(0).alias("b"))
    r = hashes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("a").bitwiseXOR(F.col("b")).cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(f"{df.schema.jsonValue()} {r.n} {r.a} {r.b}".encode()).hexdigest()


@dataclass
class Stage:
    """A table of the store; ran says whether this run made it."""

    name: str
    key: str
    table: DataFrame
    ran: bool


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._digests: dict[int, tuple[DataFrame, str]] = {}

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def key(self, name: str, made_of: list[Stage | DataFrame], parameters: dict, version: int = 1) -> str:
        def one(x: Stage | DataFrame) -> str:
            if isinstance(x, Stage):
                return x.key
            if id(x) not in self._digests:  # a table is read once a run, however many stages it goes into
                self._digests[id(x)] = x, digest(x)
            return self._digests[id(x)][1]

        said = json.dumps([name, version, parameters, [one(x) for x in made_of]], sort_keys=True, default=str)
        return hashlib.sha256(said.encode()).hexdigest()[:32]

    def run(self, name: str, make: Callable[..., DataFrame], *made_of: Stage | DataFrame, version: int = 1, **parameters) -> Stage:
        """make(*tables, **parameters), or what an earlier run has kept of it."""
        key = self.key(name, [*made_of], parameters, version)
        path = f"{self.root}/{name}/{key}"
        there = self._exists(path)
        if not there:
            made = make(*(x.table if isinstance(x, Stage) else x for x in made_of), **parameters)
            held = f"{self.root}/{name}/.{key}-{uuid.uuid4().hex}"
            made.write.parquet(held)
            fs, at = self._fs(held)
            if not fs.rename(at, self._fs(path)[1]) and not self._exists(path):
                raise OSError(f"{held} can't be renamed")
            if self._exists(held):  # another run was first
                fs.delete(at, True)
            self._told(name, key, path, parameters, made_of)
        return Stage(name, key, self.spark.read.parquet(path), not there)

    def _told(self, name: str, key: str, path: str, parameters: dict, made_of: tuple) -> None:
        fs, where = self._fs(path)
        table = self.spark.read.parquet(path)
        row = (name, key, path, json.dumps(parameters, sort_keys=True, default=str), [f"{x.name}/{x.key}" for x in made_of if isinstance(x, Stage)], table.columns, table.count(), fs.getContentSummary(where).getLength())
        self.spark.createDataFrame([row], _COLUMNS).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")

    def manifest(self) -> DataFrame:
        """A row for each table that was made: name, key, path, parameters, made_of, columns, rows, bytes."""
        if not self._exists(f"{self.root}/_manifest"):
            return self.spark.createDataFrame([], _COLUMNS)
        return self.spark.read.schema(_COLUMNS).parquet(f"{self.root}/_manifest").dropDuplicates(["name", "key"])

    def prune(self, keep: list[Stage]) -> int:
        """Deletes the tables of the store but those of these stages, and says how many."""
        kept, gone = {(s.name, s.key) for s in keep}, 0
        for r in self.manifest().select("name", "key", "path").collect():  # a row for each table
            if (r.name, r.key) not in kept and self._exists(r.path):
                fs, where = self._fs(r.path)
                fs.delete(where, True)
                gone += 1
        return gone
