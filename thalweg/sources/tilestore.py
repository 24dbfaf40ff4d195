"""A store of PNG tiles: publishing them with a manifest, reading their pixels as a data source, and looking points up.

A store is a folder: layer/sx/sy.png for each tile, and `manifest`, a Parquet table with a row for each of them (layer, sx, sy,
file, bytes, base, step). A tile that the manifest does not name was never published, and counts as sea; one that it names but that
can't be read or is damaged is a failure, which is told.

    spark.dataSource.register(TileSource)
    spark.read.format("tiles").load(root).where("layer = 'flow' and sx = 3")    # only those tiles are opened

Files are read by tasks through a file system of the store's URI (file:, hdfs:, s3:, ...)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import hydraulics as h
from ..functions.lineage import cut
from .tiles import OCEAN, SIZE, decode_png

#: Tiles that one task of the data source reads.
TILES_A_TASK = 16
#: Files are written under a name of the attempt and renamed, so that a lost attempt leaves no half of a tile.
_NAMES = ["layer", "sx", "sy", "file", "bytes", "base", "step"]


def tile_file(layer: str, sx: int, sy: int) -> str:
    return f"{layer}/{sx}/{sy}.png"


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def publish(tiles: DataFrame, root: str) -> DataFrame:
    """tiles: layer, sx, sy, data, and base, step where there are such columns. Writes a file for each by the tasks that hold them,
    and the manifest, which is returned. Tiles that the store has already are written over, and all stay in the manifest."""
    spark = tiles.sparkSession
    rows = tiles.select("layer", "sx", "sy", "data", *((F.col(c) if c in tiles.columns else F.lit(None)).cast("double").alias(c) for c in ("base", "step")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(root)
        for b in batches:
            names, sizes = [], []
            for layer, sx, sy, data in zip(*(b.column(c).to_pylist() for c in ("layer", "sx", "sy", "data")), strict=True):
                names.append(tile_file(layer, sx, sy)), sizes.append(len(data))
                fs.create_dir(f"{top}/{layer}/{sx}", recursive=True)
                with fs.open_output_stream(held := f"{top}/{layer}/{sx}/.{sy}.{uuid.uuid4().hex}", compression=None) as out:
                    out.write(data)
                fs.move(held, f"{top}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([b.column("layer"), b.column("sx"), b.column("sy"), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), b.column("base"), b.column("step")], _NAMES)

    written = cut(rows.mapInArrow(write, "layer string, sx long, sy long, file string, bytes long, base double, step double"))
    fs, top = _opened(root)
    if fs.get_file_info(f"{top}/manifest").type:
        written = cut(written.union(manifest(spark, root).join(written, ["layer", "sx", "sy"], "left_anti").select(*_NAMES)), written)
    written.write.mode("overwrite").parquet(f"{root}/manifest")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/manifest")


def summary(listed: DataFrame) -> DataFrame:
    """A row for each layer: tiles, bytes, and the box of its tiles."""
    return listed.groupBy("layer").agg(F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"), *(f(c).alias(n) for f, c, n in ((F.min, "sx", "sx0"), (F.min, "sy", "sy0"), (F.max, "sx", "sx1"), (F.max, "sy", "sy1"))))


@dataclass
class _Tiles(InputPartition):
    rows: list[tuple[str, int, int, str]]


_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


class TileReader(DataSourceReader):
    """Pixels of the tiles that filters on layer, sx and sy leave; the manifest is read once, on planning."""

    def __init__(self, root: str):
        self.root, self.asked = root, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("layer",), ("sx",), ("sy",)):
                self.asked.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        import pyarrow.parquet as pq
        from pyarrow import fs as files

        fs, top = _opened(self.root)
        parts = [x.path for x in fs.get_file_info(files.FileSelector(f"{top}/manifest")) if x.path.endswith(".parquet")]
        rows = sorted(tuple(r.values()) for p in parts for r in pq.read_table(p, columns=["layer", "sx", "sy", "file"], filesystem=fs).to_pylist())
        tests = {t.__name__: test for t, test in _TESTS.items()}
        kept = [r for r in rows if all(tests[t](r[("layer", "sx", "sy").index(c)], v) for t, c, v in self.asked)]
        return [_Tiles(kept[i : i + TILES_A_TASK]) for i in range(0, len(kept), TILES_A_TASK)]

    def read(self, partition: _Tiles | None) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(self.root)
        for layer, sx, sy, file in partition.rows if partition else ():  # none, where no tile is left
            with fs.open_input_stream(f"{top}/{file}", compression=None) as f:
                grid = decode_png(f.read())[:, :, 0]
            height, width = grid.shape
            n = height * width
            columns = [pa.array([layer] * n), pa.array(np.full(n, sx)), pa.array(np.full(n, sy)), pa.array(np.tile(np.arange(width), height) + sx * width), pa.array(np.repeat(np.arange(height), width) + sy * height), pa.array(grid.ravel().astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, ["layer", "sx", "sy", "px", "py", "v"])


class TileSource(DataSource):
    """Format "tiles": layer, sx, sy, px, py, v (the first sample) of the pixels of a store."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return "layer string, sx bigint, sy bigint, px bigint, py bigint, v int"

    def reader(self, schema) -> TileReader:
        return TileReader(self.options["path"])


def pixels(spark: SparkSession, root: str) -> DataFrame:
    """All pixels of a store; filters on layer, sx and sy choose the tiles that are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)
    return spark.read.format("tiles").load(root)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The tiles of a store as a table: layer, sx, sy, base, step, data; data is null where a file can't be read."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(root)
        for b in batches:
            for i, file in enumerate(b.column("file").to_pylist()):
                try:
                    with fs.open_input_stream(f"{top}/{file}", compression=None) as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("layer", "sx", "sy", "base", "step")), pa.array([data], pa.binary())], ["layer", "sx", "sy", "base", "step", "data"])

    return manifest(spark, root).mapInArrow(fetch, "layer string, sx long, sy long, base double, step double, data binary")


def _decoded(tiles: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """tiles: layer, sx, sy, data, base, step. layer, sx, sy, base, step, v (the first samples of its pixels, by rows), failed: whether it
    can't be read, or has another size."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (layer, data) in enumerate(zip(b.column("layer").to_pylist(), b.column("data").to_pylist(), strict=True)):
                try:
                    grid = decode_png(data)[:, :, 0]
                    v = grid.ravel().astype("int16") if grid.shape == (sizes[layer],) * 2 else None
                except Exception:  # noqa: BLE001  zlib, struct and type errors of damaged files
                    v = None
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("layer", "sx", "sy", "base", "step")), pa.array([v], pa.list_(pa.int16())), pa.array([v is None])], ["layer", "sx", "sy", "base", "step", "v", "failed"])

    rows = tiles.where(F.col("layer").isin(*sizes)).select("layer", "sx", "sy", F.col("base").cast("double").alias("base"), F.col("step").cast("double").alias("step"), "data")
    return rows.mapInArrow(decode, "layer string, sx long, sy long, base double, step double, v array<smallint>, failed boolean")


def probe(points: DataFrame, tiles: DataFrame, size: int = SIZE, shift: int = 1) -> tuple[DataFrame, DataFrame]:
    """points: drop_id, px, py (pixels of the flow layer). tiles: layer (flow; acc at half the resolution; elev, `shift` zooms lower,
    with base and step), sx, sy, data. Returns two tables. Points with dir, cls, area (km2) and elev: where no tile was published
    the sea without flow, area 0 and no elevation; where one was but can't be read the same, and incomplete is true. And the
    tiles that failed: layer, sx, sy. Each tile is decoded once, to an array that points are joined with, so a point is a row
    that is dealt by its tile of a layer and nothing else."""
    held = cut(_decoded(tiles, {"flow": size, "acc": size // 2, "elev": size}))
    there = F.col("px").isNotNull() & F.col("py").isNotNull()
    place = {}
    for layer, n, less in (("flow", size, 0), ("acc", size // 2, 1), ("elev", size, shift)):
        x, y = (F.when(there, F.shiftright(F.col(c).cast("long"), less)) for c in ("px", "py"))
        place[layer] = {"__sx": F.floor(x / n), "__sy": F.floor(y / n), "__at": (F.pmod(y, F.lit(n)) * n + F.pmod(x, F.lit(n))).cast("int")}
    out = points
    for layer, at in place.items():
        own = held.where(F.col("layer") == layer).select(F.col("sx").alias("__sx"), F.col("sy").alias("__sy"), F.struct("v", "failed", "base", "step").alias("__own"))
        found = F.struct(F.get("__own.v", "__at").cast("int").alias("v"), "__own.failed", "__own.base", "__own.step").alias(f"__{layer}")
        out = out.withColumns(at).join(own, ["__sx", "__sy"], "left").select(*out.columns, found)
    blank = lambda layer, v: F.coalesce(F.col(f"__{layer}.v"), F.lit(v))
    failed = [F.coalesce(F.col(f"__{layer}.failed"), F.lit(False)) for layer in place]
    told = {"dir": blank("flow", OCEAN << 4).bitwiseAND(15), "cls": F.shiftright(blank("flow", OCEAN << 4), 4), "area": h.decode_area(blank("acc", 0)), "elev": F.col("__elev.base") + F.col("__elev.v") * F.col("__elev.step"), "incomplete": failed[0] | failed[1] | failed[2]}
    read = out.select("px", "py", *(c for c in points.columns if c not in ("px", "py")), *(F.when(there, c).alias(n) for n, c in told.items()))
    asked = points.where(there).select(F.explode(F.array(*(F.struct(F.lit(layer).alias("layer"), at["__sx"].alias("sx"), at["__sy"].alias("sy")) for layer, at in place.items()))).alias("w")).select("w.*")
    return read, held.where("failed").select("layer", "sx", "sy").join(asked, ["layer", "sx", "sy"], "left_semi").distinct()
