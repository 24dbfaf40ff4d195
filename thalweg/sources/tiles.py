"""Grids as PNG tiles, elevation from terrain tiles, and GeoJSON: reading and writing."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hydraulics as h

SIZE, OCEAN = 512, 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit samples, (height, width) grey or (height, width, 3) red, green, blue."""
    height, width = pixels.shape[:2]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 9)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, samples) of an 8-bit PNG without a palette or interlacing; ValueError for any other."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, piece = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", piece)
        body += piece if kind == b"IDAT" else b""
        at += 12 + n
    samples = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3]) if head else None
    if samples is None or head[2] != 8 or head[6]:
        raise ValueError("a PNG of this kind is not read")
    width, height = head[:2]
    stride = width * samples
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        line, above, kind = raw[y, 1:], out[y], raw[y, 0]
        if kind in (0, 2):
            out[y + 1] = line + above if kind else line
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(width, samples), axis=0, dtype=np.uint8).reshape(-1)
        else:
            now = out[y + 1]
            for i in range(stride):
                left, up = (int(now[i - samples]) if i >= samples else 0), int(above[i])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = int(above[i - samples]) if i >= samples else 0
                    guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                now[i] = (int(line[i]) + guess) & 255
    return out[1:].reshape(height, width, samples)


def flow_tiles(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """cells: px, py, dir, cls. Returns layer, sx, sy, data: a PNG of packed bytes a tile; absent cells are ocean, and tiles
    that hold ocean without flow only are left out."""
    packed = cells.select(F.floor(F.col("px") / size).alias("sx"), F.floor(F.col("py") / size).alias("sy"), F.pmod("px", F.lit(size)).alias("x"), F.pmod("py", F.lit(size)).alias("y"), h.pack_flow(F.col("dir"), F.col("cls")).cast("int").alias("v"))
    wanted = packed.where(F.col("v") != OCEAN << 4).select("sx", "sy").distinct()
    return _paint(packed.join(wanted, ["sx", "sy"], "left_semi"), "flow", size, OCEAN << 4)


def area_tiles(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """cells: px, py, acc (km2). Tiles at half resolution: the largest encoded area of each 2 by 2 cells."""
    pooled = cells.groupBy(F.floor(F.col("px") / 2).alias("px"), F.floor(F.col("py") / 2).alias("py")).agg(F.max(h.encode_area(F.col("acc"))).alias("v"))
    half = size // 2
    return _paint(pooled.select(F.floor(F.col("px") / half).alias("sx"), F.floor(F.col("py") / half).alias("sy"), F.pmod("px", F.lit(half)).alias("x"), F.pmod("py", F.lit(half)).alias("y"), "v"), "acc", half, 0)


def elevation_tiles(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """cells: px, py, z. Each tile has a base and a step, and a byte a cell; deep sea tiles are left out."""
    at = cells.where("z is not null").select(F.floor(F.col("px") / size).alias("sx"), F.floor(F.col("py") / size).alias("sy"), F.pmod("px", F.lit(size)).alias("x"), F.pmod("py", F.lit(size)).alias("y"), "z")
    span = at.groupBy("sx", "sy").agg(F.greatest(F.min("z"), F.lit(-600)).cast("double").alias("base"), F.max("z").alias("hi")).where("hi >= -400")
    span = span.select("sx", "sy", "base", F.greatest(F.lit(0.25), (F.col("hi") - F.col("base")) / 250.0).alias("step"))
    v = at.join(span, ["sx", "sy"]).withColumn("v", h.clip(F.bround((F.col("z") - F.col("base")) / F.col("step")), 0, 255).cast("int"))
    return _paint(v, "elev", size, 0).join(span, ["sx", "sy"])


def _paint(at: DataFrame, layer: str, size: int, blank: int) -> DataFrame:
    """A tile a group: its rows are bounded by size squared."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((size, size), blank, np.uint8)
        grid[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows["v"].to_numpy()
        return pd.DataFrame({"layer": [layer], "sx": [rows["sx"].iloc[0]], "sy": [rows["sy"].iloc[0]], "data": [encode_png(grid)]})

    return at.select("sx", "sy", "x", "y", "v").groupBy("sx", "sy").applyInPandas(draw, "layer string, sx long, sy long, data binary")


def read_tiles(tiles: DataFrame) -> DataFrame:
    """layer, sx, sy, data to layer, px, py, v (the first sample): tiles of any size, nulls left out."""

    def unfold(parts):
        for rows in parts:
            for r in rows.itertuples(index=False):
                grid = decode_png(r.data)[:, :, 0]
                y, x = np.indices(grid.shape)
                yield pd.DataFrame({"layer": r.layer, "px": (x + r.sx * grid.shape[1]).ravel(), "py": (y + r.sy * grid.shape[0]).ravel(), "v": grid.ravel().astype(np.int32)})

    return tiles.where("data is not null").select("layer", "sx", "sy", "data").mapInPandas(unfold, "layer string, px long, py long, v int")


def terrain(tiles: DataFrame) -> DataFrame:
    """tx, ty, data (terrain PNG) to px, py, z: red * 256 + green + blue / 256 - 32768 metres, at least -12000."""

    def unfold(parts):
        for rows in parts:
            for r in rows.itertuples(index=False):
                rgb = decode_png(r.data).astype(np.float64)
                y, x = np.indices(rgb.shape[:2])
                z = np.maximum(rgb[:, :, 0] * 256 + rgb[:, :, 1] + rgb[:, :, 2] / 256 - 32768, -12000)
                yield pd.DataFrame({"px": (x + r.tx * rgb.shape[1]).ravel(), "py": (y + r.ty * rgb.shape[0]).ravel(), "z": z.ravel()})

    return tiles.where("data is not null").select("tx", "ty", "data").mapInPandas(unfold, "px long, py long, z double")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row a part: feature (order in its file), path, type, name, properties (JSON), rings. Parts of multi-geometries are
    rows of their own; a line is one ring, a point a ring of one vertex. A file is one document, so its features are rows
    of one task; files are tasks of their own. Features without geometry are left out."""

    def parts(geometry: dict):
        kind, c = geometry["type"], geometry["coordinates"]
        for part in c if kind.startswith("Multi") else [c]:
            kept = {"Point": lambda p: [[p]], "LineString": lambda p: [p], "Polygon": lambda p: p}[kind.removeprefix("Multi")](part)
            yield kind.removeprefix("Multi"), [[{"lon": float(q[0]), "lat": float(q[1])} for q in ring] for ring in kept]

    def unfold(files):
        for rows in files:
            for r in rows.itertuples(index=False):
                out = []
                for i, f in enumerate(json.loads(bytes(r.content)).get("features") or []):
                    if f.get("geometry"):
                        props = f.get("properties") or {}
                        out += [(r.path, i, kind, props.get("name"), json.dumps(props, ensure_ascii=False), rings) for kind, rings in parts(f["geometry"])]
                yield pd.DataFrame(out, columns=["path", "feature", "type", "name", "properties", "rings"])

    schema = "path string, feature long, type string, name string, properties string, rings array<array<struct<lon:double,lat:double>>>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unfold, schema)


def to_geojson(shapes: DataFrame, properties: list[str], places: int = 5) -> DataFrame:
    """A JSON feature a row, of coords (a line) or rings (a polygon), coordinates rounded; null properties are left out. Write
    the result with `.write.text`."""
    pair = lambda p: F.array(F.round(p["lon"], places), F.round(p["lat"], places))
    if "rings" in shapes.columns:
        kind, coords = "Polygon", F.transform("rings", lambda r: F.transform(r, pair))
    else:
        kind, coords = "LineString", F.transform("coords", pair)
    geometry = F.struct(F.lit(kind).alias("type"), coords.alias("coordinates"))
    return shapes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))
