"""Token ids in binary files: ids ranked by frequency, in byte-aligned codes of variable length with separate control bytes.

Frequencies are counted over all documents, so the commonest 256 ids take a byte, the next 65,280 two. A control byte
holds the lengths of four ids, two bits each (length - 1); the data bytes stand apart, little-endian. Reading looks the
control bytes up in a table of lengths, sums them to offsets and gathers the data bytes, all in numpy.

A file is a row of blocks: magic, counts of documents, ids, control and data bytes (4 x uint64), document ids (int64), a
byte each that is 1 where the id is null, ids for each document (uint64), control bytes, data bytes. Files hold documents
in ascending doc_id order, null first; rows of equal doc_id stand in the order of their crc32 within a file. `ranks` holds
the ids by rank (uint32). A file is a task, cut by doc_id; a single doc_id (or null) with more ids than a file holds is dealt
over several. Cases: null and empty texts hold the end id alone; an empty table gives no file and no rows; rows that repeat
are documents of their own; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, file_system, key_ranges, number_among_equals, slices
from .shards import ShardFile, commit, with_starts
from .tokens import Encoder

MAGIC = b"TWIDS\x00\x00\x01"
IDS_PER_FILE, IDS_PER_BLOCK = 4_000_000, 500_000
#: Rows that a worker takes from a batch together.
SLICE = 500
_CODE = np.arange(256)
#: Lengths of the four ids of a control byte.
LENGTHS = np.stack([((_CODE >> s) & 3) + 1 for s in (0, 2, 4, 6)], 1).astype("int64")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    r = ranks.astype("uint32")
    size = 1 + (r >= 1 << 8).astype("int64") + (r >= 1 << 16) + (r >= 1 << 24)
    codes = np.zeros(-len(r) % 4 + len(r), "int64")
    codes[: len(r)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(1).astype("uint8")
    four = r.astype("<u4").view("uint8").reshape(-1, 4)
    return control.tobytes(), four[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, "uint8")].ravel()[:n]
    begin = np.cumsum(size) - size
    x = np.concatenate([np.frombuffer(data, "uint8"), np.zeros(4, "uint8")])
    out = x[begin].astype("uint32")
    for i in range(1, int(size.max()) if n else 0):
        some = np.flatnonzero(size > i)
        out[some] |= x[begin[some] + i].astype("uint32") << np.uint32(8 * i)
    return out


def id_type(path: str) -> str:
    """The narrowest type for the ids of a vocabulary, in tables of this operator."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, path: str, kind: str, end: int, dtype: str) -> DataFrame:
    """doc_id, n, crc (of the ids as uint32), ids (as dtype), with the id `end` after each document."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = Encoder.of(path, kind), np.array([end], "<u4")
        for b in slices(batches, 4 * SLICE):
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            n, crc, raw, size, first = [], [], [], 0, 0
            for i, x in encoder.encode(texts):
                own = np.concatenate([x.astype("<u4"), stop])
                n.append(len(own)), crc.append(zlib.crc32(own)), raw.append(own.astype(dtype).tobytes())
                size += len(raw[-1])
                if size > 1 << 24 or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(n)), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "n", "crc", "ids"])
                    n, crc, raw, size, first = [], [], [], 0, i + 1

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, n long, crc long, ids binary")


def frequencies(tokens: DataFrame, dtype: str) -> list[int]:
    """All ids that occur, the commonest first, ties by id. At most the size of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(0, "int64")
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype))
            if len(c) > len(count):
                c, count = count, c
            count[: len(c)] += c
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some].astype("int64"))], ["id", "count"])

    counted = tokens.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    return [r.id for r in sorted(counted.collect(), key=lambda r: (-r["count"], r.id))]


def write(spark: SparkSession, tokens: DataFrame, root: str, dtype: str, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """tokens: a table as from tokenise(). Writes the files under root and returns the manifest: name, shard, docs, ids, bytes."""
    by_rank = frequencies(tokens, dtype)
    rank = np.zeros(max(by_rank, default=0) + 1, "uint32")
    rank[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank)  # bounded by the vocabulary
    ranges = key_ranges(Scratch(spark, "tokenfile"), tokens, "doc_id", F.col("n"), ids_per_file)

    def block(rows: list[tuple]) -> bytes:
        ids = ranks.value[np.frombuffer(b"".join(r[2] for r in rows), dtype)]
        control, data = pack(ids)
        head = np.array([len(rows), len(ids), len(control), len(data)], "<u8").tobytes()
        keys = np.array([r[0] or 0 for r in rows], "<i8").tobytes()
        return b"".join([MAGIC, head, keys, bytes(r[0] is None for r in rows), np.array([r[1] for r in rows], "<u8").tobytes(), control, data])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: ShardFile | None = None
        held, shard, docs, ids, waiting = [], 0, 0, 0, 0
        for b in slices(batches, SLICE):
            for shard, k, n, raw in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "n", "ids")), strict=True):
                out = out or ShardFile(root, f"ids-{shard:08d}.bin")
                held.append((k, n, raw))
                docs, ids, waiting = docs + 1, ids + n, waiting + n
                if waiting >= IDS_PER_BLOCK:
                    out.write(block(held))
                    held, waiting = [], 0
        if out:
            out.write(block(held)) if held else None
            out.close()
            yield pa.RecordBatch.from_pylist([{"temporary": out.temporary, "name": out.name, "shard": shard, "docs": docs, "ids": ids, "bytes": out.size}], schema)

    schema = pa.schema([("temporary", pa.string()), ("name", pa.string()), ("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
    # an id with more ids than a file holds is dealt by content, and rows that are equal in all by a number among them
    heavy = ranges.null_splits > 1 or bool((ranges.splits > 1).any())
    rows = number_among_equals(tokens, ["doc_id", "crc", "n"], "k") if heavy else tokens.withColumn("k", F.lit(0))
    tie = F.xxhash64("crc", "n", "k")
    dealt = rows.withColumn("shard", ranges.shard(F.col("doc_id"), tie)).repartitionById(ranges.shards, "shard")
    dealt = dealt.sortWithinPartitions("doc_id", "crc").select("shard", "doc_id", "n", "ids")
    rows = commit(root, dealt.mapInArrow(run, "temporary string, name string, shard int, docs long, ids long, bytes long"))
    fs, base = file_system(root)
    with fs.open_output_stream(f"{base}/ranks.bin", compression=None) as out:
        out.write(np.array(by_rank, "<u4").tobytes())
    return rows


def read(spark: SparkSession, root: str, listed: DataFrame, id_kind: str = "bigint", ids_too: bool = True) -> DataFrame:
    """listed: the manifest. doc_id, start, n_tokens, ids_crc32, and ids (uint32 bytes) if ids_too, of every document in the
    files, a task for each file."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids_too else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(root)
        with fs.open_input_stream(f"{top}/ranks.bin", compression=None) as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    while head := f.read(len(MAGIC)):
                        if head != MAGIC:
                            raise ValueError(f"{name} is not a file of token ids")
                        docs, n, control, data = np.frombuffer(f.read(32), "<u8").tolist()
                        keys, null = np.frombuffer(f.read(8 * docs), "<i8").tolist(), f.read(docs)
                        sizes = np.frombuffer(f.read(8 * docs), "<u8").astype("int64")
                        ids = by_rank[unpack(f.read(control), f.read(data), n)].astype("<u4").tobytes()
                        ends = np.cumsum(sizes)
                        own = [ids[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([None if z else k for k, z in zip(keys, null, strict=True)], pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in own], pa.int64()), *([pa.array(own, pa.binary())] if ids_too else [])],
                            names,
                        )
                        start += n

    tasks = max(1, listed.count())
    files = with_starts(listed, "shard", "ids").select("name", "start").repartition(tasks)
    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids_crc32 long{', ids binary' if ids_too else ''}").withColumn("doc_id", F.col("doc_id").cast(id_kind))


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, kind: str = "word", end: int = 1, ids_too: bool = True) -> DataFrame:
    """Tokenizes, writes the files into the shared folder, and reads them back."""
    scratch = Scratch(spark, "tokenfile")
    dtype = id_type(path)
    tokens = scratch.save(tokenise(docs, path, kind, end, dtype), "tokens")
    rows = write(spark, tokens, scratch.path("files"), dtype)
    scratch.drop("tokens")
    return read(spark, scratch.path("files"), rows, docs.schema["doc_id"].dataType.simpleString(), ids_too)
