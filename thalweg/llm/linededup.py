"""Removing repeated passages: by whole passages (dedup_passages), or by content-defined chunks of lines alone (dedup_lines).

Units are compared by 128-bit digest, and those whose digest occurs more than once byte by byte with the first of them
(smallest doc_id, then place). Only digests are shuffled for all units; the bytes of one travel only where its digest
repeats.

Passages: the units are all pairs of neighbouring lines, and single lines of WORDS words or more. Units that repeat an
earlier one and share a line make up a run; a run goes if it has WORDS words or more, or holds a whole chunk. So every
run of whole lines of WORDS words or more that occurs earlier goes from end to end, however its chunks lie. The first
occurrence of a line never goes: no unit around it repeats an earlier one.

Chunks: a rolling hash over the hashes of the last WINDOW lines says where a chunk ends, so an inserted or deleted line
moves only the boundaries beside it. Where it says so nowhere in MOST_LINES lines, the chunk ends after the line of largest
hash among them, which is content-defined too. Chunks of two or more lines are the units of dedup_lines, and those that
repeat go. A digest that more than SHARE units have is dealt over as many tasks as it takes, its first unit in copies.

Cases: null texts stay null; single lines of fewer words are never removed by themselves; rows equal in doc_id and text count
as one document; a null doc_id sorts first; a document may lose its whole text and then has ''; a column lines_removed of
the input is replaced; an empty table gives an empty result; different units of one digest are told apart by their bytes.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, looked_up, slices

WINDOW, DIVISOR, MOST_LINES = 2, 3, 64
#: Rows that a worker takes apart together; units of one digest that a task takes.
SLICE, SHARE = 500, 4096
#: A repeated passage of so many words goes, whatever its lines.
WORDS = 50
#: Names of columns that this operator adds for a while, beside any that documents may have.
OWN, REMOVED = ("__linededup_id", "__linededup_of", "__linededup_hash"), "__linededup_removed"
_BASE, _MASK = 0x100000001B3, (1 << 64) - 1


def chunk_lines(lines: list[bytes], window: int = WINDOW, divisor: int = DIVISOR, most: int = MOST_LINES) -> list[tuple[int, int]]:
    """The chunks as ranges of lines. A chunk ends after a line where the hash of the last `window` lines says so."""
    drop = pow(_BASE, window, 1 << 64)
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    mixed, roll = [], 0
    for i, h in enumerate(hashes):
        roll = (roll * _BASE + h - (hashes[i - window] * drop if i >= window else 0)) & _MASK
        mixed.append(((roll ^ (roll >> 29)) * 0x9E3779B97F4A7C15 & _MASK) >> 32)
    begin, out = 0, []
    while begin < len(lines):
        ahead = mixed[begin : begin + most]
        end = next((k for k, m in enumerate(ahead) if m % divisor == 0), len(ahead) - 1 if begin + most >= len(lines) else ahead.index(max(ahead)))
        out.append((begin, begin + end + 1))
        begin += end + 1
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def chunk_units(lines: list[bytes]) -> list[tuple[int, int]]:
    """The chunks of two or more lines."""
    return [(s, e) for s, e in chunk_lines(lines) if e - s > 1] if len(lines) > 1 else []


def passage_units(lines: list[bytes]) -> list[tuple[int, int]]:
    """All pairs of neighbouring lines, and single lines of WORDS words or more."""
    return [(i, i + 2) for i in range(len(lines) - 1)] + [(i, i + 1) for i, x in enumerate(lines) if len(x) >= 2 * WORDS - 1 and len(x.split()) >= WORDS]


def passages(lines: list[bytes], units: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of lines that go. units: those that repeat an earlier one; they are joined where they share a line."""
    runs: list[list[int]] = []
    for s, e in sorted(units):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    chunks: list[tuple[int, int]] | None = None
    out = []
    for s, e in runs:
        if sum(len(x.split()) for x in lines[s:e]) < WORDS:
            chunks = chunk_units(lines) if chunks is None else chunks
            at = bisect.bisect_left(chunks, (s, s))
            if at == len(chunks) or chunks[at][1] > e:
                continue
        out.append((s, e))
    return out


def unit_table(docs: DataFrame, units: Callable[[list[bytes]], list[tuple[int, int]]], digest: Callable[[bytes], int] = xxhash.xxh3_128_intdigest) -> DataFrame:
    """docs: doc_id, text, th (a hash of the text). A row for each unit: its lines and digest."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            at, i, j, h1, h2 = [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                lines = _split(text) if text else []
                for s, e in units(lines):
                    d = digest(b"\n".join(lines[s:e]))
                    at.append(row), i.append(s), j.append(e), h1.append(_signed(d >> 64)), h2.append(_signed(d & _MASK))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("th").take(rows), *(pa.array(x, pa.int32()) for x in (i, j)), *(pa.array(x, pa.int64()) for x in (h1, h2))], ["doc_id", "th", "i", "j", "h1", "h2"])

    return docs.select("doc_id", "text", "th").mapInArrow(run, f"doc_id {kind}, th long, i int, j int, h1 long, h2 long")


def _bodies(docs: DataFrame) -> DataFrame:
    """docs: doc_id, th, text, chunks. A row for each of the chunks, with its bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            at, found, body = [], [], []
            for row, (text, chunks) in enumerate(zip(b.column("text").to_pylist(), b.column("chunks").to_pylist(), strict=True)):
                lines = _split(text)
                for c in chunks:
                    at.append(row), found.append(c), body.append(b"\n".join(lines[c["i"] : c["j"]]))
            rows = pa.array(at, pa.int64())
            columns = [pa.array([c[k] for c in found], t) for k, t in (("i", pa.int32()), ("j", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("copies", pa.int32()), ("first", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("th").take(rows), *columns, pa.array(body, pa.binary())], ["doc_id", "th", "i", "j", "h1", "h2", "copies", "first", "body"])

    return docs.select("doc_id", "th", "text", "chunks").mapInArrow(run, f"doc_id {kind}, th long, i int, j int, h1 long, h2 long, copies int, first boolean, body binary")


def _without(docs: DataFrame, whole: bool) -> DataFrame:
    """docs: all columns, text and REMOVED (array of ranges of lines, or null). Drops those lines from text; whole: their
    passages()."""
    names, removed = docs.columns, REMOVED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            texts, gone = b.column("text"), b.column(removed).to_pylist()
            n = [0] * b.num_rows
            if any(gone):
                new = texts.to_pylist()
                for row, g in enumerate(gone):
                    ranges = [(c["i"], c["j"]) for c in g or ()]
                    lines = _split(new[row]) if ranges else []
                    for s, e in passages(lines, ranges) if whole else ranges:
                        lines[s:e] = [None] * (e - s)
                        n[row] += e - s
                    if n[row]:
                        new[row] = b"\n".join(x for x in lines if x is not None).decode("utf-8", "surrogatepass")
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([texts if c == "text" else b.column(c) for c in names if c != removed] + [pa.array(n, pa.int64())], [*(c for c in names if c != removed), "lines_removed"])

    schema = docs.drop(removed).withColumn("lines_removed", F.lit(0).cast("long")).schema
    return docs.mapInArrow(run, schema)


def dedup_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs: doc_id, text and any more columns. Returns all columns with repeated passages gone from text, and lines_removed."""
    return _dedup(spark, docs, passage_units, True)


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """As dedup_passages, but only whole chunks of two or more lines go."""
    return _dedup(spark, docs, chunk_units, False)


def _dedup(spark: SparkSession, docs: DataFrame, units: Callable[[list[bytes]], list[tuple[int, int]]], whole: bool, digest: Callable[[bytes], int] = xxhash.xxh3_128_intdigest) -> DataFrame:
    scratch = Scratch(spark, "linededup")
    docs = docs.drop("lines_removed")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    chunks = scratch.save(unit_table(hashed, units, digest), "chunks")
    place, salt = F.struct("doc_id", "th", "i"), F.pmod(F.xxhash64("doc_id", "th", "i"), F.col("copies")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    repeated = chunks.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keeper")).where("n > 1")
    repeated = scratch.save(repeated.withColumn("copies", F.ceil(F.col("n") / SHARE).cast("int")), "repeated")
    hot = repeated.where("copies > 1").select("h1", "h2", "copies")  # few, as each has many units
    dealt = looked_up(chunks, hot, ["h1", "h2"], 32, ["doc_id", "th", "i"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    found = dealt.withColumn("salt", salt).join(repeated.select("h1", "h2", "keeper", every.alias("salt")), ["h1", "h2", "salt"]).withColumn("first", place.eqNullSafe(F.col("keeper")))
    lists = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("i", "j", "h1", "h2", "copies", "first")).alias("chunks"))  # of one document
    lists = lists.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "chunks")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
    bodies = scratch.save(_bodies(hashed.where("text is not null").join(lists.hint("merge"), same)), "bodies")  # grows with the data: never broadcast
    keepers = bodies.where("first").dropDuplicates(["h1", "h2"])  # equal rows of one document have a first each
    keepers = keepers.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("body").alias("kept"), every.alias("k"))
    rows = bodies.where("not first").withColumn("salt", salt)
    equal = rows.join(keepers, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("salt") == F.col("k")) & (F.col("body") == F.col("kept")))
    removed = equal.groupBy(F.col("doc_id").alias(OWN[0]), F.col("th").alias(OWN[1])).agg(F.collect_set(F.struct("i", "j")).alias(REMOVED))
    removed = scratch.save(removed, "removed")
    scratch.keep("removed")
    marked = docs.withColumn(OWN[2], F.xxhash64("text")).join(removed.hint("merge"), F.col("doc_id").eqNullSafe(F.col(OWN[0])) & (F.col(OWN[2]) == F.col(OWN[1])), "left")
    return _without(marked.drop(*OWN), whole)
