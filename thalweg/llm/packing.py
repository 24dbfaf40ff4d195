"""Best-fit packing of documents into sequences, by patterns fitted with non-negative least squares.

The lengths of all pieces make a histogram. A pattern is a set of up to PARTS lengths that fill a sequence to the last token.
Patterns are enumerated where the fit lacks them: those of two lengths first, then, over and over, for each length the
pattern that holds it and covers most of what the fit leaves of the histogram, found by a knapsack over that residual. The
repeat counts of all patterns are fitted to the histogram by non-negative least squares and rounded; what rounding leaves
is fitted again. The rest, and pieces of up to `held` tokens that fill gaps well, are packed best-fit, longest first, into
the space that is left and into new sequences. Of several settings (TRIES) the one of fewest sequences is taken; a setting
that meets the lower bound, all tokens over the capacity, ends the search. All of this works on counts by length, so the
driver's work is bounded by the capacity, not by the documents. Documents get their places by their rank within their
length, which is a two-level prefix sum over buckets; rows that are equal are dealt over buckets by their place in the table.

Cases: null and empty texts hold the end id alone; only documents longer than a sequence are cut, the first piece being
the shorter one; an empty table gives an empty result; repeated rows and null ids are packed as often as they occur; other
columns are left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, number_among_equals, slices
from .tokens import Encoder

CAPACITY = 2048
#: Lengths of a pattern at most, and pieces of up to so many tokens that are held back for the gaps.
TRIES = ((4, 64), (4, 256), (3, 128), (6, 0))
ROWS_PER_BUCKET = 50_000
#: Equal pieces that go to one bucket together.
EQUALS = 1_000
#: Rows that a worker takes from a batch together.
SLICE = 1_000


def pieces(docs: DataFrame, path: str, kind: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: what a document is cut into."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = Encoder.of(path, kind), np.array([end], "<u4")
        for b in slices(batches, SLICE):
            at, piece, start, length, crc = [], [], [], [], []
            for i, x in encoder.encode(b.column("text").to_pylist()):
                own = np.concatenate([x.astype("<u4"), stop])
                begin, stop_at = 0, len(own) - (-(-len(own) // capacity) - 1) * capacity
                for k in range(-(-len(own) // capacity)):
                    at.append(i), piece.append(k), start.append(begin), length.append(stop_at - begin)
                    crc.append(zlib.crc32(own[begin:stop_at].tobytes()))
                    begin, stop_at = stop_at, stop_at + capacity
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, piece int, start long, length long, ids_crc32 long")


class _Patterns:
    """Patterns as columns of a matrix of counts by length; zeros fill the rows up."""

    def __init__(self, rows: list[tuple[int, ...]], lengths: int, parts: int):
        self.at = np.array([r + (0,) * (parts - len(r)) for r in rows], "int64").reshape(-1, parts)
        self.shape = (lengths, len(rows))

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.bincount(self.at.ravel(), np.repeat(x, self.at.shape[1]), self.shape[0])
        out[0] = 0
        return out

    @property
    def T(self) -> _Transposed:
        return _Transposed(self.at)


class _Transposed:
    def __init__(self, at: np.ndarray):
        self.at = at

    def __matmul__(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([[0.0], r[1:]])[self.at].sum(1)


def nnls(a, b: np.ndarray, x: np.ndarray | None = None, rounds: int = 200) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by projected gradients with momentum, from a start x. a: all that has @ and T."""
    x = np.zeros(a.shape[1]) if x is None else x
    v = np.ones(a.shape[1]) / np.sqrt(max(1, a.shape[1]))
    for _ in range(30):  # the largest eigenvalue of a' a bounds the step
        v = a.T @ (a @ v)
        norm = np.linalg.norm(v)
        v = v / max(norm, 1e-300)
    step, ahead, k = 1 / max(1.02 * norm, 1e-300), x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, ahead + step * (a.T @ (b - a @ ahead)))
        after = (1 + np.sqrt(1 + 4 * k * k)) / 2
        onward = new + (k - 1) / after * (new - x)
        if (ahead - new) @ (new - x) > 0:  # the momentum leads uphill
            onward, after = new, 1.0
        if np.abs(new - x).max(initial=0) < 1e-6:
            return new
        x, ahead, k = new, onward, after
    return x


def _priced(residual: np.ndarray, lengths: np.ndarray, capacity: int, parts: int) -> list[tuple[int, ...]]:
    """For each length the full pattern that holds it and has the largest sum of residuals, if that is above zero."""
    best = np.full((parts, capacity + 1), -np.inf)
    pick = np.zeros((parts, capacity + 1), "int64")
    best[0, 0] = 0
    for m in range(1, parts):
        for length in lengths.tolist():
            value = best[m - 1, : capacity + 1 - length] + residual[length]
            better = np.flatnonzero(value > best[m, length:])
            best[m, length + better], pick[m, length + better] = value[better], length
    out = []
    for length in lengths.tolist():
        space = capacity - length
        m = 1 + int(best[1:, space].argmax()) if parts > 1 else 0
        if m and residual[length] + best[m, space] > 1e-3:
            held = [length]
            for k in range(m, 0, -1):
                held.append(int(pick[k, space]))
                space -= held[-1]
            out.append(tuple(sorted(held, reverse=True)))
    return out


def fit_patterns(count: np.ndarray, parts: int, rounds: int = 4) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """count: pieces by length, 0 to the capacity. Patterns and how often each is repeated by the least squares."""
    capacity = len(count) - 1
    lengths = np.flatnonzero(count)
    there = set(lengths.tolist())
    known = dict.fromkeys((n, capacity - n) for n in lengths.tolist() if 2 * n >= capacity and capacity - n in there)
    x, residual = np.zeros(0), count.astype(float)
    for k in range(rounds + 1):
        if k:
            before = len(known)
            known |= dict.fromkeys(_priced(residual, lengths, capacity, parts))
            if len(known) == before:
                break
        if known:
            a = _Patterns(list(known), capacity + 1, max(parts, 2))
            x = nnls(a, count.astype(float), np.concatenate([x, np.zeros(len(known) - len(x))]))
            residual = count - a @ x
    return list(known), x


def _best_fit(count: np.ndarray, groups: dict[int, list[tuple[tuple[int, ...], int]]]) -> None:
    """Packs what is counted, longest first, into the least space that holds it or into new sequences; groups: by space."""
    capacity = len(count) - 1
    there = np.zeros(capacity + 1, bool)
    there[[s for s, g in groups.items() if g]] = True
    for length in np.flatnonzero(count)[::-1].tolist():
        c = int(count[length])
        while c:
            fit = length + int(there[length:].argmax())
            if not there[fit]:
                per = capacity // length
                for many, n in ((per, c // per), (c % per, 1)):
                    if many and n:
                        groups[capacity - many * length].append(((length,) * many, n))
                        there[capacity - many * length] = True
                break
            held, n = groups[fit].pop()
            m = min(n, c)
            if n > m:
                groups[fit].append((held, n - m))
            there[fit] = bool(groups[fit])
            groups[fit - length].append(((*held, length), m))
            there[fit - length] = True
            c -= m


def plan(histogram: dict[int, int], capacity: int = CAPACITY, tries: tuple[tuple[int, int], ...] = TRIES) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """histogram: length to count. Returns (lengths of a sequence, how many such sequences), and how many pieces the fitted
    patterns hold."""
    best, fewest = ([], 0), None
    bound = -(-sum(length * n for length, n in histogram.items()) // capacity)
    for parts, held_back in tries:
        count = np.zeros(capacity + 1, "int64")
        count[list(histogram)] = list(histogram.values())
        groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        if count[capacity]:
            groups[0].append(((capacity,), int(count[capacity])))
        small = np.where(np.arange(capacity + 1) <= held_back, count, 0)
        count[capacity], count[: held_back + 1], fitted = 0, 0, 0
        while count.any():
            patterns, repeat = fit_patterns(count, parts)
            taken = 0
            for j in np.argsort(-repeat, kind="stable").tolist():
                if repeat[j] < 0.25:
                    break
                p = patterns[j]
                n = min(max(1, int(repeat[j] + 0.5)), *(int(count[k]) // p.count(k) for k in p))
                if n > 0:
                    np.subtract.at(count, list(p), n)
                    groups[0].append((p, n))
                    taken += n * len(p)
            fitted += taken
            if taken * 50 <= count.sum():  # little is left that patterns can take
                break
        _best_fit(count + small, groups)
        found = [(held, n) for s in sorted(groups) for held, n in groups[s]]
        sequences = sum(n for _, n in found)
        if fewest is None or sequences < fewest:
            best, fewest = (found, fitted), sequences
        if fewest <= bound + bound // 100_000:
            break
    return best


def places(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (length and first rank of a run), the first sequence of each run and the offset in it."""
    used: dict[int, int] = defaultdict(int)
    keys, sequence, offset, base = [], [], [], 0
    for held, n in groups:
        at = 0
        for length in held:
            keys.append((length << 44) + used[length]), sequence.append(base), offset.append(at)
            used[length] += n
            at += length
        base += n
    order = np.argsort(np.array(keys, "int64"), kind="stable")
    return tuple(np.array(x, "int64")[order] for x in (keys, sequence, offset))


def pack(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut: as from pieces(). Adds sequence_id and offset."""
    scratch = Scratch(spark, "packing")
    cut = scratch.save(cut, "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # `capacity` rows at most
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity)[0]))  # by length and group, not by document
    buckets = max(1, -(-sum(histogram.values()) // ROWS_PER_BUCKET))
    # pieces go where their content says; many equal ones are told apart by a number, so that they go to several buckets
    cut = number_among_equals(cut, ["doc_id", "piece", "ids_crc32"], "k") if buckets > 1 else cut.withColumn("k", F.lit(0))
    place = F.xxhash64("doc_id", "piece", "ids_crc32", F.floor(F.col("k") / EQUALS))
    dealt = scratch.save(cut.withColumn("bucket", F.pmod(place, F.lit(buckets)).cast("int")).drop("k"), "dealt")
    counts = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("rows"))
    earlier = F.sum("rows").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("bucket", "length", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    within = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = dealt.withColumn("rank", within).join(counts, ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("earlier")).alias("rank"))
    id_kind = cut.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, offset = shared.value
        for b in batches:
            key = (b.column("length").to_numpy() << 44) + b.column("rank").to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[at] + key - keys[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {id_kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
