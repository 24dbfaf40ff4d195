"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each, mean and deviation are kept. The inner product of two vectors is at most the sum
over segments of length * (mean * mean + deviation * deviation), as the parts about the means are bounded by Cauchy and
Schwarz; this is the lower bound of the Euclidean distance written for the score. Bounds are made coarse to fine, and a pair
of query and row that a level rules out goes to no finer one. What is left is scored in exact integers: pair by pair where it
is little, else as a product of the rows and queries that have such pairs.

A query's threshold, the score that its k-th best has at least, is set once from SEEDS rows of smallest hash, and rises as a
task goes on. Rows are packed into blocks of BLOCK vectors that stay where they are. Queries come to them in groups of GROUP
by broadcasts of bounded size, a pass over the blocks for each group; a task gives back k rows for each query at most.

Cases: vectors that are null, empty or hold a null or non-finite component, or a null vec_id, take no part; only vectors of
the same length are compared; ties go to the smaller vec_id; repeated rows count each, but no row of the query's own vec_id;
components that don't fit exact doubles after scaling are scored in Python integers; an empty table gives no rows; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

BLOCK, STEP, LEVELS = 4096, 1024, (4, 16, 32)
#: Queries of a pass, and their components; rows that set the first thresholds.
GROUP, GROUP_VALUES, SEEDS = 8192, 4_000_000, 1024
#: Share of pairs from which on a block is scored as a product.
DENSE = 0.06
NONE = np.iinfo("int64").min


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows: id, x. Packs them: dim, ids (int64 bytes), xs (float64 bytes), n; at most `size` vectors in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(d: int) -> pa.RecordBatch:
            own = held.pop(d)
            ids = np.array([i for i, _ in own], "<i8")
            x = np.floor(256.0 * np.array([v for _, v in own], "float64"))
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([len(own)], pa.int32())], ["dim", "ids", "xs", "n"])

        for b in batches:
            lists = b.column("x")
            for i, v in zip(b.column("id").to_pylist(), lists, strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield row(len(v))
        for d in list(held):
            yield row(d)

    return rows.mapInArrow(run, "dim int, ids binary, xs binary, n int")


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Vectors whose inner products bound those of the rows of x from above."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    out = []
    for p in parts:
        s = x[:, p]
        out += [s.mean(1) * np.sqrt(len(p)), s.std(1) * np.sqrt(len(p))]
    return np.stack(out, 1)


def _large(q: np.ndarray, x: np.ndarray) -> bool:
    return bool(len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= 2.0**53)


def _integers(q: np.ndarray, x: np.ndarray) -> list[int]:
    return [min(max(sum(int(a) * int(b) for a, b in zip(r, s, strict=True)), NONE + 1), 2**63 - 1) for r, s in zip(q, x, strict=True)]


class Queries:
    """A group of queries of one dimension, with the best rows found so far and the scores that more of them must reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS):
        self.ids, self.x, self.k, self.levels = ids, x, k, tuple(s for s in levels if s < x.shape[1])
        self.statistics = [statistics(x, s) for s in self.levels]
        self.floor = np.full(len(ids), NONE)
        self.top, self.best = np.full((len(ids), k), NONE), np.full((len(ids), k), -1, "int64")
        self.met = self.scored = 0

    def seed(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Thresholds from the exact scores of some rows, which are met again with all others."""
        if len(x) and not _large(self.x, x):
            score = (self.x @ x.T).astype("int64")
            score[self.ids[:, None] == ids[None, :]] = NONE
            if len(ids) >= self.k:
                self.floor = np.maximum(self.floor, np.partition(score, len(ids) - self.k, 1)[:, len(ids) - self.k])

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")  # long vectors first: they raise the k-th score soonest
        for s in range(0, len(x), STEP):
            self._meet(ids[order[s : s + STEP]], x[order[s : s + STEP]])

    def _meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        slack = 1e-9 * (1 + float(np.abs(self.x).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1])
        need = np.maximum(self.floor, self.top[:, -1])
        self.met += len(self.ids) * len(ids)
        i, j = None, None  # all pairs, until a level leaves few of them
        for own, segments in zip(self.statistics, self.levels, strict=True):
            theirs = statistics(x, segments)
            if i is None:
                could = own @ theirs.T + slack >= need[:, None]
                if could.mean() < DENSE:
                    i, j = np.nonzero(could)
                elif segments == self.levels[-1]:
                    rows, columns = np.flatnonzero(could.any(1)), np.flatnonzero(could.any(0))
                    i, j = (a.ravel() for a in np.meshgrid(rows, columns, indexing="ij")) if _large(self.x, x) else (None, None)
                    if i is None:
                        self.scored += int(could.sum())
                        score = (self.x[rows] @ x[columns].T).astype("int64")
                        score[self.ids[rows][:, None] == ids[columns][None, :]] = NONE
                        a, b = np.nonzero((score >= need[rows][:, None]) & (score > NONE))
                        return self._keep(rows[a], ids[columns[b]], score[a, b])
            elif len(i):
                left = np.einsum("ij,ij->i", own[i], theirs[j]) + slack >= need[i]
                i, j = i[left], j[left]
        if i is None:
            i, j = (a.ravel() for a in np.meshgrid(np.arange(len(self.ids)), np.arange(len(ids)), indexing="ij"))
        self.scored += len(i)
        large = _large(self.x, x)
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            score = np.array(_integers(self.x[a], x[b]), "int64") if large else np.einsum("ij,ij->i", self.x[a], x[b]).astype("int64")
            good = (score >= need[a]) & (self.ids[a] != ids[b])
            self._keep(a[good], ids[b[good]], score[good])

    def _keep(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merges pairs into the k best of each query."""
        some = np.unique(rows)
        held = self.top[some] > NONE
        rows = np.concatenate([np.repeat(some, held.sum(1)), rows])
        ids, score = np.concatenate([self.best[some][held], ids]), np.concatenate([self.top[some][held], score])
        order = np.lexsort((ids, ~score, rows))  # ~ turns the order of integers round
        rows, ids, score = rows[order], ids[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        few = place < self.k
        self.top[some], self.best[some] = NONE, -1
        self.top[rows[few], place[few]], self.best[rows[few], place[few]] = score[few], ids[few]


def top_k(spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """rows: key, vector. Returns query_id, rank, vec_id, score: for each query row its k best others."""
    scratch = Scratch(spark, "topk")
    fit = rows.where(usable(F.col(vector)) & F.col(key).isNotNull())
    pick = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    blocks = scratch.save(_blocks(pick(fit), BLOCK), "rows")
    queries = scratch.save(_blocks(pick(fit.where(is_query)), STEP), "queries")
    drawn = pick(fit).withColumn("d", F.size("x")).withColumn("h", F.xxhash64("id", "x"))
    dims = [r.dim for r in queries.select("dim").distinct().collect()]
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for d in sorted(dims):
        per = max(1, min(GROUP, GROUP_VALUES // d) // STEP)
        seeds = drawn.where(F.col("d") == d).orderBy("h", "id").limit(min(SEEDS, max(k + 1, GROUP_VALUES // d))).collect()
        seed = np.array([r.id for r in seeds], "int64"), np.floor(256.0 * np.array([r.x for r in seeds], "float64"))
        # blocks of queries come one by one, and are sent on in groups of bounded size
        group: list[tuple[np.ndarray, np.ndarray]] = []
        own = queries.where(F.col("dim") == d)
        for i, r in enumerate([*own.toLocalIterator(), None]):
            if r is not None:
                group.append((np.frombuffer(bytes(r["ids"]), "<i8"), np.frombuffer(bytes(r["xs"]), "<f8").reshape(-1, d)))
            if group and (r is None or len(group) == per):
                shared = spark.sparkContext.broadcast((np.concatenate([a for a, _ in group]), np.concatenate([b for _, b in group]), seed))
                found = scratch.add(_pass(blocks.where(F.col("dim") == d), shared, d, k), "found")
                shared.destroy()
                group = []
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = scratch.save(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "out")
    scratch.drop("rows", "queries", "found")
    return out


def _pass(blocks: DataFrame, shared, d: int, k: int) -> DataFrame:
    """The k best rows of each task's blocks for all queries of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, seed = shared.value
        queries = Queries(ids, x, k)
        queries.seed(*seed)
        for b in batches:
            for i, v in zip(b.column("ids").to_pylist(), b.column("xs").to_pylist(), strict=True):
                queries.meet(np.frombuffer(i, "<i8"), np.frombuffer(v, "<f8").reshape(-1, d))
        some = queries.top > NONE
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[some.ravel()]), pa.array(queries.best[some]), pa.array(queries.top[some])], ["query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "query_id long, vec_id long, score long")
