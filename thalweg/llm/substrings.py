"""Removing repeated substrings: passages of WINDOW words or more that occur in a document of a smaller id.

Seed: of the runs of SEED words in each window, the one of least hash is its anchor (the first of those on ties), so equal windows have
equal anchors at the same place. Neighbouring windows mostly share one, so there is an anchor for about five words.

Extend: an anchor is extended both ways over all windows that it stands for, and the extension gets a digest. Anchors meet
by hash. Of those with equal extensions, the one in the smallest document keeps its words, and all windows of the others are
repeats as a whole. Where one anchor has several extensions, those keepers (one for each extension, and no other) are
extended window by window: their windows meet by digest, and again those of all but the smallest document are repeats.
Windows that overlap or touch make up maximal repeats, which go.

Nothing is compared in pairs. Rows meet in a sorted stream, of which a task holds a batch. Before each shuffle, a worker
settles what repeats within its own slice of documents, so that of a passage that a third of all documents hold only a row
for each slice travels to where it meets.

Words are compared by 64-bit hashes, and windows by 128 bits made of them. Cases: words are runs of anything but ASCII white
space, unchanged; null and empty texts have none; documents of fewer words than a window lose nothing; rows of equal
doc_id are not smaller than each other, so they don't remove each other's words; a null doc_id counts as the smallest
(as -2^63); what a document repeats within itself stays; columns text, n_words, n_removed and removed of the input are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .shingles import mix64, word_hashes

#: Words of a window, and of an anchor.
WINDOW, SEED = 13, 5
#: Bytes of text that a worker looks at together.
CHUNK = 8 << 20
#: Names of columns that this operator adds for a while, beside any that documents may have.
OWN = ("__substrings_doc", "__substrings_hash", "__substrings_ranges")
_NULL = -(2**63)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_ROW = "k long, c long, doc long, th long, s int, e int, sure boolean"


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(2 * n, b, "uint64")
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = out[0], out[1]
    return _POWERS[base]


def digests(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each range of words, which does not depend on its place."""
    power, inverse = _powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, "uint64")
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype("uint64"))


def anchors(words: np.ndarray, ends: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words of texts in a row, and where each text ends. For each anchor its hash, its first window and its last one."""
    n = len(words)
    if n < window:
        return np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "int64")
    runs = np.arange(n - seed + 1)
    gram = digests(words, runs, runs + seed, _BASES[0])
    count = n - window + 1
    best, at = gram[:count].copy(), np.zeros(count, "int64")
    for j in range(1, window - seed + 1):
        less = gram[j : j + count] < best
        best[less], at[less] = gram[j : j + count][less], j
    first = np.arange(count)
    inside = first + window <= ends[np.searchsorted(ends, first, "right")]
    at += first
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
    low, high = np.flatnonzero(opens), np.flatnonzero(closes)
    return best[low], low, high


def _united(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document, joined where they overlap or touch."""
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order].astype("int64"), e[order].astype("int64")
    if not len(doc):
        return doc, s, e
    new = np.diff(doc, prepend=doc[0] - 1) != 0
    shift = (np.cumsum(new) - 1) * (int(e.max()) + 2)  # one line for all documents
    reach = np.maximum.accumulate(e + shift)
    opens = np.ones(len(doc), bool)
    opens[1:] = (s + shift)[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], s[first], reach[last] - shift[first]


def _least(k: np.ndarray, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc among the rows of equal k and c, for each row."""
    order = np.lexsort((doc, c, k))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(k[order]) != 0) | (np.diff(c[order]) != 0)
    out = np.empty(len(order), "int64")
    out[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _batch(columns: list[tuple[np.ndarray, str]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in columns], names)


def _met(row: np.ndarray, doc: np.ndarray, th: np.ndarray, k: np.ndarray, c: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """What a slice sends: a row for each of its anchors or windows, but for those that repeat one in a smaller document of
    the slice, which are settled (sure) and sent as ranges, dealt by document. row: the document's place in the slice."""
    k, c = k.view("int64"), c.view("int64")
    sure = doc[row] > _least(k, c, doc[row])
    r, low, high = _united(row[sure], s[sure], e[sure])
    rest = ~sure
    spread = mix64(doc[r].view("uint64") + np.uint64(1)).view("int64")
    join = lambda x, y: np.concatenate([x, y])
    at = join(row[rest], r)
    columns = [(join(k[rest], spread), "int64"), (join(c[rest], np.zeros(len(r), "int64")), "int64"), (doc[at], "int64"), (th[at], "int64"), (join(s[rest], low), "int32"), (join(e[rest], high), "int32"), (join(np.zeros(int(rest.sum()), bool), np.ones(len(r), bool)), "bool")]
    return _batch(columns, ["k", "c", "doc", "th", "s", "e", "sure"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time, with the hashes of their words in a row, and where those of each text end."""
    for b in batches:
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in b.column("text").to_pylist()]
        size = np.cumsum([len(t) for t in texts])
        part = size // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                words = [*word_hashes(texts[i:j], fold=False)]
                yield b.slice(i, j - i), np.concatenate(words), np.cumsum([len(w) for w in words])


def _numbers(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("doc").to_numpy(), b.column("th").to_numpy()


def seeds(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """rows: doc, th, text. A row for each anchor: its hash, the digest of its extension, and the words s to e - 1 it spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words, ends in _slices(batches):
            h, low, high = anchors(words, ends, window, seed)
            row = np.searchsorted(ends, low, "right")
            begin = (ends - np.diff(ends, prepend=0))[row]
            yield _met(row, *_numbers(b), h, digests(words, low, high + window, _BASES[1]), low - begin, high + window - begin)

    return rows.select("doc", "th", "text").mapInArrow(run, _ROW)


def windows(rows: DataFrame, window: int) -> DataFrame:
    """rows: doc, th, text, and spans (array of s, e). A row for each window in the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words, ends in _slices(batches):
            spans = b.column("spans")
            n = pa.compute.list_value_length(spans).to_numpy()
            flat = spans.flatten()
            s, e = (flat.field(i).to_numpy().astype("int64") for i in (0, 1))
            row = np.repeat(np.arange(b.num_rows), n)
            many = e - window + 1 - s
            row, first = np.repeat(row, many), np.arange(int(many.sum())) + np.repeat(s - (np.cumsum(many) - many), many)
            begin = (ends - np.diff(ends, prepend=0))[row]
            k, c = (digests(words, begin + first, begin + first + window, base) for base in _BASES)
            yield _met(row, *_numbers(b), k, c, first, first + window)

    return rows.select("doc", "th", "text", "spans").mapInArrow(run, _ROW)


def settle(rows: DataFrame, keepers: bool) -> DataFrame:
    """rows as of seeds() or windows(). Returns doc, th, s, e, sure: the ranges of those that repeat one in a smaller document
    (sure); and, if keepers, those of the smallest document for each digest, where their k has several (not sure)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "th", "s", "e"]
        last: tuple[int, int, int] | None = None  # k, c and the smallest doc of the group that may go on
        several = False
        held: list[list[np.ndarray]] = []  # keepers of the last k, of which one digest is known so far
        for b in batches:
            done = b.column("sure").to_numpy(zero_copy_only=False)
            whole = [b.column(c).to_numpy() for c in names]
            k, c, *rest = (b.column(x).to_numpy()[~done] for x in ("k", "c", *names))
            if not len(k):
                yield _batch([(x[done], str(x.dtype)) for x in whole] + [(done[done], "bool")], [*names, "sure"])
                continue
            before = last or (k[0] ^ 1, 0, 0)
            new_k = np.diff(k, prepend=before[0]) != 0
            new_c = new_k | (np.diff(c, prepend=before[1]) != 0)
            group = np.cumsum(new_c)  # 0: the group goes on
            least = np.concatenate([[before[2]], rest[0][new_c]])[group]
            again = rest[0] > least
            out = [[x[done] for x in whole], [x[again] for x in rest]]
            flags = [np.ones(int(done.sum() + again.sum()), bool)]
            if keepers:
                run_of = np.cumsum(new_k)
                digests_of = np.bincount(run_of[new_c], minlength=run_of[-1] + 1)
                digests_of[0] += (2 if several else 1) if not new_k[0] else 0
                many = digests_of > 1
                if held and not new_k[0] and many[0]:
                    out += held
                    flags += [np.zeros(len(x[0]), bool) for x in held]
                    held = []
                found = ~again & many[run_of]
                out.append([x[found] for x in rest])
                flags.append(np.zeros(int(found.sum()), bool))
                if run_of[-1] or new_k[0]:
                    held = []
                several = bool(many[-1])
                if not several:
                    mine = ~again & (run_of == run_of[-1])
                    held.append([x[mine] for x in rest])
            last = int(k[-1]), int(c[-1]), int(least[-1])
            yield _batch([(np.concatenate([o[i] for o in out]), t) for i, t in enumerate(("int64", "int64", "int32", "int32"))] + [(np.concatenate(flags), "bool")], [*names, "sure"])

    ordered = rows.repartition("k").sortWithinPartitions("k", "c", "doc", "th", "s")
    return ordered.mapInArrow(run, "doc long, th long, s int, e int, sure boolean")


def _listed(ranges: DataFrame) -> DataFrame:
    """The ranges of each document, in their order."""
    return ranges.groupBy(F.col("doc").alias(OWN[0]), F.col("th").alias(OWN[1])).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias(OWN[2]))  # of one document


def repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[Scratch, DataFrame, DataFrame]:
    """The rows of docs with doc and th, which tell documents apart, and the ranges of their words that repeat ones of smaller
    documents: doc, th, s, e."""
    scratch = Scratch(spark, "substrings")
    same_ids = docs.groupBy("doc_id").count().where("count > 1").take(1)
    told = F.xxhash64("text") if same_ids else F.lit(0).cast("long")
    rows = docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)), "th": told})
    found = scratch.save(settle(seeds(rows, window, seed), True), "seeds")
    spans = _listed(found.where("not sure"))
    near = rows.select("doc", "th", "text").join(spans.hint("merge"), (F.col("doc") == F.col(OWN[0])) & (F.col("th") == F.col(OWN[1])))
    more = scratch.save(settle(windows(near.withColumnRenamed(OWN[2], "spans"), window), False), "windows")
    return scratch, rows, found.where("sure").drop("sure").union(more.drop("sure"))


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text and any more columns. Returns all columns, text being the words that stay, joined by one blank ('' for
    null), n_words, n_removed, and removed: the maximal repeats as an array of s, e (words s to e - 1 of the input)."""
    docs = docs.drop("n_words", "n_removed", "removed")
    inner = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    scratch, rows, ranges = repeats(spark, inner, window, seed)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                own = part.column("__row")
                texts, n, gone, cuts = [], [], [], []
                for t, listed in zip(part.column("text").to_pylist(), part.column(OWN[2]).to_pylist(), strict=True):
                    words = (t or "").encode("utf-8", "surrogatepass").split()  # at ASCII white space
                    n.append(len(words))
                    joined: list[list[int]] = []
                    for x in listed or ():
                        if joined and x["s"] <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], x["e"])
                        else:
                            joined.append([x["s"], x["e"]])
                    for s, e in reversed(joined):
                        del words[s:e]
                    texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                    gone.append(n[-1] - len(words))
                    cuts.append([{"s": s, "e": e} for s, e in joined])
                span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                fields = [own.field(own.type.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*fields, pa.array(texts, part.schema.field("text").type), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, span)], [*kept, "text", "n_words", "n_removed", "removed"])

    lists = _listed(ranges)
    marked = rows.join(lists.hint("merge"), (F.col("doc") == F.col(OWN[0])) & (F.col("th") == F.col(OWN[1])), "left")
    schema = docs.select(*kept, "text").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.expr("array(named_struct('s', 0, 'e', 0))")}).schema
    out = marked.select("__row", "text", OWN[2]).mapInArrow(run, schema)
    return out.select(*docs.columns, "n_words", "n_removed", "removed")
