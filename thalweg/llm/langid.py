"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order, grown from a bounded sample of labelled texts and then frozen.
A byte s after a context c of k bytes costs -log2(n(c,s) / (n(c) + d(c))) bits where c has been followed by s, else an
escape of -log2(d(c) / (n(c) + d(c))) bits and what s costs after the last k - 1 bytes of c (d: distinct successors); a
context that was never seen costs nothing; below order 0 every byte costs 8 bits. The code length of a text is the exact
sum over its bytes. As the statistics are frozen, that cost is a function of the last `order` bytes and s, so it is kept
in tables by n-gram, a column for each language, and looked up with numpy.

The sample of a language is its texts of smallest hash (of doc_id and text), each distinct text once, whole, within SAMPLE_DOCS
and SAMPLE_BYTES; texts of over an eighth of those bytes come last, and one text is kept in any case. The languages are a
set of labels that fits the driver, as their statistics do.

Cases: a null text, one without letters, or a model without languages gives `und` with score 0; ties go to the first
language in code point order; texts of any length are scored whole, in slices that carry their context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The sample that the statistics are learned from, for each language: so many documents and bytes at most.
SAMPLE_DOCS, SAMPLE_BYTES, ORDER = 600, 1_500_000, 3
SLICE = 1 << 18
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class _Table:
    """n-gram codes to rows, by open addressing; row 0 stands for what isn't there."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(len(codes) * 2 + 1))))
        self.keys, self.at, self.rows = np.full(1 << self.bits, -1, "int64"), np.zeros(1 << self.bits, "int32"), np.vstack([np.zeros((1, rows.shape[1]), "float32"), rows.astype("float32")])
        left, slot, self.probes = np.arange(len(codes)), self._slot(codes), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.at[slot[put]] = codes[left[put]], left[put] + 1
            keep = np.ones(len(left), bool)
            keep[put] = False
            left, slot = left[keep], (slot[keep] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype("int64")

    def find(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        row = np.where(self.keys[slot] == codes, self.at[slot], 0)
        for _ in range(self.probes - 1):
            miss = np.flatnonzero(row == 0)
            miss = miss[self.keys[slot[miss]] != -1]
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            row[miss] = np.where(self.keys[slot[miss]] == codes[miss], self.at[slot[miss]], 0)
        return row


class PPM:
    """Frozen statistics of some languages. `sample`: language to its texts as bytes."""

    def __init__(self, sample: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(sample), order
        counts = [[self._grams(texts, k) for k in range(order + 1)] for texts in (sample[x] for x in self.languages)]
        # grams of k + 1 bytes: bits for the last byte; contexts of k bytes: bits for an escape
        self.cost: list[_Table] = []
        self.escape: list[_Table] = []
        for k in range(order + 1):
            grams = np.unique(np.concatenate([c[k][0] for c in counts])) if counts else np.zeros(0, "int64")
            contexts = np.unique(grams >> 8)
            cost, escape = np.zeros((len(grams), len(counts))), np.zeros((len(contexts), len(counts)))
            for i, c in enumerate(counts):
                own, n = c[k]
                at = np.searchsorted(contexts, own >> 8)
                total, distinct = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float)
                seen = total > 0
                escape[seen, i] = np.log2((total[seen] + distinct[seen]) / distinct[seen])
                here = np.zeros(len(grams))
                here[np.searchsorted(grams, own)] = n
                at = np.searchsorted(contexts, grams >> 8)
                lower = self._lower(grams & ((1 << 8 * k) - 1), k - 1)[:, i] if len(grams) else np.zeros(0)
                with np.errstate(divide="ignore"):
                    cost[:, i] = np.where(here > 0, np.log2((total[at] + distinct[at]) / np.maximum(here, 1e-9)), escape[at, i] + lower)
            self.cost.append(_Table(grams, cost))
            self.escape.append(_Table(contexts, escape))

    @staticmethod
    def _grams(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [_codes(np.frombuffer(t, "uint8"), k) for t in texts if len(t) > k]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, "int64"), np.zeros(0, "int64"))

    def _lower(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of grams of k + 1 bytes, a column for each language."""
        if k < 0:
            return np.full((len(codes), len(self.languages)), 8.0, "float32")
        row = self.cost[k].find(codes)
        out = self.cost[k].rows[row]
        if len(miss := np.flatnonzero(row == 0)):
            out[miss] = self.escape[k].rows[self.escape[k].find(codes[miss] >> 8)] + self._lower(codes[miss] & ((1 << 8 * k) - 1), k - 1)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: a row for each text, a column for each language."""
        out = np.zeros((len(texts), len(self.languages)))
        batch: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            for s in range(0, len(t), SLICE) if len(t) > SLICE else ():
                out[i] += self._text_bits([t[max(0, s - self.order) : s + SLICE]], [min(s, self.order)])[0]
            if len(t) <= SLICE:
                batch.append(i)
                size += len(t)
            if size >= SLICE or i == len(texts) - 1:
                out[batch] = self._text_bits([texts[j] for j in batch], [0] * len(batch))
                batch, size = [], 0
        return out

    def _text_bits(self, texts: list[bytes], skip: list[int]) -> np.ndarray:
        """As bits(), without the first skip[i] bytes, which are only context."""
        length = np.array([len(t) for t in texts], "int64")
        x = np.frombuffer(b"".join(texts), "uint8")
        if not len(x):
            return np.zeros((len(texts), len(self.languages)))
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        at = np.arange(len(x)) - np.repeat(begin, length)
        codes = _codes(np.concatenate([np.zeros(self.order, "uint8"), x]), self.order)
        bits = np.empty((len(x), len(self.languages)), "float32")
        deep = at >= self.order
        bits[deep] = self._lower(codes[deep], self.order)
        for k in range(self.order):  # the first bytes have shorter contexts
            here = at == k
            bits[here] = self._lower(codes[here] & ((1 << 8 * (k + 1)) - 1), k)
        bits[at < np.repeat(np.array(skip, "int64"), length)] = 0
        full = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(length)
        for i in range(len(self.languages)):
            full[some, i] = np.add.reduceat(bits[:, i], begin[some], dtype="float64")
        return full


def _codes(x: np.ndarray, k: int) -> np.ndarray:
    """The grams of k + 1 bytes in x as integers."""
    n = len(x) - k
    out = np.zeros(n, "int64")
    for i in range(k + 1):
        out = (out << 8) | x[i : i + n]
    return out


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """The texts to learn from, by language, of the rows that aren't held out. It is all that comes to the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    # twice the share that is wanted is drawn by the hash, so that few rows are ranked
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * sample_docs / n))])
    size = F.octet_length("text").cast("long")
    drawn = known.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.element_at(rate, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = W.partitionBy("lang").orderBy(size > sample_bytes // 8, "h")  # twice sample_docs rows or so
    ranked = drawn.withColumn("place", F.row_number().over(order)).withColumn("sofar", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out: dict[str, list[bytes]] = {}
    for r in ranked.where(((F.col("place") <= sample_docs) & (F.col("sofar") <= sample_bytes)) | (F.col("place") == 1)).orderBy("lang", "place").select("lang", "text").toLocalIterator():
        out.setdefault(r.lang, []).append(r.text.encode("utf-8", "surrogatepass"))
    return out


def train(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> PPM:
    """Learns from text and lang of the rows that aren't held out."""
    return PPM(sample(docs, sample_docs, sample_bytes), order)


def identify(spark: SparkSession, docs: DataFrame, model: PPM) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, lang_pred, score, bits_per_byte (under the language chosen) for every row.

    score is the posterior of the language chosen, tempered by the square root of the length: 1 is certain."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample it was learned from
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm: PPM = shared.value
        names = np.array([*ppm.languages, UNDETERMINED], object)
        for b in batches:
            texts = b.column("text").to_pylist()
            fine = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            raw = [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, fine, strict=True)]
            length = np.maximum(1, np.array([len(t) for t in raw], "int64"))
            pick, score, best = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts))
            if len(names) > 1 and len(texts):
                bits = ppm.bits(raw)
                pick = np.where(fine, bits.argmin(1), pick)
                best = np.where(fine, bits.min(1), 0)
                score = np.where(fine, 1 / np.exp2(-(bits - bits.min(1, keepdims=True)) / np.sqrt(length)[:, None]).sum(1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[pick].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(best / length, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: Bits a byte above the median of a language from which a text isn't prose of it: the least such margin, so many median
#: deviations, and an allowance for short texts, over the square root of their bytes.
MARGIN, DEVIATIONS, SHORT = 0.8, 12.0, 8.0


def limits(model: PPM, held: dict[str, list[bytes]], margin: float = MARGIN) -> np.ndarray:
    """For each language of a model the bits a byte that prose of it takes at most, from texts that the model has not seen:
    their median and the margin. A language without such texts takes no more than 8 bits."""
    out = np.full(len(model.languages), 8.0)
    for i, name in enumerate(model.languages):
        texts = [t for t in held.get(name, []) if t]
        if texts:
            rate = model.bits(texts)[:, i] / np.array([len(t) for t in texts])
            middle = np.median(rate)
            out[i] = middle + max(margin, DEVIATIONS * float(np.median(np.abs(rate - middle))))
    return out


def accepted(spark: SparkSession, docs: DataFrame, labelled: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: letters, and a code length that fits the language of the
    least one. labelled: doc_id, text, lang; four in five texts of its sample make the statistics, one in five the limits.
    Without any labels every text with letters is accepted."""
    drawn = sample(labelled)
    held = {k: v[4::5] for k, v in drawn.items()}
    model = PPM({k: [t for i, t in enumerate(v) if i % 5 != 4] for k, v in drawn.items()})
    shared = spark.sparkContext.broadcast((model, limits(model, held, margin)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm, most = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            raw = [t.encode("utf-8", "surrogatepass") if t is not None and any(map(str.isalpha, t)) else b"" for t in texts]
            keep = np.array([bool(t) for t in raw], bool)
            if len(texts) and ppm.languages:
                bits, size = ppm.bits(raw), np.maximum(1, [len(t) for t in raw])
                pick = bits.argmin(1)
                keep &= bits[np.arange(len(raw)), pick] <= most[pick] * size + SHORT * np.sqrt(size)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
