"""Aligning the tokens of two tokenizers: byte-level BPE (A, over a blank and the text) and sentencepiece BPE (B, over the text).

Tokens of A and B that share bytes are linked. Union-find over those links gives components, which are exactly the smallest
groups of tokens that cover the same bytes. A pair of ids counts as often as it is linked in the whole corpus.

Texts are parted into units, at places where no token of either vocabulary can cross: before a blank or a line end that
follows a solid character, and before ASCII punctuation after an ASCII letter (where no piece of B has the two side by side,
which is looked up in its vocabulary). Ids, groups and links of a text are those of its units in a row, so that a worker
works each unit out once, and keeps at most KEEP units or TOKENS tokens, a bound on memory that changes no result. Texts with white
space beyond ASCII are a unit by themselves.

Pairs are counted in two steps: units are counted in a task, their links spread out to pairs at its end, and pairs added up by
a shuffle. For what each document's links add up to, workers read the table of pairs where it has at most PAIRS rows (16
bytes each); beyond, each document's distinct pairs are joined with it, by `looked_up`, as a common pair is in most documents.

Cases: null and empty texts, and texts whose tokens of A or B do not spell a blank and the text (as those with U+2581), have no
tokens: counts of 0, groups ''. Rows that repeat count each; a null doc_id is a value; other columns are left out. An empty
table gives an empty result. Special tokens in a text are plain text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, file_system, looked_up, numbered, slices
from .shingles import mix64
from .tokens import _LETTER, _OTHER, _OTHER_SPACE, _SPACE, _Known, _powers

#: Units and tokens that a worker keeps; bytes looked at together; rows of a slice.
KEEP, TOKENS, CHUNK, SLICE = 700_000, 12_000_000, 1 << 19, 500
#: Rows of the table of pairs that workers read whole, 16 bytes each.
PAIRS = 8_000_000
#: A pair of ids as one number: that of A times PAIR plus that of B.
PAIR = 1 << 24
_BREAK = 255  # in no UTF-8 text
_OPEN: dict[tuple[str, str], Aligner] = {}
_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in the entries of a byte-level vocabulary: printable ones for themselves, all others
    for the code points from 256 on, in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def linked(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a token of A and one of B whose bytes overlap, from the ends of both over the same bytes."""
    low = np.searchsorted(b_end, np.concatenate([[0], a_end[:-1]]), "right")  # the first that ends after the start
    high = np.searchsorted(b_end, a_end, "left")  # the first that reaches the end
    n = high - low + 1
    first = np.cumsum(n) - n
    return np.repeat(np.arange(len(a_end)), n), np.arange(int(n.sum())) + np.repeat(low - first, n)


def united(nodes: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over all links at once: the smallest node of each node's component."""
    parent = np.arange(nodes)
    while True:
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _column(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, "int64")


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return np.diff(total[np.concatenate([[0], ends])])


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first .. first + n - 1 of each range, in a row."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


class _Pool:
    """An array that grows at its end."""

    def __init__(self, kind: str):
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        while self.n + len(x) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class _Entries:
    """The bytes of a vocabulary's entries, and their ids in decimal digits."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), "int64", len(entries))
        self.begin, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(entries), "uint8")

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_spread(self.begin[ids], self.size[ids])]


def _digits(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal digits with a mark behind it, in a row, and the length of each."""
    width = 1 + sum((ids >= 10**k).astype("int64") for k in range(1, 8))
    places = np.arange(8)
    power = width[:, None] - 1 - places
    cell = (48 + ids[:, None] // 10 ** np.maximum(power, 0) % 10).astype("uint8")
    cell[np.arange(len(ids)), width] = marks
    return cell[places <= width[:, None]], width + 1


class Aligner:
    """Units of texts, with their tokens, groups and links, as far as they are known to this worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        entries = self.a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for text, i in entries.items():
            a_bytes[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_entries, self.b_entries = _Entries(a_bytes), _Entries(b_bytes)
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        side_by_side = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        if any("\n" in p for p in plain) or any(p[1] == "▁" != p[0] for p in side_by_side):
            raise ValueError("pieces go across blanks or line ends")
        self.marks = not any(p[0].isascii() and p[0].isalpha() and p[1].isascii() and _OTHER[ord(p[1])] for p in side_by_side)
        self.a_line, self.b_line = (next(i for i, x in enumerate(e) if x == b"\n") for e in (a_bytes, b_bytes))
        self.fast = _merger(a_path, a_bytes)
        self.forget()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        """One for each Python worker, which goes on with what tasks before have met."""
        if (a_path, b_path) not in _OPEN:
            _OPEN[a_path, b_path] = cls(a_path, b_path)
        return _OPEN[a_path, b_path]

    def forget(self) -> None:
        self.known, self.tokens = _Known(16), 0
        #: By unit: whether its tokens spell it, tokens of A and B, groups; and where its links and its groups as text end.
        self._spelt, self._na, self._nb, self._groups = (_Pool("int32") for _ in range(4))
        self._links_end, self._text_end = (_Pool("int64") for _ in range(2))
        self._links, self._text = _Pool("int64"), _Pool("uint8")
        self._links_end.add(np.zeros(1, "int64")), self._text_end.add(np.zeros(1, "int64"))

    @property
    def full(self) -> bool:
        return self.known.n > KEEP or self.tokens > TOKENS

    @property
    def begin(self) -> np.ndarray:
        """Where the links of each unit begin, and the end of all."""
        return self._links_end.all

    @property
    def links(self) -> np.ndarray:
        return self._links.all

    @property
    def sizes(self) -> list[np.ndarray]:
        """By unit: tokens of A, of B, groups, links."""
        return [self._na.all, self._nb.all, self._groups.all, np.diff(self.begin)]

    def _starts(self, x: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where units begin in bytes of texts that each begin with a blank and end with _BREAK. whole: parts of it that are
        units of their own."""
        before = np.empty_like(x)
        before[0], before[1:] = _BREAK, x[:-1]
        solid_before = ~_SPACE[before] & (before != _BREAK)
        out = ((x == 32) | (x == 10)) & solid_before
        if self.marks:
            out |= _OTHER[x] & _LETTER[before]
        return np.flatnonzero((out & ~whole) | (before == _BREAK))

    def _in_a_row(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of A and of B of all units in a row, and how many each has. Units without a line end are encoded with line ends
        between them, which join with nothing."""
        ids, counts = ([], []), ([], [])
        for s in range(0, len(texts), 2000):
            row = "\n" + "\n".join(texts[s : s + 2000])
            for k, (found, line) in enumerate(((self.fast.encode_ordinary(row), self.a_line), (self.b.encode(row)[1:], self.b_line))):
                found = np.array(found, "int64")
                ends = found == line
                ids[k].append(found[~ends])
                counts[k].append(np.diff(np.flatnonzero(ends), append=len(found)) - 1)
        return [np.concatenate(x) for x in ids], [np.concatenate(x) for x in counts]

    def _one_by_one(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a blank before a text that isn't empty; other units come after a line end
        led = [t[0] == " " != t for t in texts]
        b = [x if own else x[2:] for own, x in zip(led, self.b.encode([t[1:] if own else "\n" + t for own, t in zip(led, texts, strict=True)], num_threads=1), strict=True)]
        return [np.array([i for x in ids for i in x], "int64") for ids in (a, b)], [np.fromiter(map(len, ids), "int64", len(ids)) for ids in (a, b)]

    def _learn(self, a: np.ndarray, b: np.ndarray, units: list[bytes]) -> None:
        texts = [u.decode("utf-8", "surrogatepass") for u in units]
        plain = np.fromiter(("\n" not in t and t != " " and not t[:2].isspace() for t in texts), bool, len(texts)) & (self.fast is not None)
        for some, encode in ((np.flatnonzero(plain), self._in_a_row), (np.flatnonzero(~plain), self._one_by_one)):
            if len(some):
                self._keep(a[some], b[some], [units[i] for i in some.tolist()], *encode([texts[i] for i in some.tolist()]))

    def _keep(self, a: np.ndarray, b: np.ndarray, units: list[bytes], ids: list[np.ndarray], counts: list[np.ndarray]) -> None:
        size = np.fromiter(map(len, units), "int64", len(units))
        raw, at = np.frombuffer(b"".join(units), "uint8"), np.cumsum(size) - size
        spelt = np.ones(len(units), bool)
        for x, n, entries in zip(ids, counts, (self.a_entries, self.b_entries), strict=True):
            length = _sums(entries.size[x], np.cumsum(n))
            same = length == size
            of = np.repeat(same, n)
            own = _spread(at[same], size[same])
            wrong = np.repeat(np.flatnonzero(same), size[same])[entries.spell(x[of]) != raw[own]]
            same[wrong] = False
            spelt &= same
        (fa, fb), (na, nb) = ([x[np.repeat(spelt, n)] for x, n in zip(ids, counts, strict=True)], [np.where(spelt, n, 0) for n in counts])
        groups = np.zeros(len(units), "int64")
        n_links, n_text = groups.copy(), groups.copy()
        if len(fa):
            u, v = linked(np.cumsum(self.a_entries.size[fa]), np.cumsum(self.b_entries.size[fb]))
            root = united(len(fa) + len(fb), u, len(fa) + v)
            opens = np.zeros(len(root), bool)
            opens[root] = True  # the first token of A of each group
            number = np.cumsum(opens)[root] - 1
            ga, gb = number[: len(fa)], number[len(fa) :]
            of_a = np.repeat(np.arange(len(units)), na)
            groups = np.bincount(of_a[opens[: len(fa)]], minlength=len(units))
            n_links = np.bincount(of_a[u], minlength=len(units))
            # groups as text: tokens of A, then of B, of each group in turn
            in_a, in_b = (np.bincount(g, minlength=int(number.max()) + 1) for g in (ga, gb))
            place_a = np.arange(len(fa)) + (np.cumsum(in_b) - in_b)[ga]
            place_b = np.arange(len(fb)) + np.cumsum(in_a)[gb]
            order, mark = np.zeros(len(root), "int64"), np.zeros(len(root), "uint8")
            order[place_a], order[place_b] = fa, fb
            mark[place_a], mark[place_b] = (np.where(np.append(np.diff(g), 1) > 0, ord(end), ord(",")) for g, end in ((ga, "|"), (gb, ";")))
            text, width = _digits(order, mark)
            n_text = _sums(width, np.cumsum(na + nb))
            self._links.add(fa[u] * PAIR + fb[v]), self._text.add(text)
        for pool, x in ((self._spelt, spelt), (self._na, na), (self._nb, nb), (self._groups, groups)):
            pool.add(x)
        for pool, n in ((self._links_end, n_links), (self._text_end, n_text)):
            pool.add(pool.all[-1] + np.cumsum(n))
        self.tokens += len(fa) + len(fb)
        self.known.add(a, b)

    def rows(self, texts: list[bytes], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts in a row, as rows of what is known, and where each text's end."""
        joined = b"\xff".join([*texts, b""])
        x = np.frombuffer(joined, "uint8")
        size = np.fromiter((len(t) + 1 for t in texts), "int64", len(texts))
        starts = self._starts(x, np.repeat(np.array(whole, bool), size))
        length = np.diff(np.append(starts, len(x)))
        value = np.where(x == _BREAK, np.uint64(0), x.astype("uint64") + np.uint64(1))
        place = np.arange(len(x)) - np.repeat(starts, length)
        a, b = (mix64(np.add.reduceat(value * p[place], starts)) for p in _powers(int(length.max())))
        row = self.known.find(a, b)
        while len(miss := np.flatnonzero(row < 0)):
            _, at = np.unique(a[miss] ^ (b[miss] << np.uint64(1)), return_index=True)
            for s in range(0, len(at), 20_000):
                new = miss[at[s : s + 20_000]]
                self._learn(a[new], b[new], [joined[i : i + n].rstrip(b"\xff") for i, n in zip(starts[new].tolist(), length[new].tolist(), strict=True)])
            row[miss] = self.known.find(a[miss], b[miss])
        return row, np.searchsorted(starts, np.cumsum(size))

    def parts(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Texts that are not empty, some at a time: their places, units, and where each text's units end. Between two of
        them a caller may forget()."""
        held: list[tuple[int, bytes, bool]] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            held.append((i, b" " + t.encode("utf-8", "surrogatepass"), not t.isascii() and _OTHER_SPACE.search(t) is not None))
            size += len(held[-1][1])
            if size >= CHUNK:
                yield [h[0] for h in held], *self.rows([h[1] for h in held], [h[2] for h in held])
                held, size = [], 0
        if held:
            yield [h[0] for h in held], *self.rows([h[1] for h in held], [h[2] for h in held])

    def all_spelt(self, row: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text spell it."""
        return _sums(1 - self._spelt.all[row], ends) == 0

    def written(self, row: np.ndarray, ends: np.ndarray) -> list[str]:
        """The groups of each text."""
        end = self._text_end.all
        n = end[row + 1] - end[row]
        whole = self._text.all[_spread(end[row], n)].tobytes()
        cut = np.concatenate([[0], np.cumsum(_sums(n, ends))]).tolist()
        return [whole[s : e - 1].decode() if s < e else "" for s, e in zip(cut, cut[1:])]


def _merger(path: str, entries: list[bytes]):
    """A faster encoder of the same vocabulary: where its ids stand in the order of its merges, a merge of least rank is the one of
    least id. None where they don't, or where texts are parted in another way."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, parts, letters = said["model"], said.get("pre_tokenizer") or {}, byte_of_letter()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    made = [bytes(letters[c] for c in x + y) if all(c in letters for c in x + y) else b"" for x, y in pairs]
    first = entries[: len(entries) - len([e for e in said.get("added_tokens", ()) if model["vocab"].get(e["content"]) is not None])]
    plain = parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space") and not said.get("normalizer") and not model.get("ignore_merges")
    if not plain or first[256:] != made or sorted(first[:256]) != [bytes([b]) for b in range(256)]:
        return None
    return tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks={e: i for i, e in enumerate(first)}, special_tokens={})


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair, n: how often each pair of ids is linked in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligner.of(a_path, b_path)
        times = np.zeros(0, "int64")

        def told() -> pa.RecordBatch:
            met = np.flatnonzero(times)
            n = known.begin[met + 1] - known.begin[met]
            pair, where = np.unique(known.links[_spread(known.begin[met], n)], return_inverse=True)
            count = np.zeros(len(pair), "int64")
            np.add.at(count, where, np.repeat(times[met], n))
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(count, pa.int64())], ["pair", "n"])

        for batch in slices(batches, SLICE):
            for _, row, ends in known.parts(batch.column("text").to_pylist()):
                good = np.repeat(known.all_spelt(row, ends), np.diff(ends, prepend=0))
                now = np.bincount(row[good], minlength=known.known.n)
                now[: len(times)] += times
                times = now
                if known.full:
                    yield told()
                    known.forget()
                    times = np.zeros(0, "int64")
        yield told()

    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in ascending order, and their counts, negative where a pair is not the commonest of its id of B."""
    if path not in _TABLES:
        import pyarrow.parquet as pq

        fs, top = file_system(path)
        from pyarrow import fs as files

        names = [f.path for f in fs.get_file_info(files.FileSelector(top)) if f.path.endswith(".parquet")]
        read = [pq.read_table(n, filesystem=fs) for n in names]
        pair, n = (_column([t.column(c).to_numpy() for t in read]) for c in ("pair", "signed"))
        order = np.argsort(pair)
        _TABLES.clear()
        _TABLES[path] = pair[order], n[order]
    return _TABLES[path]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _per_document(docs: DataFrame, a_path: str, b_path: str, path: str | None) -> DataFrame:
    """doc_id, the counts of its tokens, groups and links, and groups; path: the table of pairs, for n_best and count_sum."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*_COUNTS, *(("n_best", "count_sum") if path else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligner.of(a_path, b_path)
        pairs, signed = _pair_table(path) if path else (None, None)
        added = np.zeros((0, 2), "int64")  # by unit: links that are the commonest, and the sum of counts
        for batch in slices(batches, SLICE):
            texts = batch.column("text").to_pylist()
            out, groups = np.zeros((len(texts), len(names)), "int64"), [""] * len(texts)
            for at, row, ends in known.parts(texts):
                good = known.all_spelt(row, ends)
                columns = known.sizes
                if path:
                    new = known.links[known.begin[len(added)] :]
                    # units of other tasks and of texts that aren't spelt have pairs that the table lacks; nothing reads their sums
                    n = signed[np.minimum(np.searchsorted(pairs, new), len(pairs) - 1)] if len(pairs) else np.zeros(len(new), "int64")
                    stops = known.begin[len(added) + 1 :] - known.begin[len(added)]
                    added = np.concatenate([added, np.stack([_sums(n > 0, stops), _sums(np.abs(n), stops)], 1)])
                    columns += [added[:, 0], added[:, 1]]
                out[at] = np.stack([_sums(c[row], ends) * good for c in columns], 1)
                for i, ok, text in zip(at, good.tolist(), known.written(row, ends), strict=True):
                    groups[i] = text if ok else ""
                if known.full:
                    known.forget()
                    added = np.zeros((0, 2), "int64")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[:, i]) for i in range(len(names))), pa.array(groups, pa.large_string()).cast(pa.string())], ["doc_id", *names, "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in names)}, groups string")


def _pairs_of(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """rows: __row, text. A row for each distinct pair of a text: __row, pair, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligner.of(a_path, b_path)
        for batch in slices(batches, SLICE):
            number = batch.column("__row").to_numpy()
            for at, row, ends in known.parts(batch.column("text").to_pylist()):
                good = np.repeat(known.all_spelt(row, ends), np.diff(ends, prepend=0))
                unit, text = row[good], np.repeat(np.array(at), np.diff(ends, prepend=0))[good]
                n = known.begin[unit + 1] - known.begin[unit]
                pair = known.links[_spread(known.begin[unit], n)]
                both, times = np.unique(np.stack([np.repeat(text, n), pair]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(number[both[0]]), pa.array(both[1]), pa.array(times.astype("int64"))], ["__row", "pair", "times"])
                if known.full:
                    known.forget()

    return rows.select("__row", "text").mapInArrow(run, "__row long, pair long, times long")


def links(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, n, best: how often each pair of ids is linked in the corpus, and whether it is the commonest of b_id."""
    return _links(Scratch(spark, "alignment"), docs, a_path, b_path).select(F.expr(f"cast(pair div {PAIR} as int)").alias("a_id"), (F.col("pair") % PAIR).cast("int").alias("b_id"), F.abs("signed").alias("n"), (F.col("signed") > 0).alias("best"))


def _links(scratch: Scratch, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    counted = scratch.save(pair_counts(docs, a_path, b_path), "counted")
    b_id = F.col("pair") % PAIR
    most = counted.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
    marked = counted.join(F.broadcast(most), b_id == F.col("b"))
    return scratch.save(marked.select("pair", F.when(F.col("n") == F.col("most"), F.col("n")).otherwise(-F.col("n")).alias("signed")), "pairs")


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, limit: int = PAIRS) -> DataFrame:
    """docs: doc_id, text and any more columns. Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the
    commonest of its id of B), count_sum (over links, how often their pair is linked), and groups: `a1,a2|b1;a3|b2,b3`.
    limit: rows of the table of pairs beyond which it is joined instead of read whole; the result is the same."""
    scratch = Scratch(spark, "alignment")
    pairs = _links(scratch, docs, a_path, b_path)
    if pairs.count() <= limit:
        return _per_document(docs, a_path, b_path, scratch.path("pairs"))
    rows = numbered(scratch, docs.select("doc_id", "text"), "__row")
    met = looked_up(_pairs_of(rows, a_path, b_path), pairs, ["pair"], 16, ["__row"])
    sums = met.groupBy("__row").agg(F.sum(F.when(F.col("signed") > 0, F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.abs("signed") * F.col("times")).alias("count_sum"))
    own = _per_document(rows.select(F.col("__row").alias("doc_id"), "text"), a_path, b_path, None).withColumnRenamed("doc_id", "__row")
    out = rows.select("__row", "doc_id").join(own, "__row").join(sums, "__row", "left")
    return out.select("doc_id", *_COUNTS, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups")
