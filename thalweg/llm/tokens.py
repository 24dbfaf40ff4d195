"""Tokenizing whole texts with a public vocabulary file, by units whose ids don't depend on their neighbours.

Both vocabularies part a text before any merge: at ASCII white space (the byte-level one keeps a blank with the word after
it), and wherever a letter meets an ASCII character that is none. So the ids of a text are those of its units in a row.
Units are found and hashed (twice, 128 bits) with numpy over the bytes of many texts, looked up in a hash table of what
this worker has met, and only new ones go to the tokenizer. The table is emptied at KEEP units, a bound on memory that
changes no result. Texts with white space beyond ASCII, which the byte-level pattern may join to a neighbour, and texts
that contain an added token of the vocabulary (as <|endoftext|>), which is one id by the library's default, go to the
tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from .shingles import mix64

KEEP = 500_000
#: Bytes looked at together.
CHUNK = 1 << 19
#: Unicode white space beyond ASCII. Fixed values.
_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
_BREAK = 255  # in no UTF-8 text
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = np.zeros(256, bool)
_OTHER[[c for c in range(128) if not _LETTER[c] and not _SPACE[c]]] = True
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: list[np.ndarray] = [np.ones(1, "uint64"), np.ones(1, "uint64")]
_OPEN: dict[tuple[str, str], Encoder] = {}


def _powers(n: int) -> list[np.ndarray]:
    for i, base in enumerate(_BASES):
        if len(_POWERS[i]) < n:
            p = np.full(2 * n, base, "uint64")
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


def unit_starts(x: np.ndarray, blanks: bool) -> np.ndarray:
    """Where units begin in the bytes of texts that each end with _BREAK. blanks: white space is kept."""
    before = np.empty_like(x)
    before[0], before[1:] = _BREAK, x[:-1]
    space, space_before = _SPACE[x], _SPACE[before]
    solid = ~space & (x != _BREAK)
    latin = _LETTER[x]
    latin[1:] |= (x[:-1] == 0xC3) & (x[1:] != 0x97) & (x[1:] != 0xB7)  # U+00C0 to U+00FF
    after_letter = np.zeros(len(x), bool)
    after_letter[1:] = latin[:-1]
    out = (solid & (before == _BREAK)) | (_OTHER[x] & after_letter)
    if not blanks:
        return np.flatnonzero(out | (solid & space_before))
    last = np.zeros(len(x), bool)
    last[:-1] = space[:-1] & solid[1:]
    return np.flatnonzero(out | (space & ~space_before) | last | (solid & space_before & (before != 32)))


class _Known:
    """An open-addressing table of pairs of hashes; their rows ascend from 0."""

    def __init__(self, bits: int = 18):
        self.bits, self.n = bits, 0
        self.a, self.b, self.row = np.zeros(1 << bits, "uint64"), np.zeros(1 << bits, "uint64"), np.full(1 << bits, -1, "int32")

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = (a >> np.uint64(64 - self.bits)).astype("int64")
        out = self.row[slot]
        other = np.flatnonzero((out >= 0) & ((self.a[slot] != a) | (self.b[slot] != b)))
        slot = slot[other]
        while len(other):
            slot = slot + 1 & (1 << self.bits) - 1
            found = self.row[slot]
            out[other] = found
            again = (found >= 0) & ((self.a[slot] != a[other]) | (self.b[slot] != b[other]))
            other, slot = other[again], slot[again]
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """New pairs, each once."""
        if 2 * (self.n + len(a)) > 1 << self.bits:
            held = np.flatnonzero(self.row >= 0)
            held = held[np.argsort(self.row[held])]
            olda, oldb, bits = self.a[held], self.b[held], self.bits
            while 2 * (self.n + len(a)) > 1 << bits:
                bits += 1
            self.__init__(bits)
            self._put(olda, oldb)
        self._put(a, b)

    def _put(self, a: np.ndarray, b: np.ndarray) -> None:
        left, slot = np.arange(len(a)), (a >> np.uint64(64 - self.bits)).astype("int64")
        while len(left):
            free = np.flatnonzero(self.row[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.a[slot[put]], self.b[slot[put]], self.row[slot[put]] = a[left[put]], b[left[put]], self.n + left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], slot[rest] + 1 & (1 << self.bits) - 1
        self.n += len(a)


class Encoder:
    """Texts to ids. kind: "byte" keeps white space, "word" drops it."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks = Tokenizer.from_file(path), kind == "byte"
        # the library looks for them in the text as it is, or as it is after the normalizer
        self.added = [(t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.used = _Known(), np.zeros(1 << 16, "int32"), 0
        self.begin = np.zeros(1 << 16, "int64")

    @classmethod
    def of(cls, path: str, kind: str) -> Encoder:
        """One for each Python worker."""
        if (path, kind) not in _OPEN:
            _OPEN[path, kind] = cls(path, kind)
        return _OPEN[path, kind]

    def _whole(self, t: str) -> bool:
        """Whether the ids of a text may not be those of its units."""
        if self.blanks and not t.isascii() and _OTHER_SPACE.search(t):
            return True
        if any(x in t for x, _ in self.added):
            return True
        if self.tokenizer.normalizer and any(normal for _, normal in self.added):
            plain = self.tokenizer.normalizer.normalize_str(t)
            return any(normal and self.tokenizer.normalizer.normalize_str(x) in plain for x, normal in self.added)
        return False

    def _tokenized(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, a: np.ndarray, b: np.ndarray, units: list[str]) -> None:
        for s in range(0, len(units), 20_000):
            ids = self._tokenized(units[s : s + 20_000])
            n = np.fromiter(map(len, ids), "int64", len(ids))
            total, first = int(n.sum()), self.known.n + s
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while first + len(ids) + 1 > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.ids[self.used : self.used + total] = np.fromiter((x for r in ids for x in r), "int32", total)
            self.begin[first + 1 : first + 1 + len(ids)] = self.used + np.cumsum(n)
            self.used += total
        self.known.add(a, b)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each ends."""
        whole = b"\xff".join([*texts, b""])
        x = np.frombuffer(whole, "uint8")
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), "int64", len(texts)))
        starts = unit_starts(x, self.blanks)
        if not len(starts):
            return np.zeros(0, "int32"), np.zeros(len(texts), "int64")
        size = np.diff(np.append(starts, len(x)))
        first = starts[0]
        place = np.arange(len(x) - first) - np.repeat(starts - first, size)
        body = x[first:]
        value = np.where((body == _BREAK) | (_SPACE[body] & (not self.blanks)), np.uint64(0), body.astype("uint64") + np.uint64(1))
        a, b = (mix64(np.add.reduceat(value * p[place], starts - first)) for p in _powers(int(size.max())))
        if self.known.n > KEEP:
            self._forget()
        row = self.known.find(a, b)
        while len(miss := np.flatnonzero(row < 0)):
            _, at = np.unique(a[miss] ^ (b[miss] << np.uint64(1)), return_index=True)
            new = miss[at]
            strip = b"\xff" if self.blanks else b"\xff \t\n\r\x0b\x0c"
            self._learn(a[new], b[new], [whole[s : s + n].rstrip(strip).decode("utf-8", "surrogatepass") for s, n in zip(starts[new].tolist(), size[new].tolist(), strict=True)])
            row[miss] = self.known.find(a[miss], b[miss])
        begin = self.begin[row]
        n = self.begin[row + 1] - begin
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, stops)]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """The index and ids (int32) of each text, in order."""
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            if not held:
                return
            ids, ends = self._encode([t for _, t in held])
            at = 0
            for (i, _), e in zip(held, ends.tolist(), strict=True):
                yield i, ids[at:e]
                at = e

        for i, t in enumerate(texts):
            if t and self._whole(t):
                yield from flush()
                held, size = [], 0
                yield i, np.array(self._tokenized([t])[0], "int32")
                continue
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            held.append((i, raw))
            size += len(raw)
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        yield from flush()
