"""Word shingles of whole texts, hashed with numpy over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SPACE_BYTES

WIDTH = 5
#: Bytes hashed at once; longer texts are cut at white space, which ends a word.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_SAME = np.arange(256, dtype="uint64")
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_POW = 0xD6E8FEB86659FD93
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "uint64")


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _POW, "uint64")
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashed(x: np.ndarray, letters: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starting places of the words in bytes that end with white space."""
    space = _SPACE[x]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, "uint64"), starts
    gap = np.diff(np.append(starts, len(x)))
    body = x[starts[0] :]
    value = np.where(space[starts[0] :], np.uint64(0), letters[body] + np.uint64(1))
    value *= _powers(int(gap.max()))[np.arange(len(body)) - np.repeat(starts - starts[0], gap)]
    return mix64(np.add.reduceat(value, starts - starts[0])), starts


def _cuts(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and text[end] not in SPACE_BYTES:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes], fold: bool = True) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order; fold: A-Z count as a-z."""
    letters = _LOWER if fold else _SAME
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        joined = b"\n".join([*held, b""])
        h, starts = _hashed(np.frombuffer(joined, "uint8"), letters)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in held), "int64", len(held)))
        yield from np.split(h, np.searchsorted(starts, ends[:-1]))

    for t in texts:
        if len(t) > CHUNK:
            if held:
                yield from flush()
                held, size = [], 0
            yield np.concatenate([_hashed(np.frombuffer(c + b"\n", "uint8"), letters)[0] for c in _cuts(t)])
            continue
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of all words, if there are fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, "uint64")
    if n < WIDTH:
        return mix64(np.array([(words * _MULT[:n]).sum(dtype="uint64") + np.uint64(n)], "uint64"))
    h = words[: n - WIDTH + 1] * _MULT[0]
    for i in range(1, WIDTH):
        h = h + words[i : n - WIDTH + 1 + i] * _MULT[i]
    return np.unique(mix64(h))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    return map(shingle_set, word_hashes([b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]))
