"""Progressive JPEG in numpy: an encoder of coefficient arrays, a decoder of progressive files, and media columns.

The decoder accumulates the scans of many files at once into coefficient arrays: spectral selection, successive
approximation, end-of-band runs, interleaved and single-component scans, any sampling factors, restart intervals. The
restart intervals of all files are lanes that it decodes in step, a symbol of each lane at a time. Coefficients are
dequantised, inverse-transformed by one matrix product, chroma is upsampled by replication, and the result is
full-resolution RGB. A file without restart intervals is one lane and decodes slowly, but right.

A payload of bytes is stored losslessly in the quantised coefficients (byte - 128, unit quantisation, 4:2:0), which is
the format's own unit of 8 bits; its length stands in a comment segment.

Cases: null and empty texts give a payload of padding; files may have any size up to 65,535 pixels a side; a damaged file
raises. Texts travel a few MB at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT, PAD = 576, 255
LANES, BYTES = 16_384, 4 << 20


def _zigzag() -> np.ndarray:
    """The place in the 8 x 8 block of each coefficient: diagonals, every other one upward."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
_n = np.arange(8)
_BASIS = np.where(_n[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _n[None, :] + 1) * _n[:, None] * np.pi / 16))
#: Coefficients in zigzag order times this are the samples of a block.
INVERSE = np.kron(_BASIS, _BASIS)[ZIGZAG].astype("float32")

# Huffman tables as symbols by code length. Those of the encoder: the symbols that text makes get short codes.
_rest = lambda first, sizes: [r << 4 | s for r in range(16) for s in sizes if (r << 4 | s) not in first] + [0xF0]


def _table(short: list[tuple[int, int]], rest: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(17)]
    for length, symbol in short:
        out[length].append(symbol)
    out[16] += rest
    return out


_AC_FULL = [(1, 0x05), (2, 0x07), (3, 0x04), (4, 0x06), (5, 0x03), (6, 0x00), (7, 0x02), (8, 0x08), (9, 0x01)]
_AC_HALF = [(1, 0x04), (2, 0x06), (3, 0x03), (4, 0x05), (5, 0x02), (6, 0x00), (7, 0x01), (8, 0x07)]
TABLES = {
    (0, 0): _table([(4, s) for s in range(12)], []),
    (1, 0): _table(_AC_HALF, _rest({s for _, s in _AC_HALF}, range(1, 8))),
    (1, 1): _table(_AC_FULL, _rest({s for _, s in _AC_FULL}, range(1, 9))),
    (1, 2): _table([(1, 0x00), (3, 0x01), (3, 0x11), (4, 0x21), (4, 0x31), (5, 0x41)], []),
}
#: components, first and last coefficient, high and low bit, Huffman table of each scan.
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1, 0), *(((c,), 1, 5, 0, 1, 0) for c in range(3)), *(((c,), 6, 63, 0, 0, 1) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0, 0), *(((c,), 1, 5, 1, 0, 2) for c in range(3)),
]
SAMPLING = ((2, 2), (1, 1), (1, 1))


def _codes(table: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, codes, lengths = 0, np.zeros(256, "int64"), np.zeros(256, "int64")
    for length in range(1, 17):
        for symbol in table[length]:
            codes[symbol], lengths[symbol] = code, length
            code += 1
        code <<= 1
    return codes, lengths


def _lookup(table: list[list[int]]) -> np.ndarray:
    """length << 8 | symbol by the next 16 bits; 0 where no code stands."""
    out, code = np.zeros(1 << 16, "int64"), 0
    for length in range(1, 17):
        for symbol in table[length]:
            out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
            code += 1
        code <<= 1
    return out


_CODES = {k: _codes(t) for k, t in TABLES.items()}
_SIZE = np.array([int(i).bit_length() for i in range(1 << 12)])


def _pack(value: np.ndarray, bits: np.ndarray) -> bytes:
    """Values of at most 32 bits, most significant bit first. The bits end at a byte."""
    at = np.cumsum(bits) - bits
    total = int(at[-1] + bits[-1]) if len(bits) else 0
    word, off = at >> 5, at & 31
    wide = value.astype("uint64") << (64 - off - bits).astype("uint64")
    n = (total >> 5) + 2
    out = np.bincount(word, (wide >> np.uint64(32)).astype("float64"), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype("float64"), n)
    return out.astype(">u4").tobytes()[: total >> 3]


def _padded(value: np.ndarray, bits: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Items of lanes, whose last items, at `ends` - 1, are left for padding. Returns the bytes and the length of each lane."""
    stop = np.cumsum(bits)[ends - 1]
    size = np.diff(np.concatenate([[0], stop]))
    pad = -size & 7
    value[ends - 1], bits[ends - 1] = (1 << pad) - 1, pad
    return _pack(value, bits), (size + pad) >> 3


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = _SIZE[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _dc_first(c: np.ndarray, low: int) -> tuple[bytes, np.ndarray]:
    """c: MCU x 6 DC coefficients."""
    v = c >> low
    before = np.zeros_like(v)
    before[:, 1:4] = v[:, :3]
    size, extra = _magnitude(v - before)
    code, length = _CODES[0, 0]
    value, bits = np.zeros((len(c), 7), "int64"), np.zeros((len(c), 7), "int64")
    value[:, :6], bits[:, :6] = code[size] << size | extra, length[size] + size
    return _padded(value.ravel(), bits.ravel(), np.arange(1, len(c) + 1) * 7)


def _dc_more(c: np.ndarray, low: int) -> tuple[bytes, np.ndarray]:
    value, bits = np.zeros((len(c), 7), "int64"), np.ones((len(c), 7), "int64")
    value[:, :6], bits[:, 6] = c >> low & 1, 0
    return _padded(value.ravel(), bits.ravel(), np.arange(1, len(c) + 1) * 7)


def _ac_first(c: np.ndarray, low: int, table: int) -> tuple[bytes, np.ndarray]:
    """c: blocks x band."""
    v = np.where(c < 0, -(-c >> low), c >> low)
    row, k = np.nonzero(v)
    n, width = v.shape
    before = np.concatenate([[-1], k[:-1]])
    before[np.concatenate([[True], row[1:] != row[:-1]])[: len(row)] if len(row) else slice(0)] = -1
    run = k - before[: len(k)] - 1
    long, run = run >> 4, run & 15
    size, extra = _magnitude(v[row, k])
    code, length = _CODES[1, table]
    last = np.full(n, -1)
    last[row] = k  # the largest, as k ascends
    tail = (last < width - 1).astype("int64")
    own = np.cumsum(1 + long)
    closed = np.cumsum(tail + 1)
    at = own - 1 + (closed - tail - 1)[row]
    ends = np.cumsum(np.bincount(row, 1 + long, n).astype("int64") + tail + 1)
    value, bits = np.zeros(ends[-1], "int64"), np.zeros(ends[-1], "int64")
    symbol = run << 4 | size
    value[at], bits[at] = code[symbol] << size | extra, length[symbol] + size
    for i in range(1, 4):
        z = at[long >= i] - i
        value[z], bits[z] = code[0xF0], length[0xF0]
    e = ends[tail > 0] - 2
    value[e], bits[e] = code[0], length[0]
    return _padded(value, bits, ends)


def _ac_more(c: np.ndarray, low: int, table: int) -> tuple[bytes, np.ndarray]:
    """c: blocks x a narrow band, in the last bit."""
    code, length = _CODES[1, table]
    n = len(c)
    value, bits, run, held, count = (np.zeros(n, "int64") for _ in range(5))
    size = np.abs(c) >> low
    for k in range(c.shape[1]):
        m = size[:, k]
        old, new = m > 1, m == 1
        held, count = np.where(old, held << 1 | m & 1, held), count + old
        symbol = np.where(new, run << 4 | 1, 0)
        more = length[symbol] + 1 + count
        value = np.where(new, (value << more) | ((code[symbol] << 1 | (c[:, k] > 0)) << count) | held, value)
        bits = np.where(new, bits + more, bits)
        held, count, run = np.where(new, 0, held), np.where(new, 0, count), np.where(new, 0, run + (m == 0))
    rest = (run > 0) | (count > 0)
    value = np.where(rest, (value << length[0] + count) | (code[0] << count) | held, value)
    bits = np.where(rest, bits + length[0] + count, bits)
    return _padded(np.stack([value, value], 1).ravel(), np.stack([bits, bits * 0], 1).ravel(), np.arange(1, n + 1) * 2)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _shape(payload: int) -> tuple[int, int]:
    """MCU in a row, and rows."""
    n = -(-payload // 384)
    wide = int(np.ceil(np.sqrt(n)))
    return wide, -(-n // wide)


def _head(payload: int, wide: int, high: int) -> bytes:
    frame = bytes([8]) + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3])
    frame += b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))
    tables = b"".join(bytes([kind << 4 | number]) + bytes(len(t[i]) for i in range(1, 17)) + bytes(s for x in t for s in x) for (kind, number), t in TABLES.items())
    return b"\xff\xd8" + _segment(0xFE, b"payload %d" % payload) + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC2, frame) + _segment(0xC4, tables) + _segment(0xDD, (1).to_bytes(2, "big"))


_SOS = [_segment(0xDA, bytes([len(cs)]) + b"".join(bytes([c + 1, t << 4 | t if ss == 0 else t]) for c in cs) + bytes([ss, se, ah << 4 | al])) for cs, ss, se, ah, al, t in SCRIPT]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload."""
    if not payloads:
        return []
    shapes = [_shape(len(p)) for p in payloads]
    mcus = np.array([w * h for w, h in shapes])
    # blocks of each component in raster order, all files in a row
    planes: list[list[np.ndarray]] = [[], [], []]
    for p, (w, h) in zip(payloads, shapes, strict=True):
        c = np.zeros(w * h * 384, "int16")
        c[: len(p)] = np.frombuffer(p, "uint8").astype("int16") - 128
        c = c.reshape(h, w, 6, 64)
        planes[0].append(c[:, :, :4].reshape(h, w, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64))
        planes[1].append(c[:, :, 4].reshape(-1, 64))
        planes[2].append(c[:, :, 5].reshape(-1, 64))
    blocks = [np.concatenate(p) for p in planes]
    dc = np.concatenate([np.concatenate([y.reshape(h, 2, w, 2, 64)[..., 0].transpose(0, 2, 1, 3).reshape(-1, 4), b[:, :1], r[:, :1]], 1) for y, b, r, (w, h) in zip(*planes, shapes, strict=True)]).astype("int64")
    parts: list[list[bytes]] = [[_head(len(p), *s)] for p, s in zip(payloads, shapes, strict=True)]
    for (cs, ss, se, ah, al, t), sos in zip(SCRIPT, _SOS, strict=True):
        source = dc if ss == 0 else blocks[cs[0]]
        per_file = mcus * (4 if ss and cs[0] == 0 else 1)
        data, sizes = [], []
        for i in range(0, len(source), LANES):
            part = source[i : i + LANES] if ss == 0 else source[i : i + LANES, ss : se + 1].astype("int64")
            d, s = (_dc_more(part, al) if ah else _dc_first(part, al)) if ss == 0 else _ac_more(part, al, t) if ah else _ac_first(part, al, t)
            data.append(d), sizes.append(s)
        raw, size = np.frombuffer(b"".join(data), "uint8"), np.concatenate(sizes)
        # byte stuffing, and restart markers between the lanes of a file
        lane = np.repeat(np.arange(len(size)), size)
        stuffed = raw == 255
        first = np.cumsum(per_file) - per_file
        number = np.arange(len(size)) - np.repeat(first, per_file)
        marked = number > 0
        at = np.arange(len(raw)) + (np.cumsum(stuffed) - stuffed) + 2 * np.cumsum(marked)[lane]
        total = len(raw) + int(stuffed.sum()) + 2 * int(marked.sum())
        out = np.zeros(total, "uint8")
        out[at] = raw
        begin = np.concatenate([[0], np.cumsum(size + np.bincount(lane, stuffed, len(size)).astype("int64") + 2 * marked)])
        m = begin[:-1][marked]
        out[m], out[m + 1] = 255, 0xD0 + ((number[marked] - 1) & 7)
        whole, stops = out.tobytes(), begin[np.cumsum(per_file)].tolist()
        start = 0
        for p, stop in zip(parts, stops, strict=True):
            p += (sos, whole[start:stop])
            start = stop
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]


class _File:
    """What the headers of a file say: components, tables, scans; and its coefficients, by component."""

    def __init__(self, data: bytes, at: int, ends: np.ndarray):
        """at: where the file begins in the bytes of all; ends: places of markers other than restarts there."""
        self.comment, self.quant, self.scans, tables, restart = b"", {}, [], {}, 0
        i = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while (marker := data[i + 1]) != 0xD9:
            n = int.from_bytes(data[i + 2 : i + 4], "big")
            body = data[i + 4 : i + 2 + n]
            i += 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "uint8").astype("float32")
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts, total = body[1:17], sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = body[: 17 + total]
                    body = body[17 + total :]
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xC2:
                self.high, self.wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[6 + 3 * j], body[7 + 3 * j] >> 4, body[7 + 3 * j] & 15, body[8 + 3 * j]) for j in range(body[5])]
                self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
                self.across, self.down = -(-self.wide // (8 * self.hmax)), -(-self.high // (8 * self.vmax))
                self.blocks = [(self.across * h, self.down * v) for _, h, v, _ in self.parts]
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a progressive JPEG file")
            elif marker == 0xDA:
                ids = [p[0] for p in self.parts]
                cs = tuple(ids.index(body[1 + 2 * j]) for j in range(body[0]))
                ss, se, a = body[1 + 2 * body[0] :][:3]
                used = tuple(tables.get((0 if ss == 0 else 1, body[2 + 2 * j] >> 4 if ss == 0 else body[2 + 2 * j] & 15), b"") for j in range(body[0]))
                stop = int(ends[np.searchsorted(ends, at + i)]) - at
                self.scans.append(((cs, ss, se, a >> 4, a & 15, used), i, stop, restart))
                i = stop

    def mcus(self, cs: tuple[int, ...]) -> tuple[int, int]:
        """MCU across and down in a scan of these components."""
        if len(cs) > 1:
            return self.across, self.down
        _, h, v, _ = self.parts[cs[0]]
        return -(-(-(-self.wide * h // self.hmax)) // 8), -(-(-(-self.high * v // self.vmax)) // 8)


class _Lanes:
    """Restart intervals of a scan of many files: a bit reader for each, over the bytes without stuffing."""

    def __init__(self, raw: np.ndarray):
        """raw: the entropy-coded bytes, each lane with a marker after it."""
        after = np.append(raw[1:], 0)
        mark = (raw == 255) & (after != 0)
        stuffing = np.concatenate([[False], (raw[:-1] == 255) & (raw[1:] == 0)])
        drop = mark | stuffing
        drop[1:] |= mark[:-1]
        clean = np.concatenate([raw[~drop], np.zeros(8, "uint8")]).astype("int64")
        kept = np.cumsum(~drop)
        ends = kept[np.flatnonzero(mark)]
        self.begin = np.concatenate([[0], ends[:-1]]) * 8
        n = len(clean) - 5
        self.window = clean[:n] << 32 | clean[1 : n + 1] << 24 | clean[2 : n + 2] << 16 | clean[3 : n + 3] << 8 | clean[4 : n + 4]

    def bits(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The n <= 32 bits at these places."""
        return self.window[at >> 3] >> (40 - (at & 7) - n) & ((1 << n) - 1)


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


_OPEN: dict[bytes, np.ndarray] = {}


def _opened(table: bytes) -> np.ndarray:
    if table not in _OPEN:
        symbols, by_length, at = table[17:], [[]], 0
        for n in table[1:17]:
            by_length.append(list(symbols[at : at + n]))
            at += n
        _OPEN[table] = _lookup(by_length)
    return _OPEN[table]


def _ac_decode(lanes: _Lanes, coef: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, ss: int, se: int, ah: int, al: int, table: np.ndarray) -> None:
    """Adds a scan of one component. place: row in coef of each block of the scan; first, last: the blocks of each lane."""
    live = first < last
    at, blk, end = lanes.begin[live].copy(), first[live].copy(), last[live]
    k, eob = np.full(len(at), ss), np.zeros(len(at), "int64")
    skip, fresh, need = np.zeros(len(at), "int64"), np.zeros(len(at), "int64"), np.ones(len(at), bool)
    while len(at):
        if ah == 0:
            t = table[lanes.bits(at, 16)]
            n, run, size = t >> 8, t >> 4 & 15, t & 15
            if not n.all():
                raise ValueError("bad Huffman code")
            more = np.where(size > 0, size, np.where(run == 15, 0, run))
            value = lanes.bits(at + n, more)
            at += n + more
            some = size > 0
            k += run
            if (k[some] > se).any():
                raise ValueError("coefficient beyond its band")
            coef[place[blk[some]], k[some]] = _extend(value[some], size[some]) << al
            k += 1
            over = ~some & (run < 15)
            done = over | (k > se)
            if done.any():
                blk = blk + np.where(over, (1 << run) + value, done)
                k[done] = ss
                if (keep := blk < end).all():
                    continue
                at, blk, end, k = at[keep], blk[keep], end[keep], k[keep]
            continue
        ask = np.flatnonzero(need & (eob == 0))
        if len(ask):
            t = table[lanes.bits(at[ask], 16)]
            n, run, size = t >> 8, t >> 4 & 15, t & 15
            more = np.where(size > 0, 1, np.where(run == 15, 0, run))
            value = lanes.bits(at[ask] + n, more)
            at[ask] += n + more
            over = (size == 0) & (run < 15)
            eob[ask] = np.where(over, (1 << run) + value, 0)
            skip[ask], fresh[ask] = run, np.where(size > 0, np.where(value > 0, 1, -1) << al, 0)
            need[ask] = False
        rows = place[blk]
        c = coef[rows, k].astype("int64")
        old = c != 0
        bit = lanes.bits(at, 1) * old
        at += old
        c += np.where((bit > 0) & (np.abs(c) >> al & 1 == 0), np.sign(c) << al, 0)
        here = ~old & (eob == 0)
        put = here & (skip == 0)
        coef[rows, k] = np.where(put, fresh, c)
        need |= put
        skip -= here & ~put
        k += 1
        done = k > se
        if done.any():
            blk = blk + done
            need |= done
            eob = np.maximum(eob - done, 0)
            k[done] = ss
            keep = blk < end
            if not keep.all():
                at, blk, end, k, eob, skip, fresh, need = (x[keep] for x in (at, blk, end, k, eob, skip, fresh, need))


def decode_files(files: list[bytes]) -> list[tuple[_File, list[np.ndarray]]]:
    """The headers of each file, and the coefficients of its components: blocks in raster order x 64, in zigzag order."""
    if not files:
        return []
    whole = b"".join(files)
    raw = np.frombuffer(whole, "uint8")
    ff = np.flatnonzero(raw[:-1] == 255)
    code = raw[ff + 1]
    ends = ff[(code != 0) & (code != 255) & ((code < 0xD0) | (code > 0xD7))]
    begin = np.concatenate([[0], np.cumsum([len(f) for f in files])])
    heads = [_File(f, int(b), ends) for f, b in zip(files, begin, strict=False)]
    number = max(len(h.parts) for h in heads)
    base = [np.concatenate([[0], np.cumsum([h.blocks[c][0] * h.blocks[c][1] if c < len(h.blocks) else 0 for h in heads])]) for c in range(number)]
    coef = [np.zeros((int(b[-1]), 64), "int16") for b in base]
    for step in range(max(len(h.scans) for h in heads)):
        groups: dict[tuple, list[int]] = {}
        for i, h in enumerate(heads):
            if step < len(h.scans):
                groups.setdefault(h.scans[step][0], []).append(i)
        for (cs, ss, se, ah, al, used), own in groups.items():
            size = [m[0] * m[1] for m in (heads[i].mcus(cs) for i in own)]
            todo = 0
            while todo < len(own):  # a bounded number of lanes at a time
                stop, n = todo, 0
                while stop < len(own) and (stop == todo or n + size[stop] <= LANES):
                    n += size[stop]
                    stop += 1
                _scan(raw, begin, heads, own[todo:stop], step, coef, base)
                todo = stop
    return [(h, [coef[c][base[c][i] : base[c][i + 1]] for c in range(len(h.parts))]) for i, h in enumerate(heads)]


def _scan(raw: np.ndarray, begin: np.ndarray, heads: list[_File], own: list[int], step: int, coef: list[np.ndarray], base: list[np.ndarray]) -> None:
    """Adds one scan of some files, which have it in common."""
    cs, ss, se, ah, al, used = heads[own[0]].scans[step][0]
    lanes = _Lanes(np.concatenate([raw[begin[i] + heads[i].scans[step][1] : begin[i] + heads[i].scans[step][2] + 2] for i in own]))
    across, total, every = [], [], []
    for i in own:
        a, d = heads[i].mcus(cs)
        across.append(a), total.append(a * d), every.append(heads[i].scans[step][3] or a * d)
    across, total, every = (np.array(x) for x in (across, total, every))
    n = -(-total // every)
    if len(lanes.begin) != n.sum():
        raise ValueError("missing restart intervals")
    file = np.repeat(np.arange(len(own)), n)
    within = np.arange(len(file)) - np.repeat(np.cumsum(n) - n, n)
    first = within * every[file]  # MCU of its file
    last = np.minimum(first + every[file], total[file])
    ids = np.array(own)
    if ss > 0:
        c = cs[0]
        stride = np.array([heads[i].blocks[c][0] for i in own])
        of = np.repeat(np.arange(len(own)), total)
        g = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
        place = base[c][ids][of] + g // across[of] * stride[of] + g % across[of]
        shift = (np.cumsum(total) - total)[file]
        _ac_decode(lanes, coef[c], place, first + shift, last + shift, ss, se, ah, al, _opened(used[0]))
        return
    at = lanes.begin.copy()
    pred = np.zeros((len(cs), len(at)), "int64")
    for m in range(int((last - first).max())):
        lane = np.flatnonzero(first + m < last)
        f = file[lane]
        y, x = np.divmod(first[lane] + m, across[f])
        for j, c in enumerate(cs):
            h, v = heads[own[0]].parts[c][1:3] if len(cs) > 1 else (1, 1)
            stride = np.array([heads[i].blocks[c][0] for i in own])
            for b in range(h * v):
                row = base[c][ids][f] + (y * v + b // h) * stride[f] + x * h + b % h
                if ah:
                    coef[c][row, 0] |= (lanes.bits(at[lane], 1) << al).astype("int16")
                    at[lane] += 1
                    continue
                t = _opened(used[j])[lanes.bits(at[lane], 16)]
                length, size = t >> 8, t & 255
                if not length.all():
                    raise ValueError("bad Huffman code")
                pred[j, lane] += _extend(lanes.bits(at[lane] + length, size), size)
                at[lane] += length + size
                coef[c][row, 0] = pred[j, lane] << al


def payload_of(head: _File, coef: list[np.ndarray]) -> bytes:
    """The payload that encode_payloads() put into the coefficients."""
    w, h = head.across, head.down
    y = coef[0].reshape(h, 2, w, 2, 64).transpose(0, 2, 1, 3, 4).reshape(w * h, 4, 64)
    whole = np.concatenate([y, coef[1][:, None], coef[2][:, None]], 1)
    return (whole.ravel()[: int(head.comment.split()[1])] + 128).astype("uint8").tobytes()


def planes(head: _File, coef: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of each component, at full resolution."""
    out = []
    for (_, h, v, q), c, (across, down) in zip(head.parts, coef, head.blocks, strict=True):
        x = (c * head.quant[q]).astype("float32") @ INVERSE + np.float32(128)
        x = np.clip(np.rint(x), 0, 255).reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
        if (head.hmax, head.vmax) != (h, v):
            x = x.repeat(head.vmax // v, 0).repeat(head.hmax // h, 1)
        out.append(x[: head.high, : head.wide])
    return out


def rgb(head: _File, coef: list[np.ndarray]) -> np.ndarray:
    """The picture as height x width x 3 samples."""
    p = planes(head, coef)
    if len(p) < 3:
        return np.repeat(p[0][:, :, None], 3, 2).astype("uint8")
    y, b, r = p[0], p[1] - np.float32(128), p[2] - np.float32(128)
    out = np.stack([y + np.float32(1.402) * r, y - np.float32(0.344136) * b - np.float32(0.714136) * r, y + np.float32(1.772) * b], 2)
    return np.clip(np.rint(out), 0, 255).astype("uint8")


def payload(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % UNIT or UNIT * (not text))


def _slices(items: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(items):
        end, size = at, 0
        while end < len(items) and (end == at or size + len(items[end]) <= BYTES):
            size += len(items[end])
            end += 1
        yield at, end
        at = end


def encode_column(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, media: the text as a progressive JPEG file."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            for s, e in _slices(raw):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, e - s), pa.array([len(x) for x in raw[s:e]], pa.int64()), pa.array(encode_payloads([payload(x) for x in raw[s:e]]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def decode_column(media: DataFrame, tensor: bool = True) -> DataFrame:
    """media: doc_id, n_bytes, media. Adds height, width, payload and, if asked for, rgb (height x width x 3 bytes)."""
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, media binary, height int, width int, payload binary" + ", rgb binary" * tensor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media").to_pylist()
            for s, e in _slices(files):
                got = decode_files(files[s:e])
                columns = [b.column(c).slice(s, e - s) for c in ("doc_id", "n_bytes", "media")]
                columns += [pa.array([h.high for h, _ in got], pa.int32()), pa.array([h.wide for h, _ in got], pa.int32()), pa.array([payload_of(h, c) for h, c in got], pa.binary())]
                columns += [pa.array([rgb(h, c).tobytes() for h, c in got], pa.binary())] * tensor
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "height", "width", "payload", *["rgb"] * tensor])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def features_column(media: DataFrame) -> DataFrame:
    """media: doc_id, n_bytes, media. Decodes and gives digests of what was read back, and a feature of the picture: its
    size, the mean of each colour and a checksum of the full-resolution RGB tensor."""
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def feature(head: _File, coef: list[np.ndarray]) -> str:
        x = rgb(head, coef)
        return f"{head.high}x{head.wide} {' '.join(f'{m:.3f}' for m in x.reshape(-1, 3).mean(0))} {zlib.crc32(x):08x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media").to_pylist()
            for s, e in _slices(files):
                got = decode_files(files[s:e])
                back = [payload_of(h, c) for h, c in got]
                columns = [
                    b.column("doc_id").slice(s, e - s), b.column("n_bytes").slice(s, e - s), pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()), pa.array([len(f) for f in files[s:e]], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files[s:e]]), pa.array([feature(h, c) for h, c in got]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
