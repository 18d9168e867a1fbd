"""Lossless WebP media columns.

`decode` reads a lossless WebP file: prefix codes, back-references, colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. `encode` writes one with the same tools: a palette where pixels repeat enough,
else a predictor, cross-colour and subtract-green (its caller says which); back-references where long stretches recur,
else a colour cache where single pixels do; and prefix codes by the counts of the symbols.

Code lengths at all bit positions of a window are looked up with array operations; only the walk from pixel to pixel is
a loop, over bytes. A text of n bytes takes about 30 n bytes of memory.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._util import documents, mapped

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
LITERALS, LENGTHS, DISTANCES, CACHE_HASH, SIDE = 256, 24, 40, 0x1E35A7BD, 16384
SPAN = 1 << 18  # bytes of a file that are looked up at a time
PREDICTOR, CROSS, GREEN, PALETTE = range(4)


class Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        got = (int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return got


class Code:
    """A canonical prefix code; a lone symbol takes no bits."""

    def __init__(self, lengths: np.ndarray | None, lone: int | None = None) -> None:
        self.lone, self.most, self.tables, self.wide = lone, 0, None, {}
        if lone is not None:
            return
        used = lengths.nonzero()[0]
        if len(used) == 1:
            self.lone = int(used[0])
            return
        order = used[lengths[used].argsort(kind="stable")]
        self.symbols, self.lens = order, lengths[order]
        self.most = int(self.lens[-1]) if len(order) else 0
        if int((1 << (self.most - self.lens)).sum()) != 1 << self.most:
            raise ValueError("incomplete prefix code")

    def table(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for each value of the next `width` bits, first bit lowest."""
        if self.lone is not None:
            return np.full(1 << width, self.lone, np.uint16), np.zeros(1 << width, np.uint8)
        if width not in self.wide:
            which = np.arange(len(self.lens)).repeat(1 << (width - self.lens))[_turned(width)]
            self.wide[width] = self.symbols.astype(np.uint16)[which], self.lens.astype(np.uint8)[which]
        return self.wide[width]

    def read(self, bits: Bits) -> int:
        if self.lone is not None:
            return self.lone
        if self.tables is None:
            self.tables = tuple(x.tolist() for x in self.table(self.most))
        at = bits.at
        value = (int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & ((1 << self.most) - 1)
        bits.at = at + self.tables[1][value]
        return self.tables[0][value]


def _turned(width: int) -> np.ndarray:
    """Numbers of `width` bits with their bits in the other order."""
    if width not in _turns:
        out = np.zeros(1, np.int64)
        for _ in range(width):
            out = np.concatenate([out * 2, out * 2 + 1])
        _turns[width] = out
    return _turns[width]


_turns: dict[int, np.ndarray] = {}


def _read_code(bits: Bits, size: int, met: dict | None = None) -> Code:
    """met: codes of plain lengths that this file has held before."""
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        one = bits.read(8 if wide else 1)
        if not two:
            return Code(None, one)
        lengths = np.zeros(size, np.int64)
        lengths[[one, bits.read(8)]] = 1
        return Code(lengths)
    head, width = _plain_head()
    if (int.from_bytes(bits.data[(bits.at - 1) >> 3 : ((bits.at - 1) >> 3) + 9], "little") >> ((bits.at - 1) & 7)) & ((1 << width) - 1) == head:
        inner, bits.at = PLAIN, bits.at - 1 + width
    else:
        inner, n = [0] * 19, 4 + bits.read(4)
        for s in LENGTH_ORDER[:n]:
            inner[s] = bits.read(3)
    left = size
    if bits.read(1):
        width = 2 + 2 * bits.read(3)
        left = 2 + bits.read(width)
    if inner == PLAIN:  # every length stands in four bits, first bit highest
        n = min(left, size)
        first, end = bits.at, bits.at + 4 * n
        value = (int.from_bytes(bits.data[first >> 3 : (end + 7) >> 3], "little") >> (first & 7)) & ((1 << 4 * n) - 1)
        bits.at = end
        met = {} if met is None else met
        if (n, value) not in met:
            pairs = np.frombuffer(value.to_bytes((n + 1) // 2, "little"), np.uint8)
            lengths = np.zeros(2 * len(pairs), np.int64)
            lengths[::2], lengths[1::2] = _turned(4)[pairs & 15], _turned(4)[pairs >> 4]
            met[n, value] = Code(lengths)
        return met[n, value]
    code, lengths = Code(np.array(inner)), np.zeros(size, np.int64)
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before, at = s or before, at + 1
        else:
            n, what = (3 + bits.read(2), before) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            lengths[at : at + n] = what
            at += n
    return Code(lengths)


#: Code lengths of the code that writes plain lengths of four bits each.
PLAIN = [4] * 16 + [0] * 3


def _value(bits: Bits, s: int) -> int:
    """A length or distance from its prefix symbol."""
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as uint32 ARGB in a flat array."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    zone_bits, zones = 0, None
    if main and bits.read(1):
        zone_bits = bits.read(3) + 2
        across = -(-width >> zone_bits) if width else 0
        zones = (_pixels(bits, across, -(-height >> zone_bits), False) >> 8) & 0xFFFF
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    met: dict = {}
    groups = [[_read_code(bits, n, met) for n in sizes] for _ in range(int(zones.max()) + 1 if zones is not None else 1)]
    total = width * height
    if len(groups) == 1:
        return _one_group(bits, groups[0], total, width, cache_bits)
    out, cache = [], [0] * (1 << cache_bits)

    def add(p: int) -> None:
        out.append(p)
        if cache_bits:
            cache[(CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while len(out) < total:
        x, y = len(out) % width, len(out) // width
        green, red, blue, alpha, far = groups[zones[(y >> zone_bits) * across + (x >> zone_bits)] if zones is not None else 0]
        s = green.read(bits)
        if s < LITERALS:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            add(a << 24 | r << 16 | s << 8 | b)
        elif s < LITERALS + LENGTHS:
            n, d = _value(bits, s - LITERALS), _distance(_value(bits, far.read(bits)), width)
            for _ in range(n):
                add(out[-d])
        else:
            add(cache[s - LITERALS - LENGTHS])
    return np.array(out[:total], np.uint32)


def _distance(code: int, width: int) -> int:
    return code - len(NEAR) if code > len(NEAR) else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def _one_group(bits: Bits, codes: list[Code], total: int, width: int, cache_bits: int) -> np.ndarray:
    """Pixels where one group of codes holds for all of them."""
    if all(c.lone is not None for c in codes[:4]) and codes[0].lone < LITERALS:
        green, red, blue, alpha = (c.lone for c in codes[:4])
        return np.full(total, alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    most = max(1, *(c.most for c in codes[:4]))
    tables = [c.table(most) for c in codes[:4]]
    special = tables[0][1] | ((tables[0][0] >= LITERALS).astype(np.uint8) << 7)
    values, copies, hits, n, place = [], [], [], 0, 0  # place: literals so far, for the pixels that are none
    known = np.ones(total, bool)
    while n < total:
        base = bits.at >> 3
        raw = np.frombuffer(bits.data[base : base + SPAN + 8].ljust(SPAN + 8 if len(bits.data) - base > SPAN else len(bits.data) - base + 8, b"\0"), np.uint8).astype(np.uint32)
        wide = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        value = ((wide[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << most) - 1)).astype(np.uint16).reshape(-1)
        each = {id(c): t[1] for c, t in zip(codes[1:4], tables[1:], strict=True)}  # equal codes are one object
        each = {k: t[value].tobytes() for k, t in each.items()}
        green, (red, blue, alpha) = special[value].tobytes(), (each[id(c)] for c in codes[1:4])
        p, limit, starts = bits.at - 8 * base, len(value) - 160, []
        add = starts.append
        if len(bits.data) - base <= SPAN:
            limit = len(value)
        while n < total and p < limit:
            sure, before = min(total - n, 1 + (limit - 1 - p) // (4 * most)), len(starts)  # so many pixels begin before the limit
            for _ in range(sure):
                step = green[p]
                if step > 127:
                    break
                add(p)
                p += step
                p += red[p]
                p += blue[p]
                p += alpha[p]
            n += len(starts) - before
            if n == total or p >= limit or green[p] < 128:
                continue
            step = green[p]
            s = int(tables[0][0][value[p]])
            p += step & 127
            if s >= LITERALS + LENGTHS:
                hits.append((n, s - LITERALS - LENGTHS))
                n += 1
            else:
                bits.at = 8 * base + p
                length = _value(bits, s - LITERALS)
                copies.append((n, length, _distance(_value(bits, codes[4].read(bits)), width)))
                p = bits.at - 8 * base
                n += length
        bits.at = 8 * base + p
        at = np.array(starts, np.int64)
        pixel = np.zeros(len(at), np.uint32)
        for (symbols, lens), shift in zip(tables, (8, 16, 0, 24), strict=True):
            now = value[at]
            pixel |= symbols[now].astype(np.uint32) << np.uint32(shift)
            at += lens[now]
        values.append(pixel)
    for i, length, _ in copies:
        known[i : i + length] = False
    if hits:
        known[[i for i, _ in hits]] = False
    out = np.zeros(total, np.uint32)
    out[known] = np.concatenate(values) if values else out[:0]
    if hits and copies:
        return _with_both(out, known, copies, dict(hits), cache_bits)
    for i, length, d in copies:
        length = min(length, total - i)
        out[i : i + length] = out[i - d : i - d + length] if d >= length else np.resize(out[i - d : i], length)
    if hits:
        key = _slots(out, cache_bits)
        where, slot = np.array(hits).T
        key[where] = slot
        order = np.argsort(key.astype(np.uint16), kind="stable")  # a radix sort
        last = np.maximum.accumulate(np.where(known[order], np.arange(total), -1))
        source = order[np.maximum(last, 0)]
        full = np.where((last >= 0) & (key[source] == key[order]), out[source], np.uint32(0))
        out[order] = full
    return out


def _slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((pixels * np.uint32(CACHE_HASH)) >> np.uint32(32 - cache_bits)).astype(np.int64)


def _with_both(out: np.ndarray, known: np.ndarray, copies: list, hits: dict[int, int], cache_bits: int) -> np.ndarray:
    pixels, cache, i, jobs = out.tolist(), [0] * (1 << cache_bits), 0, {i: (n, d) for i, n, d in copies}
    while i < len(pixels):
        n, d = jobs.get(i, (1, 0))
        for j in range(i, min(i + n, len(pixels))):
            if d:
                pixels[j] = pixels[j - d]
            elif not known[j]:
                pixels[j] = cache[hits[j]]
            cache[(CACHE_HASH * pixels[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[j]
        i += n
    return np.array(pixels, np.uint32)


def _split(p: np.ndarray) -> np.ndarray:
    """Pixels as rows of alpha, red, green, blue (int32)."""
    return np.stack([(p >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left, top, corner, right):
    """The prediction from the neighbours (arrays of four channels): left, top, top-left, top-right."""
    mean = lambda a, b: (a + b) >> 1
    clip = lambda a: np.clip(a, 0, 255)
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 13:
        m = mean(left, top)
        return clip(m + np.trunc((m - corner) / 2).astype(np.int32))
    return (
        np.array([255, 0, 0, 0], np.int32) if mode in (0, 14, 15) else left if mode == 1 else top if mode == 2 else right if mode == 3 else corner if mode == 4
        else mean(mean(left, right), top) if mode == 5 else mean(left, corner) if mode == 6 else mean(left, top) if mode == 7 else mean(corner, top) if mode == 8
        else mean(top, right) if mode == 9 else mean(mean(left, corner), mean(top, right)) if mode == 10 else clip(left + top - corner)
    )


def _undo_bands(p: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    """Bands of rows that are predicted from the left or from above throughout: running sums."""
    c = p.copy().view(np.uint8).reshape(height, width, 4)  # blue, green, red, alpha
    c[0, 0, 3:] += np.uint8(255)
    c[0] = np.cumsum(c[0], axis=0, dtype=np.uint8)
    for band, mode in enumerate(modes.tolist()):
        first, end = max(1, band << bits), min(height, (band + 1) << bits)
        if first >= end:
            continue
        if mode == 2:
            c[first - 1 : end] = np.cumsum(c[first - 1 : end], axis=0, dtype=np.uint8)
        else:
            c[first - 1 : end, 0] = np.cumsum(c[first - 1 : end, 0], axis=0, dtype=np.uint8)
            c[first:end] = np.cumsum(c[first:end], axis=1, dtype=np.uint8)
    return c.reshape(-1).view(np.uint32)


def _undo_predictor(p: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    grid = ((modes >> np.uint32(8)) & np.uint32(15)).reshape(-(-height >> bits), -(-width >> bits))
    if (grid == grid[:, :1]).all() and ((grid[:, 0] == 1) | (grid[:, 0] == 2)).all():
        return _undo_bands(p, width, height, bits, grid[:, 0])
    c, across = _split(p), -(-width >> bits)
    for i in range(width * height):
        x, y = i % width, i // width
        if i == 0:
            guess = np.array([255, 0, 0, 0])
        elif y == 0:
            guess = c[i - 1]
        elif x == 0:
            guess = c[i - width]
        else:
            mode = int(modes[(y >> bits) * across + (x >> bits)] >> 8) & 15
            guess = predicted(mode, c[i - 1], c[i - width], c[i - width - 1], c[i - width + 1])
        c[i] = (c[i] + guess) & 255
    return _join(c)


def _cross(rows: np.ndarray, green_red: int, green_blue: int, red_blue: int, put) -> None:
    """Add or subtract what green tells of red and both of blue; rows are blue, green, red, alpha bytes."""
    signed = lambda x: x.view(np.int8).astype(np.int16)
    part = lambda k, x: ((k * x) >> 5).astype(np.uint8)
    green, before = signed(rows[..., 1].copy()), signed(rows[..., 2].copy())
    rows[..., 2] = put(rows[..., 2], part(green_red, green))
    red = signed(rows[..., 2].copy()) if put is np.add else before
    rows[..., 0] = put(rows[..., 0], part(green_blue, green))
    rows[..., 0] = put(rows[..., 0], part(red_blue, red))


def _undo_cross(p: np.ndarray, width: int, height: int, bits: int, table: np.ndarray) -> np.ndarray:
    if width <= 1 << bits:
        c = p.copy().view(np.uint8).reshape(height, width, 4)
        for band, (_, red_blue, green_blue, green_red) in enumerate(_split(table).astype(np.uint8).view(np.int8).astype(np.int16).tolist()):
            rows = c[band << bits : (band + 1) << bits]
            _cross(rows, green_red, green_blue, red_blue, np.add)
        return c.reshape(-1).view(np.uint32)
    y, x = np.divmod(np.arange(width * height), width)
    signed = lambda a: ((a + 128) & 255) - 128
    t = signed(_split(table)[(y >> bits) * -(-width >> bits) + (x >> bits)])
    c = _split(p)
    green = signed(c[:, 2])
    c[:, 1] = (c[:, 1] + (t[:, 3] * green >> 5)) & 255
    c[:, 3] = (c[:, 3] + (t[:, 2] * green >> 5) + (t[:, 1] * signed(c[:, 1]) >> 5)) & 255
    return _join(c)


def _undo_green(p: np.ndarray) -> np.ndarray:
    c = p.copy().view(np.uint8).reshape(-1, 4)
    c[:, 0] += c[:, 1]
    c[:, 2] += c[:, 1]
    return c.reshape(-1).view(np.uint32)


def _undo_palette(p: np.ndarray, width: int, height: int, bits: int, colours: np.ndarray) -> np.ndarray:
    each = 1 << bits
    index = ((p >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
    n = 8 >> bits
    spread = np.stack([(index >> np.uint32(i * n)) & np.uint32((1 << n) - 1) for i in range(each)], axis=-1).reshape(height, -1)[:, :width]
    full = np.concatenate([colours, np.zeros(256, np.uint32)])[: max(256, len(colours))]
    return full[spread].reshape(-1)


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels): pixels as height x width x 4 bytes of red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            n = bits.read(3) + 2
            undo.append((kind, inner, n, _pixels(bits, -(-inner >> n), -(-height >> n), False)))
        elif kind == GREEN:
            undo.append((kind, inner, 0, None))
        else:
            size = bits.read(8) + 1
            steps = _split(_pixels(bits, size, 1, False))
            n = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, inner, n, _join(np.cumsum(steps, axis=0))))
            inner = -(-inner >> n)
    p = _pixels(bits, inner, height, True)
    for kind, w, n, extra in reversed(undo):
        p = _undo_predictor(p, w, height, n, extra) if kind == PREDICTOR else _undo_cross(p, w, height, n, extra) if kind == CROSS else _undo_green(p) if kind == GREEN else _undo_palette(p, w, height, n, extra)
    return width, height, np.ascontiguousarray(p).view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]


class Writer:
    """Bits, first bit lowest: single values, or arrays of values of up to 64 bits each."""

    def __init__(self) -> None:
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        """values hold no bit beyond their widths."""
        rest = self.n & 7
        whole = self.value & ((1 << (self.n - rest)) - 1)
        self.parts.append(whole.to_bytes(self.n >> 3, "little"))
        self.value >>= self.n - rest
        ends = np.cumsum(widths) + rest
        at = ends - widths
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2 if len(ends) else 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(first):
            out[word[first]] = np.add.reduceat(values << shift, first)
            out[word[first] + 1] += np.add.reduceat(np.where(shift > 0, values >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0)), first)
        n = int(ends[-1]) if len(ends) else rest
        out[0] |= np.uint64(self.value)
        body = out.tobytes()[: -(-n // 8)]
        self.parts.append(body[: n >> 3])
        self.value, self.n = (body[n >> 3] if n & 7 else 0), n & 7

    def data(self) -> bytes:
        return b"".join([*self.parts, self.value.to_bytes(-(-self.n // 8), "little")])


def code_lengths(counts: np.ndarray, limit: int = 10) -> np.ndarray:
    """Lengths of a complete prefix code of at most `limit` bits: near the symbols' information, then evened out."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used if len(used) else [0]] = 1
        return out
    c = counts[used]
    lens = np.clip(np.ceil(np.log2(c.sum() / c)), 1, limit).astype(np.int64)
    order, room = np.argsort(-c, kind="stable").tolist(), (1 << limit) - int((1 << (limit - lens)).sum())
    lens = lens.tolist()
    for i in reversed(order):  # too many short codes: lengthen the rarest
        while room < 0 and lens[i] < limit:
            lens[i] += 1
            room += 1 << (limit - lens[i])
    while room:
        for i in order:  # room left: shorten the most frequent that fit
            if lens[i] > 1 and 1 << (limit - lens[i]) <= room:
                room -= 1 << (limit - lens[i])
                lens[i] -= 1
    out[used] = lens
    return out


def _codes_of(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's canonical code, first bit lowest."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.uint64)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    most = int(n[-1])
    high = np.cumsum(1 << (most - n)) - (1 << (most - n))  # the code, in the highest of `most` bits
    out[order] = _turned(most)[high]
    return out


@functools.cache
def _plain_head() -> tuple[int, int]:
    """What stands before plain lengths: not a simple code, 19 lengths of the inner code."""
    head = Writer()
    head.put(0, 1)
    head.put(19 - 4, 4)
    for s in LENGTH_ORDER:
        head.put(PLAIN[s], 3)
    return head.value, head.n


def _put_lengths(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        out.put(1 | 1 << 2 | int(used[0]) << 3, 11)
        return
    out.put(*_plain_head())
    left = max(2, int(used[-1]) + 1)
    left += left & 1
    out.put(1, 1)
    out.put(4, 3)
    out.put(left - 2, 10)
    nibble = _turned(4)[lengths[:left]].astype(np.uint8) if left <= len(lengths) else np.append(_turned(4)[lengths].astype(np.uint8), np.uint8(0))
    out.put(int.from_bytes((nibble[::2] | nibble[1::2] << 4).tobytes(), "little"), 4 * left)


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and their value of lengths or distances from 1."""
    v = v - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    half = (v >> np.maximum(top - 1, 0)) & 1
    wide = v >= 4
    extra = np.where(wide, top - 1, 0)
    return np.where(wide, 2 * top + half, v), extra, np.where(wide, v - ((2 + half) << extra), 0)


def _fours(q: np.ndarray) -> np.ndarray:
    """A number for each four pixels (uint64) that follow one another."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return ((q[:-3] * step + q[1:-2]) * step + q[2:-1]) * step + q[3:]


def repeats(p: np.ndarray) -> int:
    """How many fours occurred before; matches hold four pixels for each of them at most."""
    n = 0
    for base in range(0, len(p), REACH):
        key = np.sort(_fours(p[base : base + REACH].astype(np.uint64))) if len(p) - base >= 8 else np.zeros(0, np.uint64)
        n += np.count_nonzero(key[1:] == key[:-1])
    return n


def matches(p: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches of four pixels or more that occurred before; none overlap."""
    found: list[tuple[int, int, int]] = []
    for base in range(0, len(p), REACH):
        q = p[base : base + REACH].astype(np.uint64)
        if len(q) < 8:
            continue
        key = _fours(q)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        d = np.zeros(len(key), np.int64)
        d[order[1:][same]] = (order[1:] - order[:-1])[same]
        first = np.flatnonzero(np.diff(d, prepend=0) != 0)
        first = first[d[first] > 0]
        if not len(first):
            continue
        ends = np.flatnonzero(np.diff(d, append=0) != 0)
        ends = ends[d[ends] > 0]
        at = 0
        for i, e, dist in zip(first.tolist(), (ends + 4).tolist(), d[first].tolist(), strict=True):
            i = max(i, at)
            if e - i >= 4 and (q[i:e] == q[i - dist : e - dist]).all():
                found += [(base + j, min(e - j, 4096), dist) for j in range(i, e, 4096)]
                at = e
    return found


REACH, CACHE_BITS = 1 << 18, 6


def _put_pixels(out: Writer, p: np.ndarray, main: bool) -> str:
    """Write pixels with back-references, a colour cache or neither; returns which."""
    c = p.view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha
    if len(p) == 1 or (p == p[0]).all():  # four lone symbols
        out.put(0, 1 + main)
        for symbol in (*c[0, [1, 2, 0, 3]].tolist(), 0):
            out.put(1 | 1 << 2 | symbol << 3, 11)
        return "plain"
    literal, copies, hit, cache_bits = np.ones(len(p), bool), [], None, 0
    if main:
        copies = matches(p) if 64 * repeats(p) >= len(p) else []
        if 16 * sum(n for _, n, _ in copies) < len(p):
            copies = []
            key = _slots(p, CACHE_BITS)
            order = np.argsort(key.astype(np.uint8), kind="stable")
            again = np.zeros(len(p), bool)
            again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
            if 32 * again.sum() >= len(p):
                hit, cache_bits, literal = again, CACHE_BITS, ~again
    for i, n, _ in copies:
        literal[i : i + n] = False
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    start = literal if hit is None else np.ones(len(p), bool)
    green = c[:, 1].astype(np.int64)
    if copies:
        where, length, dist = np.array(copies, np.int64).T
        start[where] = True
        symbol, extra, rest = _prefix(length)
        far, far_extra, far_rest = _prefix(dist + len(NEAR))
        green[where] = LITERALS + symbol
        plain = literal.copy()
        plain[where] = False
    else:
        plain = literal
    if hit is not None:
        green[hit] = LITERALS + LENGTHS + key[hit]
    at = start.nonzero()[0]
    real = plain[at]
    some = c[at[real]]
    counts = [np.bincount(green[at], minlength=LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0))]
    counts.append(np.bincount(some[:, [0, 2, 3]].ravel(), minlength=256))  # red, blue and alpha share their code
    lengths = [code_lengths(x) for x in counts]
    for x in (lengths[0], *lengths[1:] * 3):
        _put_lengths(out, x)
    codes = [_codes_of(x) for x in lengths]
    bits = [np.where((x > 0).sum() > 1, x, 0) for x in lengths]
    if copies:
        lengths.append(code_lengths(np.bincount(far, minlength=DISTANCES)))
        _put_lengths(out, lengths[2])
        codes.append(_codes_of(lengths[2]))
        bits.append(np.where((lengths[2] > 0).sum() > 1, lengths[2], 0))
    else:
        out.put(1 | 1 << 2, 11)
    value, width = codes[0][green[at]], bits[0][green[at]]
    every = real.all()
    for channel in (2, 0, 3):
        s = c[at, channel]
        v, w = codes[1][s] << width.astype(np.uint64), bits[1][s]
        value, width = (value | v, width + w) if every else (value | np.where(real, v, np.uint64(0)), width + np.where(real, w, 0))
    if copies:
        slot = np.searchsorted(at, where)
        v, w = value[slot], width[slot]
        for more, n in ((rest, extra), (codes[2][far], bits[2][far]), (far_rest, far_extra)):
            v = v | more.astype(np.uint64) << w.astype(np.uint64)
            w = w + n
        value[slot], width[slot] = v, w
    out.put_all(value, width)
    return "copies" if copies else "cache" if cache_bits else "plain"


def _guessed(c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences from the pixel to the left (mode 1) or above (mode 2), by bands of rows, whichever are smaller."""
    height = len(c)
    left, above = c.copy(), c.copy()
    left[:, 1:] -= c[:, :-1]
    left[1:, 0] -= c[:-1, 0]
    above[1:] -= c[:-1]
    above[0] = left[0]
    for x in (left, above):
        x[0, 0, 3:] -= np.uint8(255)
    size = lambda x: np.add.reduceat(np.abs(x.view(np.int8).astype(np.int32)).sum(axis=(1, 2)), np.arange(0, height, 1 << bits))
    modes = np.where(size(left) < size(above), 1, 2)
    return np.where(np.repeat(modes, 1 << bits)[:height, None, None] == 1, left, above), modes


TILE = 9  # transform tiles are 512 pixels wide and high


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (PREDICTOR, CROSS, GREEN)) -> tuple[bytes, list[str]]:
    """A lossless WebP file of height x width x 4 bytes (red, green, blue, alpha), and the names of the tools it uses.

    The image gets a palette if it has at most 256 colours, half as many as pixels; else the given transforms in order.
    """
    height, width = pixels.shape[:2]
    out, used, plain = Writer(), [], np.uint32(0xFF000000)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    c = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]])
    p = c.reshape(-1).view(np.uint32)
    first = np.sort(p[:1024])
    few = np.count_nonzero(first[1:] != first[:-1]) < min(256, len(p))  # else the whole has more than 256 colours
    colours = np.unique(p) if few else first
    tiles = lambda value: [_put_pixels(out, value, False)]
    if len(colours) <= 256 and 2 * len(colours) <= len(p):
        n = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))
        tiles(np.ascontiguousarray(steps).reshape(-1).view(np.uint32))
        across = -(-width >> n)
        index = np.zeros((height, across << n), np.uint32)
        index[:, :width] = np.searchsorted(colours, p).reshape(height, width)
        index = index.reshape(height, across, 1 << n) << (np.arange(1 << n, dtype=np.uint32) * np.uint32(8 >> n))
        p = (plain | index.sum(axis=2).astype(np.uint32) << np.uint32(8)).reshape(-1)
        used.append("palette")
    else:
        for kind in transforms:
            out.put(1 | kind << 1, 3)
            if kind == GREEN:
                c = c.copy()
                c[..., 0] -= c[..., 1]
                c[..., 2] -= c[..., 1]
                used.append("green")
                continue
            out.put(TILE - 2, 3)
            bands, across = -(-height >> TILE), -(-width >> TILE)
            if kind == PREDICTOR:
                c, modes = _guessed(c, TILE)
                tiles(np.repeat(plain | modes.astype(np.uint32) << np.uint32(8), across))
                used += [f"predictor{m}" for m in sorted(set(modes.tolist()))]
            else:
                c, table = c.copy(), []
                for band in range(bands):
                    rows = c[band << TILE : (band + 1) << TILE]
                    blue, green, red = (rows[..., i].view(np.int8).astype(np.float64).ravel() for i in (0, 1, 2))
                    fit = lambda a, b: int(np.clip(np.rint(32 * (a @ b) / max(1.0, a @ a)), -128, 127))
                    ks = (fit(green, red), fit(green, blue), 0)
                    _cross(rows, *ks, np.subtract)
                    table.append(plain | np.uint32((ks[0] & 255) | (ks[1] & 255) << 8 | (ks[2] & 255) << 16))
                tiles(np.repeat(np.array(table, np.uint32), across))
                used.append("cross")
        p = np.ascontiguousarray(c).reshape(-1).view(np.uint32)
    out.put(0, 1)
    used.append(_put_pixels(out, p, True))
    data = b"\x2f" + out.data()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk, used


#: Transforms of an image that gets no palette, by its payload's checksum, so that a table's files hold all of them.
CHAINS = ((PREDICTOR, CROSS), (CROSS, GREEN), (GREEN, PREDICTOR), (PREDICTOR, CROSS, GREEN))


#: Bytes of a payload that one image holds; a longer payload becomes several files behind one another.
IMAGE_BYTES = 16 << 20


def stored(payload: bytes) -> tuple[bytes, list[str]]:
    """A payload of a positive multiple of 64 bytes as an image, 16 pixels a row where the format's height allows it, and
    the tools it uses."""
    rows = len(payload) // 64
    width = 16 * -(-rows // SIDE)
    height = -(-len(payload) // (4 * width))
    if width > SIDE:
        raise ValueError("payload beyond one image")
    pixels = np.frombuffer(payload.ljust(4 * width * height, b"\0"), np.uint8).reshape(height, width, 4)
    return encode(pixels, CHAINS[zlib.crc32(payload) % len(CHAINS)])


def images(payload: bytes, most: int = IMAGE_BYTES) -> Iterator[tuple[bytes, list[str]]]:
    """The files of a payload, each of `most` bytes of it (a multiple of 64) but the last, with the tools they use."""
    if most < 64 or most % 64:
        raise ValueError("an image holds a positive multiple of 64 bytes")
    view = memoryview(payload)
    for at in range(0, len(payload), most):
        yield stored(bytes(view[at : at + most]))


def split_files(media: bytes) -> list[bytes]:
    """Files that lie behind one another, told apart by their own sizes."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] != b"RIFF" or at + size > len(media):
            raise ValueError("not a file where one should start")
        out.append(media[at : at + size])
        at += size
    return out


def media(docs: DataFrame, keep_file: bool = False, image_bytes: int = IMAGE_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    tools[, media].

    Every figure after n_bytes but the last columns' comes from the stored files as read back; tools names what the files
    use. A null text is empty: 64 zero bytes. A text of more than image_bytes bytes is stored as several images behind one
    another (split_files takes them apart), one in memory at a time. Repeated rows give repeated rows, an empty table an
    empty result; other columns are ignored.
    """

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        back, whole, counts = hashlib.sha256(), hashlib.sha256(), np.zeros(256, np.int64)
        read, length, tail, shapes, used, files = 0, 0, b"", [], {}, []
        for file, tools in images(raw.ljust(size, b"\0"), image_bytes):
            width, height, pixels = decode(file)
            piece = pixels.tobytes()[: min(image_bytes, size - read)]
            back.update(piece)
            whole.update(file)
            counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
            read, length, tail = read + len(piece), length + len(file), piece[-64:]
            shapes.append(f"{width}x{height}")
            used |= dict.fromkeys(tools)
            if keep_file:
                files.append(file)
        mean = float(counts @ np.arange(256)) / size
        spread = max(0.0, float(counts @ np.arange(256) ** 2) / size - mean * mean) ** 0.5
        feature = f"{'+'.join(shapes)};mean={mean:.3f};std={spread:.3f};values={int((counts > 0).sum())}"
        return len(raw), read, back.hexdigest(), zlib.crc32(tail), length, whole.hexdigest(), feature, ",".join(used), b"".join(files)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())[: 9 if keep_file else 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                cols = zip(*[one(t.as_py()) for t in part.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=["doc_id", *NAMES[: len(kinds)]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tools string"
    return mapped(docs.select("doc_id", "text"), run, schema + (", media binary" if keep_file else ""))


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tools", "media")


def op8_webp(spark, sf_dir):
    return media(documents(spark, sf_dir))


SQL: dict[str, str] = {}
