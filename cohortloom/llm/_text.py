"""Vectorised word and shingle fingerprints over Arrow string columns.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A fingerprint is a 64-bit polynomial over the word's bytes,
finished by a multiply-xorshift mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._util import held

U8, U64 = np.uint8, np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = held("text")
    if len(kept.get("up", ())) < n:
        size = max(n, CHUNK + CHUNK // 8)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            kept[name] = np.cumprod(steps, dtype=U64)
    return kept["up"], kept["down"]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h + U64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], U8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, U8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def lowered(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) * U8(32)).astype(U8)


def word_bounds(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word; words end with their row."""
    body = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first, last = body.copy(), body.copy()
    first[1:] &= ~body[:-1]
    last[:-1] &= ~body[1:]
    full = off[:-1] < off[1:]
    first[off[:-1][full]] = body[off[:-1][full]]
    last[off[1:][full] - 1] = body[off[1:][full] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * up[: len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts], 1)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct fingerprints (uint64) of its k-word shingles; a shorter text is one shingle."""
    for at, end, data, off in chunks(texts):
        low = lowered(data)
        starts, ends, row = word_bounds(low, off)
        h = word_hashes(low, starts, ends)
        gram = np.zeros(len(h), U64)
        for i in range(k):
            if i < len(h):
                gram[: len(h) - i] = gram[: len(h) - i] * U64(0xA0761D6478BD642F) + h[i:]
        gram = mix(gram, 2)
        upto = np.searchsorted(row, np.arange(end - at + 1))
        for r in range(end - at):
            a, b = upto[r], upto[r + 1]
            if b - a >= k:
                yield np.unique(gram[a : b - k + 1])
            elif b > a:
                one = np.zeros(1, U64)
                for x in h[a:b]:
                    one = one * U64(0xE7037ED1A0B428DB) + x
                yield mix(one, 100 + int(b - a))
            else:
                yield np.zeros(0, U64)
