"""Arrays as compressed bytes, for rows that carry many numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CODEC = pa.Codec("zstd", compression_level=1)
TYPES = [np.dtype(t) for t in ("bool", "uint8", "int32", "int64", "uint64", "float32", "float64")]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays by the places of their bytes, compressed."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""
        body = CODEC.compress(raw, asbytes=True) if raw else b""
        out += [np.array([len(a), TYPES.index(a.dtype), len(body)], np.int64).tobytes(), body]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, kind, size = np.frombuffer(blob, np.int64, 3, at).tolist()
        dtype = TYPES[kind]
        raw = CODEC.decompress(blob[at + 24 : at + 24 + size], n * dtype.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
        at += 24 + size
    return out
