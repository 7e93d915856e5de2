"""Numpy arrays as binary cells, and the rolling hashes of byte operators."""

from __future__ import annotations

import io

import numpy as np
import zstandard


def pack_arrays(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return zstandard.compress(out.getvalue(), 1)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(bytes(blob))
    src, out = io.BytesIO(data), []
    while src.tell() < len(data):
        out.append(np.lib.format.read_array(src, allow_pickle=False))
    return out


#: A random word for each byte value, from a fixed seed.
BYTE_WORDS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` bytes, by doubling: the hash of a run is
    that of its first part times a power plus that of the rest."""
    if len(data) < k:
        return np.empty(0, np.uint64)
    level, width, out, used = BYTE_WORDS[data], 1, None, 0
    bits = k
    # the parts are put together from the smallest power of two upwards
    while True:
        if bits & 1:
            if out is None:
                out, used = level, width
            else:
                n = len(data) - (used + width) + 1
                out = out[:n] * np.uint64(pow(_MULTIPLIER, width, 1 << 64)) + level[used : used + n]
                used += width
        bits >>= 1
        if not bits:
            break
        level = level[:-width] * np.uint64(pow(_MULTIPLIER, width, 1 << 64)) + level[width:]
        width *= 2
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, width = x, 1
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (w - width)], out[w - width :]) if width < w else out


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of a union of intervals; touching ones join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:] - 1, len(e) - 1)]
