"""Vectorised scanning of Arrow text columns: words, word hashes and window hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` and are never changed.  Every function works on one
*slice* of an Arrow batch (a few megabytes of UTF-8 bytes with document offsets), so the
memory of a task doesn't depend on the size of a partition.  One document is never split,
so the bound is the slice size or the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (base is odd)."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    up, down = _powers(base, size)
    return up[:n], down[:n]


#: A random 64-bit value for each byte, from the finaliser.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4D, 0x27D4EB2F165667C5


class Slice(NamedTuple):
    """Documents ``row .. row + n`` of a batch: their bytes and n + 1 offsets into them."""

    row: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string or binary column into slices of about ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Slice(lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


class Words(NamedTuple):
    """Words of a slice: byte bounds, and for each document the index of its first word (n + 1)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(s: Slice) -> Words:
    n = len(s.data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(s.offsets), np.int64))
    space = _SPACE[s.data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = space[:-1]
    edge[s.offsets] = True
    start = np.flatnonzero(edge[:n] & ~space)
    edge[:n] = space
    edge[n] = True
    edge[s.offsets] = True
    end = np.flatnonzero(edge[1:] & ~space) + 1
    return Words(start, end, np.searchsorted(start, s.offsets))


def word_hashes(s: Slice, w: Words) -> np.ndarray:
    n = len(s.data)
    if not len(w.start):
        return np.zeros(0, np.uint64)
    up, down = powers(BYTE_BASE, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[s.data] * up, out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start])


def window_hashes(h: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of ``h[i : i + size]`` for every i that leaves room; windows may cross documents."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[size:] - total[: n - size + 1]) * down[: n - size + 1])


def whole_windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that stay inside a document, and the document of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return ranges(first[:-1], counts), doc


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] values), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.concatenate(([0], np.cumsum(count)[:-1]))
    return np.arange(total, dtype=np.int64) + np.repeat(start - shift, count)


def shingles(h: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every document, and the document of each.

    A document of 1 to size - 1 words has one shingle, all its words; one without words has none.
    """
    at, doc = whole_windows(first, size)
    out = window_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.array([window_hashes(h[first[i] : first[i + 1]], int(n[i]))[0] for i in short], dtype=np.uint64)
        extra = mix(extra + n[short].astype(np.uint64))
        out, doc = np.concatenate((out, extra)), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc
