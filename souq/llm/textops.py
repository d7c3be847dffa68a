"""Vectorised word and shingle hashing over Arrow string columns (numpy only).

Texts are handled as the UTF-8 bytes of a whole Arrow batch at once, in slices
of about ``SLICE_BYTES``, so the temporary arrays stay bounded; a single text
longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)  # 64-bit finaliser constants
_P = U(0x9E3779B97F4A7C15)

#: word separators: space, tab, LF, VT, FF, CR
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

# a random 64-bit value for each (lower-cased) byte
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]


def fmix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(33))
    x = x * _M1
    x ^= x >> U(33)
    x = x * _M2
    x ^= x >> U(33)
    return x


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _P, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Slice:
    """Some consecutive texts of a batch: bytes, and where each text begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1


def slices(column: pa.Array) -> Iterator[Slice]:
    """Split a string column into slices; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        yield Slice(i, buf[offsets[i]:offsets[j]], (offsets[i:j + 1] - offsets[i]))
        i = j


def word_bounds(s: Slice, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word (n + 1 entries)."""
    is_sep = sep[s.data]
    if not len(is_sep):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(s.n + 1, np.int64)
    edge = np.zeros(len(is_sep) + 1, bool)  # a text's end cuts words like a separator
    edge[s.offsets] = True
    word = ~is_sep
    before = np.empty(len(is_sep), bool)
    before[0], before[1:] = True, is_sep[:-1]
    before |= edge[:-1]
    after = np.empty(len(is_sep), bool)
    after[-1], after[:-1] = True, is_sep[1:]
    after |= edge[1:]
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, s.offsets)


def word_hashes(s: Slice, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes (A-Z lower-cased unless told otherwise)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    value = (_BYTE_LOWER if lower else _BYTE)[s.data]
    at = np.zeros(len(value), np.int32)
    at[starts] = starts
    np.maximum.accumulate(at, out=at)
    pos = np.arange(len(value), dtype=np.int32) - at
    longest = int((ends - starts).max())
    value *= _powers(longest)[np.minimum(pos, longest - 1)]
    total = np.empty(len(value) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    return fmix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, text by text; a text of fewer words but not none has one.

    Returns the hashes and the index of each text's first hash (n + 1 entries).
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_first = np.concatenate(([0], np.cumsum(count)))
    h = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        h += words[j:len(words) - k + 1 + j] * (_P + U(2 * j)) if len(h) else h
    out = np.empty(out_first[-1], np.uint64)
    full = n >= k
    if full.any():
        # positions whose k words lie within one text
        text = np.repeat(np.arange(len(n)), count)
        pos = np.arange(out_first[-1]) - out_first[text] + first[text]
        ok = full[text]
        out[ok] = h[pos[ok]]
    for i in np.flatnonzero(~full & (n > 0)):
        v = int(n[i])
        for w in words[first[i]:first[i + 1]].tolist():
            v = (v * int(_P) + w) & (2 ** 64 - 1)
        out[out_first[i]] = v
    return fmix(out), out_first




def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch from numpy arrays, lists or Arrow arrays in schema order."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
              for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
