"""Whole-batch tokenising of UTF-8 text columns with numpy, for use inside Arrow functions.

Words are maximal runs of bytes of one class. Both word classes used here are unions of ASCII
characters and all non-ASCII characters, so byte runs of valid UTF-8 are exactly the runs of
characters. A word is known by a 64-bit hash (polynomial over the lower-cased bytes, then a
finaliser); every array below is bounded by a chunk of texts, never by a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 18


def _class(ok) -> np.ndarray:
    return np.array([ok(b) for b in range(256)], dtype=bool)


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = _class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: [^\x20\x09-\x0D]+
NONSPACE = _class(lambda b: b != 32 and not 9 <= b <= 13)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(start, start + n, dtype=U)) * U(0x9E3779B97F4A7C15))


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_BYTE = seeds(256, 1000)[_LOWER] | U(1)
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for one chunk of bytes."""
    out = []
    for base in (_P, _PINV):
        a = np.full(CHUNK_BYTES + 1, base, dtype=U)
        a[0] = 1
        out.append(np.cumprod(a, dtype=U))
    return tuple(out)


def texts(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks (first row, last row, bytes, offsets from 0) of a string column; null is empty.
    A chunk holds about ``size`` bytes, or one longer text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(off, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and for each text (plus an end) the index of its first word."""
    start, end, first = spans(data, offsets, kind)
    return hashes(data, start, end), first


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a chunk, and each text's first word index."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    inside = kind[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    cut[1:n] |= ~inside[:-1]
    start = np.flatnonzero(inside & cut[:n])
    cut[:] = False
    cut[offsets] = True
    cut[1:n] |= ~inside[1:]
    end = np.flatnonzero(inside & cut[1:]) + 1
    return start, end, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words ``data[start:end]``, which stand in order; a chunk of bytes at a time, however long the
    data or a word are."""
    if len(data) <= CHUNK_BYTES:
        return _finish(_sums(data, start, end), end - start)
    out = np.empty(len(start), dtype=U)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + CHUNK_BYTES, "right")))
        own = data[start[a]:end[b - 1]]
        out[a:b] = _long_sum(own) if len(own) > CHUNK_BYTES else _sums(own, start[a:b] - start[a], end[a:b] - start[a])
        a = b
    return _finish(out, end - start)


def _sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of every word, from running sums over at most a chunk."""
    power, inverse = _powers()
    total = np.empty(len(data) + 1, dtype=U)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * power[:len(data)], dtype=U, out=total[1:])
        return (total[end] - total[start]) * inverse[start]


def _long_sum(word: np.ndarray) -> np.uint64:
    """The polynomial of one word that is longer than a chunk."""
    power, total, step = _powers()[0], 0, pow(int(_P), CHUNK_BYTES, 1 << 64)
    with np.errstate(over="ignore"):
        for k, a in enumerate(range(0, len(word), CHUNK_BYTES)):
            part = word[a:a + CHUNK_BYTES]
            total += int((_BYTE[part] * power[:len(part)]).sum(dtype=U)) * pow(step, k, 1 << 64)
    return U(total % (1 << 64))


def _finish(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums + lengths.astype(U))


def hash_of(word: str) -> int:
    """The hash that ``words`` gives a single word, as a signed 64-bit integer."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])


def ranges(first: np.ndarray) -> np.ndarray:
    """Text index of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def positions(first: np.ndarray) -> np.ndarray:
    """Word position inside its text, from 0."""
    return np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], np.diff(first))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U else values.astype(np.int64, copy=False))


def lists(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    """array<bigint> column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), longs(flat))
