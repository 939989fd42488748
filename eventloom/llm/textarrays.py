"""Word tokenisation and hashing over whole Arrow string columns.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z count
as a-z.  Everything is computed on the column's byte buffer with numpy, so the
cost is a few passes over the bytes and no Python object is made per word.

A null text counts as an empty one.  Word keys are 64-bit: two different words
share one with a chance of 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text is one chunk.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def release() -> None:
    """Give memory that a task no longer uses back to the system; workers live on and serve other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


#: What an operator keeps in a worker from task to task.
kept: dict = {}


def only_now() -> None:
    """A task begins that keeps nothing: what another operator kept in this worker goes."""
    if kept:
        kept.clear()
        release()


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_KEY = splitmix(np.arange(1, 257, dtype=_U))
_BYTE_KEY_FOLDED = _BYTE_KEY[_FOLD]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE & _MASK, inverse):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=_U))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def pieces(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes at most, one row at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and each row's range in them."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    inside = _IS_WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= cut[:n]
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= cut[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, fold: bool = True) -> np.ndarray:
    """A 64-bit key of each span of bytes."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum((_BYTE_KEY_FOLDED if fold else _BYTE_KEY)[data] * up[:n], out=total[1:])
    return splitmix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(_U))


def word_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words in order, and each row's range in them."""
    starts, ends, rows = word_bounds(data, off)
    return span_keys(data, starts, ends), rows


_STEP = [_U(int(x)) for x in splitmix(np.arange(100, 164, dtype=_U)) | _U(1)]


def shingle_keys(keys: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of ``width`` words in each row, repeats included.

    A row with fewer words, but one at least, has its whole sequence as one.
    """
    counts = np.diff(rows)
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_rows = np.concatenate(([0], np.cumsum(many)))
    total = int(out_rows[-1])
    first = np.repeat(rows[:-1] - out_rows[:-1], many) + np.arange(total)
    short = np.repeat(np.where(counts < width, counts, width), many)
    acc = np.zeros(total, _U)
    all_full = bool((short == width).all()) if total else True
    for k in range(width):
        if all_full:
            acc += keys[first + k] * _STEP[k]
        else:
            live = short > k
            acc[live] += keys[first[live] + k] * _STEP[k]
    return splitmix(acc ^ short.astype(_U)), out_rows


def distinct_sorted(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's keys sorted and without repeats."""
    out = [np.unique(keys[a:b]) for a, b in zip(rows[:-1], rows[1:])]
    sizes = np.fromiter((len(x) for x in out), np.int64, len(out))
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.concatenate(([0], np.cumsum(sizes)))


def list_array(values: np.ndarray, rows: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values, kind))
