"""Vectorised word kernels over Arrow string batches.

A word is a maximal run of ASCII letters, ASCII digits and bytes of non-ASCII
characters.  ASCII letters and the accented letters of the Latin-1 block are
folded to lower case.  The equivalent regular expression over a folded text is
``[0-9a-z\\u0080-\\U0010ffff]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_MULT), -1, 1 << 64))
_GRAM = U64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def release() -> None:
    """Give memory back that this worker, which Spark keeps for later tasks, doesn't use any more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returning(step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The same step over batches; at the end of a task the memory that it took goes back, which idle workers would hold during later stages."""

    @wraps(step)
    def run(*args: object, **named: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(*args, **named)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, CHUNK_BYTES + 4096)
            up, down = np.full(size, _MULT), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row bounds, row is present) of an Arrow string or binary array; no copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), np.zeros(len(column), bool)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    present = ~column.is_null().to_numpy(zero_copy_only=False)
    return raw, bounds, present


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds within them), each of about ``size`` bytes of whole rows."""
    raw, bounds, _ = strings(column)
    n, row = len(bounds) - 1, 0
    while row < n:
        end = int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


@dataclass
class Words:
    """Words of consecutive rows: byte ranges, hashes, and the first word of each row (one more bound at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def fold(raw: np.ndarray) -> np.ndarray:
    low = _FOLD[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.zeros(0, np.int64)
    if len(lead):
        after = low[lead]
        low[lead] = np.where((after >= 0x80) & (after <= 0x9E) & (after != 0x97), after + 32, after)
    return low


def words(raw: np.ndarray, bounds: np.ndarray) -> Words:
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), np.zeros(len(bounds), np.int64))
    low = fold(raw)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _WORD[raw]
    cuts = bounds[1:-1]
    is_start = inside[1:-1] & ~inside[:-2]
    is_end = inside[1:-1] & ~inside[2:]
    at = cuts[(cuts > 0) & (cuts < n)]
    is_start[at] = inside[1:-1][at]
    is_end[at - 1] = inside[1:-1][at - 1]
    start, end = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
    up, down = _POWERS.upto(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((low.astype(U64) + U64(1)) * up[:n], out=total[1:])
    value = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    return Words(start, end, value, np.searchsorted(start, bounds))


def grams(value: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes; runs that cross rows are for the caller to leave out."""
    n = len(value) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = value[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += value[j : n + j]
    return mix(out)


def range_hash(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the hashes in each [start, end)."""
    up, down = _POWERS.upto(len(value) + 1)
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(value * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


PLACE_BITS = 26


def window_minima(value: np.ndarray, w: int, bits: int = PLACE_BITS) -> np.ndarray:
    """For each window of w values, the index of its least in all but ``bits`` low bits; of equal ones the leftmost.

    More than 2^bits values are taken in pieces.
    """
    n, most = len(value) - w + 1, 1 << bits
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(value) > most:
        step = most - w + 1
        return np.concatenate([i + window_minima(value[i : i + most], w, bits) for i in range(0, n, step)])
    place = U64(most - 1)
    key = (value & ~place) | np.arange(len(value), dtype=U64)
    s = 1
    while 2 * s <= w:
        key = np.minimum(key[:-s], key[s:])
        s *= 2
    if s < w:
        key = np.minimum(key[:n], key[w - s : w - s + n])
    return (key[:n] & place).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
