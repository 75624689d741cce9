"""Vectorised text arrays shared by the operators of this subpackage.

Everything here is pure NumPy/Arrow on the rows of one batch: word spans, 64-bit
hashes of spans and word shingles in CSR form (values + row pointer). Strings are
told apart by span_hashes, which mixes every eight bytes with their place; the
polynomial RollingHash has equal values for some long different strings (an odd
base to powers of two) and only chooses places, never what is equal.
Blocks are cut so that working arrays stay a small multiple of ``block_bytes``;
a single longer text forms a block of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
P1 = 0x9FB21C651E98DF25  # odd multiplier of the polynomial hash
P1_INV = pow(P1, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN + U64(seed))


_BYTES = _byte_table(0x5851F42D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, U64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = P1) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables are kept for round sizes."""
    size = 1 << max(16, (n - 1).bit_length())
    return (_powers(size, base) if size <= 1 << 23 else _powers.__wrapped__(size, base))[:n]


class RollingHash:
    """Hashes of any spans of one byte buffer, by prefix sums of a polynomial: to choose places, not to tell strings apart."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTES) -> None:
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * powers(max(1, len(data)))[: len(data)], out=self.prefix[1:])
        self.inverse = powers(len(data) + 1, P1_INV)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64) * GOLDEN)


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span data[start:end]; those of two seeds are independent.

    Every eight bytes are mixed with their place in the span and the seed, and the
    mixed values are added up, so no step is linear in the bytes.
    """
    size = np.asarray(end - start)
    words = (size + 7) >> 3
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    many = words > 1
    out = np.zeros(len(size), dtype=np.uint64)
    key = mix(np.array([seed + 1], dtype=np.uint64) * GOLDEN)

    def mixed(block: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        return mix(mix(block ^ key) + mix(np.atleast_1d(np.asarray(place, dtype=np.uint64)) * GOLDEN + key))

    one = np.flatnonzero(~many)
    out[one] = mixed(eight[start[one]] & _TAIL[size[one]], 0)
    for some in _portions(np.flatnonzero(many), words):
        count = words[some]
        place = _ragged(np.zeros(len(some), np.int64), count)
        left = np.repeat(size[some], count) - 8 * place
        block = eight[np.repeat(start[some], count) + 8 * place] & _TAIL[np.minimum(left, 8)]
        out[some] = np.add.reduceat(mixed(block, place), np.cumsum(count) - count)
    return mix(out ^ mix(size.astype(np.uint64) * GOLDEN + key))


def span_identities(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """span_hashes, and a second value: of spans of eight bytes or fewer the bytes themselves with their number, else an independent hash."""
    first, size = span_hashes(data, start, end), np.asarray(end - start)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    second = (eight[start] & _TAIL[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * GOLDEN)
    long = np.flatnonzero(size > 8)
    second[long] = span_hashes(data, start[long], end[long], 1)
    return first, second


def _portions(rows: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The rows in runs of about most units of size, so that work arrays stay bounded."""
    total = np.cumsum(size[rows])
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield rows[a:b]
        a = b


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, block_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about block_bytes."""
    data, offs = binary_parts(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + block_bytes, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row pointer) of the words ``[^\\x20\\x09-\\x0D]+`` of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, row pointer)."""
    start, end, ptr = word_spans(data, offs)
    return span_hashes(_LOWER[data], start, end), ptr


def shingles(words: np.ndarray, ptr: np.ndarray, n: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of n words, repeats included, and their row pointer.

    A row with 1 to n-1 words gives its whole sequence as one shingle if
    short_whole, else nothing; a row without words gives nothing.
    """
    counts = np.diff(ptr)
    have = np.maximum(counts - n + 1, 0)
    total = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        total += mix(words[k : k + len(total)] + U64((k + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)) * U64(2 * k + 3)
    out_counts = np.where((have == 0) & (counts > 0), 1, have) if short_whole else have
    out_ptr = np.concatenate([[0], np.cumsum(out_counts)]).astype(np.int64)
    out = np.empty(int(out_ptr[-1]), dtype=np.uint64)
    full = np.flatnonzero(have)
    take = np.repeat(ptr[full] - out_ptr[full], have[full]) + _ragged(out_ptr[full], have[full])
    out[_ragged(out_ptr[full], have[full])] = mix(total[take])
    if short_whole:
        for r in np.flatnonzero((have == 0) & (counts > 0)):
            h = U64(int(counts[r]) + 0x1000)
            for w in words[ptr[r] : ptr[r + 1]]:
                h = mix(np.array([h], dtype=np.uint64) * U64(P1) + w)[0]
            out[out_ptr[r]] = h
    return out, out_ptr


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i] .. start[i]+count[i]-1 for each i, in one array."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - count), count)


ragged = _ragged


def distinct(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new row pointer."""
    if len(ptr) > 1 and len(values) < 200 * (len(ptr) - 1):  # many short rows: all are sorted at once
        row = row_of(ptr)
        order = np.argsort(values)
        order = order[np.argsort(row.astype(np.uint16 if len(ptr) <= 1 << 16 else np.int64)[order], kind="stable")]
        values, row = values[order], row[order]
        fresh = np.ones(len(values), dtype=bool)
        fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        return values[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(ptr) - 1))])
    out = [np.unique(values[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    new = np.zeros(len(ptr), dtype=np.int64)
    np.cumsum([len(x) for x in out], out=new[1:])
    return (np.concatenate(out) if out else values[:0]), new


def row_of(ptr: np.ndarray) -> np.ndarray:
    """The row number of each value."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def list_column(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of a CSR pair."""
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, type=kind))


def signed(values: np.ndarray) -> np.ndarray:
    """uint64 bits as int64, for Spark's LONG."""
    return values.view(np.int64)


def release() -> None:
    """Gives memory back to the system at the end of a task: idle Python workers share the executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with this C library
        pass
