"""Words of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_ODD = int(_RNG.integers(0, 2**61, dtype=np.uint64)) * 8 + 3
_INV = pow(_ODD, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word in [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; UTF-8 bytes of other characters count.
ALNUM = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])
#: Bytes of a word in [^\x20\x09-\x0D]+.
NONBLANK = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Texts are joined up to about this many bytes; a longer text stands alone.
BLOCK_BYTES = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, case: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, last byte + 1) of each word, and for texts bounds[i]:bounds[i+1] of the UTF-8 bytes the index of their first word, with the count of words at the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    low = case[data]
    w = is_word[low]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], w[:-1])) & ~edge[:n]
    starts = np.flatnonzero(w & ~before)
    after = np.concatenate((w[1:], [False])) & ~edge[1:]
    ends = np.flatnonzero(w & ~after) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)  # in place, as arrays of a block's bytes are most of a worker's memory
    np.take(_BYTE, low, out=sums[1:])
    sums[1:] *= power
    np.cumsum(sums[1:], out=sums[1:])
    h = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, starts, ends, np.searchsorted(starts, bounds)


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of a string column, null as empty, in blocks of about `size` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] values, then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)
