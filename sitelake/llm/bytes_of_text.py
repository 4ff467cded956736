"""Texts as flat byte arrays, and the hashes of words and n-grams in them, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# A-Z become a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()
# What separates words: space and the controls 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 2 << 20


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = column.cast(pa.large_string()).fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return text[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text makes a range of its own."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 to the 64."""
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, _CHUNK + 1), base, np.uint64)
        steps[0] = 1
        known = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of the input."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power("up", _BASE, len(data)), dtype=np.uint64, out=sums[1:])
    shift = _power("down", _INVERSE, len(data) + 1)
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * shift[starts] + lengths)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one entry more than texts)."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edges] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket, of 2 to the ``bits``, of the n bytes from each place on; ``len(data) - n + 1`` of them."""
    count = max(0, len(data) - n + 1)
    total = np.full(count, n, np.uint64)
    for k in range(n):
        total *= _BASE
        total += _BYTE_VALUES[data[k : k + count]]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0x7FB5D329728EA185)
    return (total >> np.uint64(64 - bits)).astype(np.int64)
