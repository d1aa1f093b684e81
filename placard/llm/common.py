"""Helpers that the document operators share: Arrow text access and word hashing in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a task hashes at a time; the scratch arrays take about 40 bytes for each.
BLOCK_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes from which on a word is hashed by a cryptographic digest: sums of powers collide on some very long words.
LONG_WORD = 256
_powers: list[np.ndarray] = []
_held: dict[tuple[str, object], object] = {}


def only_one(kind: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, built once in a worker for ``kind`` and ``key``. A worker serves one stage after another, so
    it holds one such object at a time: models, vocabularies and caches of earlier stages go."""
    if (kind, key) not in _held:
        _held.clear()
        _held[kind, key] = make()
    return _held[kind, key]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]] if len(at) else raw[:0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes together; one long text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and the index of each row's first word.

    A word is a run of bytes other than blanks and the control characters 9 to 13; ``fold`` lower-cases A to Z.
    Rows never share a word. The last array has one more entry than rows.
    """
    n = len(data)
    offsets = offsets - offsets[0]
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    up, down = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] if fold else data).astype(np.uint64) * up + up, out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts])
    for w in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[w] : ends[w]]
        hashes[w] = np.frombuffer(blake2b((_LOWER[word] if fold else word).tobytes(), digest_size=8).digest(), np.uint64)[0]
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of every row, and the index of each row's first one.

    A row with fewer than ``k`` words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.diff(first)
    weights = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)  # unlike each other, so that no rearrangement cancels
    m = max(0, len(hashes) - k + 1)
    total = np.zeros(m, np.uint64)
    for j, w in enumerate(weights):
        total += hashes[j : j + m] * w
    per_row = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty(at[-1], np.uint64)
    full = np.flatnonzero(counts >= k)
    if len(full):
        source = np.repeat(first[full], per_row[full]) + _ramps(per_row[full])
        out[np.repeat(at[full], per_row[full]) + _ramps(per_row[full])] = total[source]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        h = hashes[first[r] : first[r + 1]]
        out[at[r]] = np.uint64(sum(int(x) * int(w) for x, w in zip(h, weights, strict=False)) + 0x2545F4914F6CDD1D * len(h) & (1 << 64) - 1)
    return mixed(out), at


def _ramps(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
