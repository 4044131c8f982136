"""Word and shingle hashing over Arrow string columns, vectorised with numpy.

Texts are handled as UTF-8 bytes.  A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; A-Z
are lower-cased.  Word and shingle identities are 64-bit hashes.  Everything works on whole texts; long
columns are processed in bounded blocks of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document forms a block of its own.
BLOCK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in the bytes) of blocks of whole documents; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
        kind = np.int64
    else:
        column = column.cast(pa.string())
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), n)
        lo, hi = offsets[first], offsets[end]
        yield first, end, data[lo:hi], offsets[first : end + 1] - lo
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never span two rows."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~_IS_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased): a polynomial over its bytes, finalised with its length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    poly = (sums[end] - sums[start]) * down[start]
    return mix64(poly + (end - start).astype(np.uint64) * np.uint64(_ODD))


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, offsets): each row's distinct shingle hashes, ascending.

    A row with fewer words than a shingle takes has its whole word sequence as one shingle; a row without
    words has none.
    """
    for first, end, data, offsets in blocks(column):
        s, e, row = word_bounds(data, offsets)
        h = word_hashes(data, s, e)
        n_rows = end - first
        counts = np.bincount(row, minlength=n_rows)
        begin = np.concatenate(([0], np.cumsum(counts)))
        wide = np.zeros(0, np.uint64)
        wide_row = np.zeros(0, np.int64)
        if len(h) >= words:
            m = len(h) - words + 1
            acc = np.full(m, words, dtype=np.uint64)
            for i in range(words):
                acc = mix64(acc * np.uint64(_BASE) + h[i : i + m])
            same = row[:m] == row[words - 1 :]
            wide, wide_row = acc[same], row[:m][same]
        short = np.flatnonzero((counts > 0) & (counts < words))
        short_hash = np.empty(len(short), np.uint64)
        for j, r in enumerate(short):
            acc1 = np.full(1, counts[r], dtype=np.uint64)
            for x in h[begin[r] : begin[r + 1]]:
                acc1 = mix64(acc1 * np.uint64(_BASE) + x)
            short_hash[j] = acc1[0]
        all_hash = np.concatenate((wide, short_hash))
        all_row = np.concatenate((wide_row, short))
        order = np.lexsort((all_hash, all_row))
        all_hash, all_row = all_hash[order], all_row[order]
        if len(all_hash):
            keep = np.ones(len(all_hash), dtype=bool)
            keep[1:] = (all_hash[1:] != all_hash[:-1]) | (all_row[1:] != all_row[:-1])
            all_hash, all_row = all_hash[keep], all_row[keep]
        yield first, end, all_hash, np.concatenate(([0], np.cumsum(np.bincount(all_row, minlength=n_rows))))
