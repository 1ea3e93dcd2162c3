"""Numpy kernels over Arrow text columns: word spans, word hashes and word shingles of whole texts.

Words are ``[^\\x20\\x09-\\x0D]+``; hashes read A-Z as a-z. Every hash is a 64-bit polynomial of the bytes, finalised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from engram.session import visible_to_workers

SLICE_BYTES = 1 << 18  # temporaries of eight bytes for each then fit a core's cache
SHINGLE = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow = np.ones(1, dtype=_U)
_inv = np.ones(1, dtype=_U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, grown as needed."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 1)
        grown = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(size, base, dtype=_U)
            step[0] = 1
            grown.append(np.multiply.accumulate(step))
        _pow, _inv = grown
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of consecutive texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    word = (data != 32) & (data - np.uint8(9) > 4)  # comparisons of bytes are many times faster than a table
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    at = np.flatnonzero(edge)
    inner = np.unique(offs[(offs > 0) & (offs < n)])
    inner = inner[word[inner - 1] & word[inner]]  # a word ends and another one begins
    if len(inner):
        inner = np.repeat(inner, 2)
        at = np.insert(at, np.searchsorted(at, inner), inner)
    starts, ends = at[::2].copy(), at[1::2].copy()
    return starts, ends, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hash of each span of bytes, independent of its place."""
    power, inverse = _powers(len(data) + 1)
    if lower:
        data = data + (data - np.uint8(65) < 26).view(np.uint8) * np.uint8(32)
    sums = np.zeros(len(data) + 1, dtype=_U)
    values = data.astype(_U)
    values *= power[:-1]
    np.cumsum(values, out=sums[1:])
    length = ends - starts
    ones = np.zeros(int(length.max(initial=0)) + 1, dtype=_U)  # each byte counts as its value and one
    np.cumsum(power[: len(ones) - 1], out=ones[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts] + ones[length]
    return mix(h + length.astype(_U) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word of consecutive texts."""
    starts, ends, rows = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, _U), rows, starts, ends
    return span_hashes(data, starts, ends), rows, starts, ends


_MULT = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=_U)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, first word) of every run of ``size`` words; a text of 1 to size-1 words gives its whole sequence."""
    n = len(hashes)
    found, owner, at = [], [], []
    if n >= size:
        m = n - size + 1
        same = rows[:m] == rows[size - 1 :]
        h = hashes[:m] * _MULT[0]
        for j in range(1, size):
            h += hashes[j : j + m] * _MULT[j % 5]
            h ^= h >> _U(29)
            h *= _U(_BASE)
        k = np.flatnonzero(same)
        found.append(mix(h[k]))
        owner.append(rows[k])
        at.append(k)
    counts = np.bincount(rows, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(rows, short)
        total = np.full(len(short), 0xC2B2AE3D27D4EB4F, dtype=_U) + counts[short].astype(_U)
        for j in range(size - 1):
            has = counts[short] > j
            step = mix(total[has] * _MULT[j % 5] + hashes[first[has] + j])
            total[has] = step
        found.append(mix(total))
        owner.append(short)
        at.append(first)
    if not found:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, _U), z, z
    return np.concatenate(found), np.concatenate(owner), np.concatenate(at)


def row_sets(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted by row and value."""
    if not len(values):
        return values, rows
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], r[keep]


_WORKERS = {  # idle workers give memory back, as does Arrow
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(16 << 20),
    "MALLOC_ARENA_MAX": "2",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}
BATCH_BYTES = 4 << 20


def limit_arrow(df, rows: int = 1000):
    """Bound Arrow batches, so that a worker holds few long texts at once, and let workers import the package."""
    visible_to_workers(df.sparkSession)
    for name, value in _WORKERS.items():
        df.sparkSession.sparkContext.environment.setdefault(name, value)
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (conf.get(name, None) or "").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df
