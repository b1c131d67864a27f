"""Vectorised views of whole texts for Arrow batches: byte buffers, words and their fingerprints.

A batch is worked through in chunks of about CHUNK bytes of text (a longer text is a chunk of its
own), so a worker's memory follows the chunk and the longest text, not the partition. A word's
fingerprint is a 64-bit polynomial hash of its UTF-8 bytes over a fixed table of random values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TABLES = (_TABLE, np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))  # of two independent fingerprints
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 32, dtype=np.uint64)]
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]

# Bytes that separate words. WHITE: white space only. PLAIN: all ASCII but digits and letters.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PLAIN = np.zeros(256, bool)
PLAIN[:128] = True
PLAIN[0x30:0x3A] = PLAIN[0x41:0x5B] = PLAIN[0x61:0x7B] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together, or of one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, rows)
        low = min(high, rows)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[30]
    h = (h ^ (h >> np.uint64(29))) * _MIX[31]
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, CHUNK + (1 << 12)), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def word_bounds(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a row's end ends a word."""
    inside = ~sep[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """A 64-bit fingerprint of data[start:end] for ascending, disjoint spans, by segments of CHUNK bytes."""
    out, k = np.zeros(len(start), np.uint64), 0
    while k < len(start):
        low = start[k]
        stop = max(k + 1, int(np.searchsorted(end, low + CHUNK, "right")))
        part = data[low : end[stop - 1]]
        power, inverse = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * power[: len(part)], dtype=np.uint64, out=total[1:])
        s, e = start[k:stop] - low, end[k:stop] - low
        out[k:stop] = (total[e] - total[s]) * inverse[s]
        k = stop
    return mix(out)


def hash_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each values[start:end]."""
    power, inverse = _powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def word_hashes(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of each word."""
    start, end, row = word_bounds(data, offsets, sep)
    return hash_spans(data, start, end), row


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """rows + 1 offsets into an array whose sorted row numbers are given."""
    return np.searchsorted(row, np.arange(rows + 1))


def shingles(words: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints of k consecutive words, sorted in each row, and their rows.

    A row of fewer words, but not none, has one shingle of all its words.
    """
    bounds = row_bounds(row, rows)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(len(words))
    begin, stop = bounds[row], bounds[row + 1]
    at = at[at <= np.maximum(begin, stop - k)]
    total = np.zeros(len(at), np.uint64)
    limit = stop[at]
    for j in range(k):
        there = at + j
        ok = there < limit
        total += np.where(ok, words[np.minimum(there, len(words) - 1)] * _MIX[j], np.uint64(0))
    total, of = mix(total), row[at]
    order = np.lexsort((total, of))
    total, of = total[order], of[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
    return total[new], of[new]


def batches(source: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts."""
    for batch in source:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        for low, high in chunks(offsets):
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
