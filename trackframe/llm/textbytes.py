"""Vectorised byte work on Arrow string columns: words, word hashes, n-gram hashes.

A text is its UTF-8 bytes. All functions work on a slice of about CHUNK bytes of a batch
(one text at least), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: the white space of all word contracts
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large strings, null as the empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets with one entry more than rows)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, len(self.up) * 5 // 4)
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.multiply.accumulate(np.full(size, BASE, np.uint64))])
            self.down = np.concatenate([one, np.multiply.accumulate(np.full(size, BASE_INVERSE, np.uint64))])
        return self.up, self.down


def prefix_hashes(data: np.ndarray, powers: Powers) -> np.ndarray:
    """prefix[i] = sum over j < i of (byte j + 1) * BASE**j."""
    up, _ = powers.upto(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of the bytes of each span that does not depend on where the span stands."""
    _, down = powers.upto(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of `inside`, broken at text borders."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: Powers, inside: np.ndarray | None = None):
    """(starts, ends, row, hash) of the words of all texts."""
    starts, ends, row = runs(~SPACE[data] if inside is None else inside, offsets)
    return starts, ends, row, span_hashes(prefix_hashes(data, powers), starts, ends, powers)


def gram_hashes(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams of words that stay within one text."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(k, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(BASE) + words[i : i + k])
    whole = row[:k] == row[n - 1 :]
    return h[whole], row[:k][whole]


def distinct_by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, count) without repeats, ordered by row, then value."""
    if not len(row):
        return row, value, np.zeros(0, np.int64)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=n)


def nested(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values ordered by row as one list a row."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
