"""Suffix sorting by prefix polynomial hashes, for many small blocks of suffixes at once.

Two suffixes are compared in a logarithmic number of steps: a binary search over prefix
hashes finds how far they agree, and the next byte decides. A bottom-up mergesort with that
comparison runs over all blocks in step. Neighbours that agree far enough are checked byte
by byte, so a hash collision can never remove text.
"""

from __future__ import annotations

import numpy as np

from trackframe.llm.textbytes import Powers, mix, prefix_hashes, span_hashes


class Text:
    """Bytes with their prefix hashes."""

    def __init__(self, data: np.ndarray, powers: Powers) -> None:
        self.data, self.powers = data, powers
        self.prefix = prefix_hashes(data, powers)
        _, self.down = powers.upto(len(data) + 1)

    def agree(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Common extension, up to limit, of the suffixes at a and b (both have `limit` bytes)."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
        pa, pb, da, db = self.prefix[a], self.prefix[b], self.down[a], self.down[b]
        for _ in range(int(limit).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - pa) * da == (self.prefix[b + mid] - pb) * db
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, rank_a: np.ndarray, rank_b: np.ndarray, limit: int) -> np.ndarray:
        n = self.agree(a, b, limit)
        at = np.minimum(n, limit - 1)
        return np.where(n == limit, rank_a < rank_b, self.data[a + at] < self.data[b + at])

    def equal_bytes(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether size bytes at a and b are the same, byte by byte, in steps of bounded memory.

        Where very many pairs are equally far apart, as in texts of one period, the bytes of that
        distance are compared once for all of them.
        """
        if size.sum() > 4 * len(self.data):
            out = np.ones(len(a), dtype=bool)
            far, which, many = np.unique(b - a, return_inverse=True, return_counts=True)
            for k in np.flatnonzero(many * 100 > len(self.data) + 10_000):
                d, own = int(far[k]), np.flatnonzero(which == k)
                low = np.minimum(a[own], b[own])
                wrong = np.concatenate([[0], np.cumsum(self.data[: len(self.data) - abs(d)] != self.data[abs(d) :])])
                out[own] = wrong[low + size[own]] == wrong[low]
            rest = np.flatnonzero(many[which] * 100 <= len(self.data) + 10_000)
            out[rest] = self.equal_spans(a[rest], b[rest], size[rest])
            return out
        return self.equal_spans(a, b, size)

    def equal_spans(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        step = 1 << 19
        ends = np.cumsum(size)
        lo = 0
        while lo < len(a):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + step, "right")))
            own = np.repeat(np.arange(lo, hi), size[lo:hi])
            off = np.arange(len(own)) - np.repeat(ends[lo:hi] - size[lo:hi] - base, size[lo:hi])
            wrong = own[self.data[a[own] + off] != self.data[b[own] + off]]
            out[wrong] = False
            lo = hi
        return out


def sort_blocks(text: Text, at: np.ndarray, block: np.ndarray, rank: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes `at`, given with equal `block` numbers together: by block, first `limit` bytes, rank."""
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    size = np.diff(np.append(first, n))
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    width, most = 1, int(size.max())
    while width < most:
        live = np.flatnonzero(end - begin > width)  # blocks that are one run already stay
        inside = live - begin[live]
        run = inside // width
        other = begin[live] + (run ^ 1) * width
        low = np.minimum(other, end[live])
        high = np.minimum(other + width, end[live])
        start = low.copy()
        own = order[live]
        going = np.flatnonzero(low < high)
        while len(going):
            mid = (low[going] + high[going]) >> 1
            them = order[mid]
            us = own[going]
            before = text.less(at[them], at[us], rank[them], rank[us], limit)
            low[going] = np.where(before, mid + 1, low[going])
            high[going] = np.where(before, high[going], mid)
            going = going[low[going] < high[going]]
        place = begin[live] + (run & ~1) * width + inside % width + (low - start)
        order[place] = own
        width *= 2
    return order


def repeats(text: Text, at: np.ndarray, block: np.ndarray, rank: np.ndarray, limit: int) -> np.ndarray:
    """Whether each suffix's first `limit` bytes also stand, in its block, at a suffix of strictly smaller rank.

    Ranks follow the order of starts; equal ranks mean the same start.
    """
    order = sort_blocks(text, at, block, rank, limit)
    out = np.zeros(len(at), dtype=bool)
    if len(at) < 2:
        return out
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(block[a] == block[b])
    same = same[text.agree(at[a[same]], at[b[same]], limit) == limit]
    same = same[text.equal_bytes(at[a[same]], at[b[same]], np.full(len(same), limit))]
    linked = np.zeros(len(at), dtype=bool)
    linked[same + 1] = True
    head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
    out[order] = linked & (rank[order] > rank[order[head]])
    return out


def window_minima(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, powers: Powers, gram: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window start, number of windows), one for each run of windows with one anchor.

    A window is `limit` bytes of one text; its anchor is the leftmost of its `gram`-byte strings
    with the smallest hash, so that equal windows have equal anchors at equal places.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < limit:
        return np.zeros(0, np.uint64), none, none, none
    at = np.arange(n - gram + 1)
    value = span_hashes(prefix, at, at + gram, powers)
    hashes = value
    index = at.astype(np.int32)
    grams = limit - gram + 1
    width = 1

    def merge(value: np.ndarray, index: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        left = value[:-shift] <= value[shift:]
        return np.where(left, value[:-shift], value[shift:]), np.where(left, index[:-shift], index[shift:])

    while 2 * width <= grams:
        value, index = merge(value, index, width)
        width *= 2
    if grams > width:
        value, index = merge(value, index, grams - width)
    lengths = np.diff(offsets)
    inside = np.zeros(n + 1, np.int32)  # starts whose window stays within its text
    whole = lengths >= limit
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - limit + 1, -1)
    ok = np.cumsum(inside)[: len(index)] > 0
    starts = np.flatnonzero(ok)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    anchor = index[starts]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    place = anchor[first].astype(np.int64)
    return mix(hashes[place]), place, starts[first], np.diff(np.append(first, len(starts)))
