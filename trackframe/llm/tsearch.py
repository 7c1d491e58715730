"""T-occurrence search in a block of sets: heap-merged short lists, binary probes of long ones.

For a query set of n tokens, every partner at the threshold shares at least T tokens with it.
Its inverted lists are split in two: the L longest are left out of the merge, the others are
merged with a heap, and a set that occurs T - L times among them is a candidate. Candidates
are then probed by binary search for the tokens of the long lists (DivideSkip).
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np

#: weight of a probe against a step of the merge, in the rule for L
PROBE = 0.02


def least_overlap(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shares at least with any partner: ceil(n * num / den)."""
    return -(-n * num // den)


def prefix_size(n, num: int, den: int):
    """A set and each partner of it share a token among so many first ones, in any fixed order."""
    return n - (n * num + den - 1) // den + 1


def linked(inter: int, a: int, b: int, num: int, den: int) -> bool:
    return den * inter >= num * (a + b - inter)


class Groups:
    """Disjoint sets of row numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, k: int) -> None:
        i, k = self.find(i), self.find(k)
        if i != k:
            self.up[max(i, k)] = min(i, k)


def connect(sets: list[np.ndarray], side: np.ndarray, across: bool, num: int, den: int) -> Groups:
    """Groups of sets connected by links among themselves, or only between the two sides if `across`.

    Sets are sorted arrays of distinct tokens, given in order of size. A pair that is
    connected already is not probed again: it cannot change the groups.
    """
    groups = Groups(len(sets))
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    values, bounds = tokens[first], np.append(first, len(tokens))
    for x, own in enumerate(sets):
        n = len(own)
        need = least_overlap(n, num, den)
        low = int(np.searchsorted(sizes, need, "left"))  # smaller sets cannot reach the threshold
        if low >= x:
            continue
        at = np.searchsorted(values, own)
        lo, hi = bounds[at], bounds[at + 1]
        length = hi - lo
        by_length = np.argsort(length, kind="stable")
        longest = int(length[by_length[-1]])
        n_long = min(need - 1, int(need / (PROBE * math.log2(longest + 1) + 1)))
        short, long = by_length[: n - n_long], own[by_length[n - n_long :]]
        lists = []
        for k in short.tolist():
            if length[k] > 1:
                members = owner[lo[k] : hi[k]]
                members = members[np.searchsorted(members, low) : np.searchsorted(members, x)]
                if len(members):
                    lists.append(members.tolist())
        if len(lists) < need - n_long:
            continue
        for y, run in groupby(heapq.merge(*lists)):
            if across and side[y] == side[x] or groups.find(x) == groups.find(y):
                continue
            count = sum(1 for _ in run)
            if count < need - n_long:
                continue
            other = sets[y]
            place = np.minimum(np.searchsorted(other, long), len(other) - 1)
            if linked(count + int(np.count_nonzero(other[place] == long)), n, len(other), num, den):
                groups.join(x, y)
    return groups
