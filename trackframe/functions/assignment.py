"""Exact sparse bipartite assignment for one small conflict group.

Spark partitions, shuffles and pre-solves the work; only edges whose ends are both
contested reach this kernel.
"""

from __future__ import annotations

import heapq

_LEFT, _RIGHT, _UNMATCHED = 0, 1, 2


def solve(edges):
    """Most pairs first, then least total cost.

    edges holds (left, right, cost >= 0) with orderable ends. Leaving a left vertex
    unmatched costs more than any saving can give back, so one shortest augmenting
    path per left vertex reaches both goals. The answer depends on the set of edges,
    not on their order.
    """
    edges = sorted(edges)
    out: dict = {}
    indegree: dict = {}
    for left, right, cost in edges:
        out.setdefault(left, []).append((right, cost))
        indegree[right] = indegree.get(right, 0) + 1

    pairs = []
    for left in [a for a, to in out.items() if len(to) == 1 and indegree[to[0][0]] == 1]:
        pairs.append((left, out.pop(left)[0][0]))
    if not out:
        return sorted(pairs)

    top = max(cost for _, _, cost in edges)
    unmatched_cost = (top + 1.0) * (min(len(out), len(indegree)) + 1)
    owner: dict = {}
    match: dict = {}
    price = dict.fromkeys(indegree, 0.0)
    value = {}
    for left, to in out.items():
        cost, right = min((c, r) for r, c in to)
        value[left] = cost
        if right not in owner:
            owner[right], match[left] = left, right

    for root in out:
        if root in match:
            continue
        dist_left, dist_right, via = {root: 0.0}, {}, {}
        settled, closed = [], set()
        heap = [(0.0, _LEFT, root)]
        while True:
            d, kind, node = heapq.heappop(heap)
            if kind == _UNMATCHED or (kind == _RIGHT and node not in owner):
                break
            if kind == _LEFT:
                settled.append((kind, node, d))
                heapq.heappush(heap, (d + unmatched_cost - value[node], _UNMATCHED, node))
                for right, cost in out[node]:
                    nd = d + cost - value[node] - price[right]
                    if right not in closed and match.get(node) != right and nd < dist_right.get(right, float("inf")):
                        dist_right[right], via[right] = nd, node
                        heapq.heappush(heap, (nd, _RIGHT, right))
            elif node not in closed:
                closed.add(node)
                settled.append((kind, node, d))
                holder = owner[node]
                if holder not in dist_left:
                    dist_left[holder] = d
                    heapq.heappush(heap, (d, _LEFT, holder))
        for settled_kind, vertex, at in settled:
            if settled_kind == _LEFT:
                value[vertex] += d - at
            else:
                price[vertex] -= d - at
        right = match.pop(node, None) if kind == _UNMATCHED else node
        while right is not None:
            left = via[right]
            owner[right] = left
            match[left], right = right, match.get(left)
    return sorted(pairs + list(match.items()))
