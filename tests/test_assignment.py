from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from trackframe.functions.assignment import solve

cell = st.tuples(st.integers(0, 5), st.integers(0, 5))
costs = st.one_of(st.floats(0, 5), st.integers(0, 5).map(float))


def brute(edges):
    left = sorted({a for a, _, _ in edges})
    best = (0, 0.0)

    def go(i, used, k, c):
        nonlocal best
        if i == len(left):
            if k > best[0] or (k == best[0] and c < best[1] - 1e-12):
                best = (k, c)
            return
        go(i + 1, used, k, c)
        for a, b, w in edges:
            if a == left[i] and b not in used:
                go(i + 1, used | {b}, k + 1, c + w)

    go(0, frozenset(), 0, 0.0)
    return best


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(cell, costs, max_size=18), st.randoms())
def test_most_pairs_then_least_cost(graph, rng):
    edges = [(a, b, w) for (a, b), w in graph.items()]
    got = solve(edges)
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    k, c = brute(edges)
    assert len(got) == k and abs(sum(graph[p] for p in got) - c) < 1e-9
    rng.shuffle(edges)
    assert solve(edges) == got
