"""Small builders shared by the tests."""

from __future__ import annotations

import math
from itertools import product

DET = (
    "sequence_id string, frame_index int, detection_id string, x double, y double, x_raw_px double, y_raw_px double, "
    "quality_score double, box struct<x0:double,y0:double,x1:double,y1:double>, kind string, detector_name string"
)
TRUTH = "sequence_id string, frame_index int, truth_id string, x double, y double, target_id string, visible boolean"


def dets(spark, rows):
    """rows: (frame, id, x, y) or (seq, frame, id, x, y); ids may be None for automatic."""
    out = []
    for n, r in enumerate(rows):
        s, f, i, x, y = ("s", *r) if len(r) == 4 else r
        x, y = float(x), float(y)
        out.append((s, f, i or f"d{n:03d}", x, y, x, y, 0.9, (max(x - 2, 0.0), max(y - 2, 0.0), x + 2, y + 2), "compact", "test"))
    return spark.createDataFrame(out, DET)


def truths(spark, rows):
    out = []
    for n, r in enumerate(rows):
        f, x, y, target = (*r, "t")[:4]
        out.append(("s", f, f"g{n:03d}", float(x), float(y), target, True))
    return spark.createDataFrame(out, TRUTH)


def frames(spark, n, seq="s"):
    return spark.createDataFrame([(seq, i) for i in range(n)], "sequence_id string, frame_index int")


def best_matching(left, right, gate):
    """Exhaustive (pairs, cost) of the best one-to-one gated matching."""
    edges = {
        (i, j): math.dist(a, b) for (i, a), (j, b) in product(enumerate(left), enumerate(right)) if math.dist(a, b) <= gate
    }
    best = (0, 0.0)

    def go(i, used, k, c):
        nonlocal best
        if i == len(left):
            if k > best[0] or (k == best[0] and c < best[1] - 1e-12):
                best = (k, c)
            return
        go(i + 1, used, k, c)
        for j in range(len(right)):
            if (i, j) in edges and j not in used:
                go(i + 1, used | {j}, k + 1, c + edges[i, j])

    go(0, frozenset(), 0, 0.0)
    return best
