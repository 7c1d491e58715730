from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import best_matching, dets, frames, truths
from trackframe.operators import components, evaluation, matching, sweeps, tracking


def metrics(spark, preds, truth, gate=5.0):
    return evaluation.detection_metrics(dets(spark, preds), truths(spark, truth), gate).first()


def test_perfect_match(spark):
    m = metrics(spark, [(0, None, 10, 10), (1, None, 20, 20), (2, None, 30, 30)], [(0, 10, 10), (1, 20, 20), (2, 30, 30)])
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.f1, m.localization_rmse_px) == (3, 0, 0, 1.0, 1.0, 1.0, 0.0)
    assert m.null_reasons == {}


@pytest.mark.parametrize("offset,tp", [((3, 4), 1), ((5.5, 0), 0)])
def test_gate_is_inclusive(spark, offset, tp):
    m = metrics(spark, [(0, None, 10 + offset[0], 10 + offset[1])], [(0, 10, 10)])
    assert (m.tp, m.fp, m.fn) == (tp, 1 - tp, 1 - tp)
    assert m.precision == m.recall == float(tp)
    assert m.localization_rmse_px == (5.0 if tp else None)


def test_competition_keeps_the_closer(spark):
    m = matching.match_points(dets(spark, [(0, "a", 10, 11), (0, "b", 10, 12)]), truths(spark, [(0, 10, 10)]), 5.0)
    assert [r.detection_id for r in m.pairs.collect()] == ["a"]
    assert [r.detection_id for r in m.unmatched_left.collect()] == ["b"]
    assert m.unmatched_right.count() == 0


def test_empty_scene_has_reasons(spark):
    m = metrics(spark, [], [])
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.localization_rmse_px) == (0, 0, 0, None, None, None)
    assert m.null_reasons == {
        "precision": "No predicted detections (TP + FP == 0)",
        "recall": "No ground truth targets (TP + FN == 0)",
        "localization_rmse_px": "No matched detections (TP == 0)",
    }


def random_frames(seed, n_frames, most, box):
    rng = random.Random(seed)
    left, right = {}, {}
    for f in range(n_frames):
        left[f] = [(rng.uniform(0, box), rng.uniform(0, box)) for _ in range(rng.randint(0, most))]
        right[f] = [(rng.uniform(0, box), rng.uniform(0, box)) for _ in range(rng.randint(0, most))]
    rows = lambda d: [(f, x, y) for f, ps in d.items() for x, y in ps]
    return left, right, rows(left), rows(right)


# group_edges=2 sends every contested frame through components and the per-component step.
@pytest.mark.parametrize("small,limit", [(True, matching.GROUP_EDGES), (False, matching.GROUP_EDGES), (False, 2)])
def test_matching_equals_exhaustive_search(spark, small, limit):
    left, right, lrows, rrows = random_frames(7, 25, 6, 14.0)
    d = dets(spark, [(f, None, x, y) for f, x, y in lrows])
    t = truths(spark, rrows)
    pairs = matching.match_points(d, t, 5.0, frames_are_small=small, group_edges=limit).pairs.collect()
    assert len({r.detection_id for r in pairs}) == len(pairs) == len({r.truth_id for r in pairs})
    for f in left:
        k, c = best_matching(left[f], right[f], 5.0)
        mine = [r.distance for r in pairs if r.frame_index == f]
        assert len(mine) == k and math.isclose(sum(mine), c, abs_tol=1e-9)


@pytest.mark.parametrize("gate", [0.7, 5.0, 30.0])
def test_gated_pairs_equal_brute_force(spark, gate):
    left, right, lrows, rrows = random_frames(11, 6, 25, 60.0)
    lrows = [(f, x - 30, y - 30) for f, x, y in lrows] + [(0, gate * 4, 0.0)]
    rrows = [(f, x - 30, y - 30) for f, x, y in rrows] + [(0, gate * 5, 0.0), (0, gate * 4, gate)]
    got = matching.gated_pairs(dets(spark, [(f, None, x, y) for f, x, y in lrows]), truths(spark, rrows), gate)
    want = sum(1 for a in lrows for b in rrows if a[0] == b[0] and math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= gate)
    assert got.count() == got.distinct().count() == want


def test_components_of_chains_and_stars(spark):
    chain = [("k", i, i + 1) for i in range(1, 60)] + [("k", 100, i) for i in range(101, 120)] + [("m", 5, 6)]
    nodes = sorted({(k, n) for k, a, b in chain for n in (a, b)} | {("k", 999)})
    e = spark.createDataFrame(chain, "g string, src long, dst long")
    n = spark.createDataFrame(nodes, "g string, node long")
    got = {(r.g, r.node): r.component for r in components.connected_components(n, e, ["g"]).collect()}
    assert got == {(k, n): (1 if n <= 60 else 100 if n < 999 else 999) if k == "k" else 5 for k, n in nodes}


def test_boxes_one_duplicate(spark):
    box = "sequence_id string, frame_index int, {} string, box struct<x0:double,y0:double,x1:double,y1:double>"
    a, b = (0.0, 0.0, 10.0, 10.0), (100.0, 100.0, 140.0, 120.0)
    p = spark.createDataFrame([("s", 0, "p0", a), ("s", 0, "p1", a), ("s", 0, "p2", (50.0, 50.0, 60.0, 60.0))], box.format("detection_id"))
    t = spark.createDataFrame([("s", 0, "t0", a), ("s", 0, "t1", b)], box.format("truth_id"))
    m = matching.match_boxes(p, t)
    assert [(r.truth_id, r.iou) for r in m.pairs.collect()] == [("t0", 1.0)]
    assert m.unmatched_left.count() == 2 and [r.truth_id for r in m.unmatched_right.collect()] == ["t1"]


def test_track_metrics_case(spark):
    pts = [("s", "trk-1", 0, "a", 10.0, 10.0), ("s", "trk-2", 1, "b", 20.0, 20.0), ("s", "trk-2", 2, "c", 30.0, 30.0)]
    pts += [("s", "trk-3", f, f"z{f}", 500.0, 400.0) for f in range(3)]
    p = spark.createDataFrame(pts, "sequence_id string, track_id string, frame_index int, detection_id string, x_reference_px double, y_reference_px double")
    p = p.withColumn("point_type", F.lit("observed"))
    tr = spark.createDataFrame([("s", "trk-1", "tentative", 1), ("s", "trk-2", "tentative", 2), ("s", "trk-3", "confirmed", 3)], "sequence_id string, track_id string, status string, observed_count int")
    m = evaluation.track_metrics(p, tr, truths(spark, [(0, 10, 10), (1, 20, 20), (2, 30, 30)])).first()
    assert (m.tp, m.fp, m.fn, m.id_switches, m.coverage, m.false_confirmed_tracks, m.total_tracks, m.confirmed_tracks) == (3, 3, 0, 1, 1.0, 1, 3, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(df, at):
    """The table read from files, whose size Spark knows and multiplies by nothing."""
    df.write.parquet(str(at))
    return df.sparkSession.read.parquet(str(at))


def test_copies_to_cells_are_never_broadcast(spark, tmp_path):
    cuts = [{"threshold": t / 10} for t in range(5)]
    d = sweeps.with_configs(stored(dets(spark, [(0, None, 10, 10), (1, None, 20, 20)]), tmp_path / "d"), cuts)
    t = sweeps.with_configs(stored(truths(spark, [(0, 11, 10), (1, 20, 24)]), tmp_path / "t"), cuts)
    key = ["threshold", *matching.FRAME]
    pairs = matching.gated_pairs(d, t, 5.0, keys=key)
    assert "Broadcast" not in plan_of(pairs) and pairs.count() == 10
    box = F.struct(*[(F.col(c) + s).alias(n) for n, c, s in (("x0", "x", -2), ("y0", "y", -2), ("x1", "x", 2), ("y1", "y", 2))])
    boxes = matching.overlapping_boxes(d, t.withColumn("box", box), 0.1, keys=key)
    assert "Broadcast" not in plan_of(boxes) and boxes.count() == 5


def test_tracks_of_a_sweep_are_never_broadcast(spark, tmp_path):
    steps = stored(dets(spark, [("s", f, f"a{f}", 10.0 + f, 10.0) for f in range(5)]), tmp_path / "d")
    points = tracking.track_sequences(steps, stored(frames(spark, 5), tmp_path / "f"), sweeps.SWEEP, sequences_are_small=True)
    keys = ["config_id", "sequence_id", "track_id"]
    found = tracking.accepted_observations(tracking.points_of(points), tracking.tracks_of(points), keys, 3)
    assert "Broadcast" not in plan_of(found) and found.count() == 45
