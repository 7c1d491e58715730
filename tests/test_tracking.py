from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import dets, frames, truths
from trackframe.functions.stepper import TrackerConfig
from trackframe.operators import evaluation as ev
from trackframe.operators import sweeps, tracking, trajectory
from trackframe.plans import views
from trackframe.streaming import tracks as stream


def run(spark, rows, n=None, **cfg):
    steps = tracking.track_sequences(dets(spark, rows), frames(spark, n) if n else None, (TrackerConfig(**cfg),)).persist()
    return {r.track_id: r for r in tracking.tracks_of(steps).collect()}, tracking.points_of(steps)


def test_moving_object(spark):
    t, p = run(spark, [(i, None, 10 + 4 * i, 10 + 3 * i) for i in range(4)])
    assert list(t) == ["track-0001"] and t["track-0001"].status == "confirmed" and p.count() == 4


def test_two_neighbours(spark):
    t, p = run(spark, [(i, None, 10 + 3 * i, y) for i in range(3) for y in (10, 20)])
    assert [r.status for r in t.values()] == ["confirmed"] * 2
    assert p.select("detection_id").distinct().count() == 6


def test_beyond_gate(spark):
    t, _ = run(spark, [(0, None, 10, 10), (1, None, 70, 70)], gate_distance_px=15.0)
    assert sorted(r.status for r in t.values()) == ["tentative"] * 2


def test_miss_limit(spark):
    t, _ = run(spark, [(0, None, 10, 10), (2, None, 12, 12)], 6)
    r = t["track-0001"]
    assert (r.status, r.observed_count, r.warnings) == ("ended", 2, ["Track ended after 3 consecutive missed frames."])


def test_one_gap_is_bridged(spark):
    rows = [(i, None, 20 + 5 * i, 20 + 3 * i) for i in (0, 1, 3, 4)]
    t, p = run(spark, rows, 5, gate_distance_px=15.0)
    assert len(t) == 1 and sorted(r.frame_index for r in p.collect()) == [0, 1, 3, 4]
    truth = truths(spark, [(i, 20 + 5 * i, 20 + 3 * i) for i in range(5)])
    m = ev.track_metrics(p, tracking.tracks_of(tracking.track_sequences(dets(spark, rows), frames(spark, 5))), truth).first()
    assert (m.tp, m.fn, m.coverage, m.id_switches) == (4, 1, 0.8, 0)


def test_gap_too_long(spark):
    t, _ = run(spark, [(i, None, 10 + 2 * i, 10) for i in (0, 1, 2, 6)], 7)
    assert [r.status for r in t.values()] == ["ended", "tentative"]


def test_ids_sort_as_text(spark):
    # c10 < c2: the first birth belongs to c10.
    _, p = run(spark, [(0, "c2", 10, 10), (0, "c10", 100, 100)])
    assert {r.detection_id: r.track_id for r in p.collect()} == {"c10": "track-0001", "c2": "track-0002"}


def case_rows():
    """The twelve scripted hard cases: (detections, truth, frames)."""
    line = lambda n, x, y, vx, vy, skip=(): [(i, x + vx * i, y + vy * i) for i in range(n) if i not in skip]
    cases = {
        1: (line(5, 50, 60, 8, 4), line(5, 50, 60, 8, 4), 5),
        2: (line(5, 40, 50, 6, 5, (2,)), line(5, 40, 50, 6, 5), 5),
        3: (line(6, 30, 30, 5, 4, (2, 3)), line(6, 30, 30, 5, 4), 6),
        8: (line(5, 100, 100, 0.3, 0.2), line(5, 100, 100, 0.3, 0.2), 5),
        9: (line(5, 30, 30, 19, 0), line(5, 30, 30, 19, 0), 5),
        10: ([], [], 5),
        11: (line(2, 50, 50, 5, 3), line(2, 50, 50, 5, 3), 5),
        12: ([(i + 2, 20 + 15 * i, 30 + 10 * i) for i in range(3)],) * 2 + (5,),
    }
    out = {}
    for k, (d, t, n) in cases.items():
        out[k] = ([(f, f"c{k}_d_{f}", x, y) for f, x, y in d], [(f, x, y, "t1") for f, x, y in t], n)
    two = [(i, f"c4_t{j}_d_{i}", 50 + 7 * i, y + 3 * i) for i in range(5) for j, y in ((1, 50), (2, 90))]
    out[4] = (two, [(f, x, y, i[3:5]) for f, i, x, y in two], 5)
    cross = [r for i in range(5) for r in ((i, f"c5_A_{i}", 60 + 20 * i, 100), (i, f"c5_B_{i}", 100, 60 + 20 * i))]
    out[5] = (cross, [(f, x, y, i[3]) for f, i, x, y in cross], 5)
    rng, d6 = np.random.default_rng(1006), []
    for i in range(5):
        tx, ty = 60 + 6 * i, 60 + 4 * i
        r, a = rng.uniform(8.0, 15.0), rng.uniform(0, 2 * math.pi)
        d6 += [(i, f"c6_true_{i}", tx, ty), (i, f"c6_clutter_{i}", tx + r * math.cos(a), ty + r * math.sin(a))]
    out[6] = (d6, [(i, 60 + 6 * i, 60 + 4 * i, "t1") for i in range(5)], 5)
    rng, d7 = np.random.default_rng(1007), []
    for i in range(5):
        for k in range(25):
            x = rng.uniform(10.0, 630.0)
            d7.append((i, f"c7_noise_{i}_{k}", x, rng.uniform(10.0, 470.0)))
    out[7] = (d7, [], 5)
    return out


# Detector P / R, tracked P / R, switches, false confirmed per case.
EXPECTED = {
    1: (1, 1, 1, 1, 0, 0), 2: (1, 0.8, 1, 0.8, 0, 0), 3: (1, 0.67, 1, 0.67, 0, 0), 4: (1, 1, 1, 1, 0, 0), 5: (1, 1, 1, 1, 0, 0),
    6: (0.5, 1, 0.5, 1, 1, 0), 7: (0, None, 0, None, 0, 1), 8: (1, 1, 1, 1, 0, 0), 9: (1, 1, 1, 1, 0, 0), 10: (None, None, None, None, 0, 0),
    11: (1, 1, None, 0, 0, 0), 12: (1, 1, 1, 1, 0, 0),
}


def test_twelve_hard_cases(spark):
    cases = case_rows()
    d = dets(spark, [(f"k{k}", f, i, x, y) for k, (rows, _, _) in cases.items() for f, i, x, y in rows])
    t = spark.createDataFrame(
        [(f"k{k}", f, f"g{k}-{n}", float(x), float(y), target, True) for k, (_, rows, _) in cases.items() for n, (f, x, y, target) in enumerate(rows)],
        "sequence_id string, frame_index int, truth_id string, x double, y double, target_id string, visible boolean",
    )
    f = spark.createDataFrame([(f"k{k}", i) for k, (_, _, n) in cases.items() for i in range(n)], "sequence_id string, frame_index int")
    steps = tracking.track_sequences(d, f).persist()
    counts = f.groupBy("sequence_id").agg(F.count("*").alias("frame_count"))
    rep = ev.ablation_report(d, tracking.points_of(steps), tracking.tracks_of(steps), t, counts, frames_are_small=True)
    short = lambda x: None if x is None else round(x, 2)
    got = {
        int(r.sequence_id[1:]): (
            short(r.detector_precision), short(r.detector_recall), short(r.tracking_precision), short(r.tracking_recall), r.id_switches, r.false_confirmed_tracks,
        )
        for r in rep.collect()
    }
    assert got == EXPECTED


def test_single_pass_rounds_and_stream_agree(spark, sf, tmp_path):
    d = views.detections(spark, sf).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    d = d.withColumns({"x": F.col("x_raw_px"), "y": F.col("y_raw_px")}).where("frame_index < 9").persist()
    f = views.frames(spark, sf).where("frame_index < 9").select("sequence_id", "frame_index")
    cfg = TrackerConfig("c", 40.0, 3, 1)
    cols = ["sequence_id", "track_no", "frame_index", "detection_id", "status", "observed_count", "misses"]
    one = tracking.track_sequences(d, f, (cfg,), sequences_are_small=True).select(*cols, F.round("quality_score", 9).alias("q")).persist()
    forced = tracking.track_sequences(d, f, (cfg,), sequence_rows=20).select(*cols, F.round("quality_score", 9).alias("q"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, forced.collect()))

    rows = d.select("sequence_id", "frame_index", "detection_id", "x", "y", "quality_score", F.lit(None).cast("int").alias("closes"))
    marks = f.select("sequence_id", F.lit(None).cast("int").alias("frame_index"), F.lit(None).cast("string").alias("detection_id"), *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "quality_score")], F.col("frame_index").cast("int").alias("closes"))
    # Three files, read one per batch: rows of frames 0-3, the rest with a late copy, markers last.
    a = rows.where("frame_index < 4").unionByName(marks.where("closes < 3"))
    b = rows.where("frame_index >= 4").unionByName(rows.where("frame_index = 1")).unionByName(marks)
    for n, part in enumerate((a, b)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/batch={n}"))
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = stream.run_available(stream.track_stream(src, cfg)).persist()
    assert out.where("event = 'late'").count() == rows.where("frame_index = 1").count()
    streamed = out.where("event = 'observed'").select("sequence_id", "track_no", "frame_index", "detection_id")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, one.select(*cols[:4]).collect()))
    last = out.where("event <> 'late'").groupBy("sequence_id", "track_no").agg(F.max_by(F.struct("status", "observed_count"), "frame_index").alias("s"))
    final = one.select("sequence_id", "track_no", "status", "observed_count").distinct()
    assert sorted((r.sequence_id, r.track_no, r.s.status, r.s.observed_count) for r in last.collect()) == sorted(map(tuple, final.collect()))


@pytest.mark.parametrize("batches", [1, 10])
def test_stream_equals_batch_however_it_is_split(spark, sf, batches):
    from trackframe.plans.sources import staged

    d = views.detections(spark, sf).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    want = tracking.track_sequences(d).select("sequence_id", "track_no", "frame_index", "detection_id")
    out = stream.run_available(stream.track_stream(staged(spark, sf, batches)))
    assert out.where("event = 'late'").isEmpty()
    got = out.where("event = 'observed'").select("sequence_id", "track_no", "frame_index", "detection_id")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()


def test_watermark_closes_frames(spark, tmp_path):
    rows = [("s", f, f"d{f}{k}", 1.0 * k * 50, 0.0, 0.5, 86400 + 60 * f) for f in range(5) for k in range(2)]
    make = lambda part: spark.createDataFrame(part, "sequence_id string, frame_index int, detection_id string, x double, y double, quality_score double, at int").withColumn("at", F.timestamp_seconds("at"))
    for n, part in enumerate((rows[:3] + rows[5:6], rows[3:5] + rows[6:], [("t", 0, "x", 0.0, 0.0, 0.5, 90000)], [("t", 1, "y", 0.0, 0.0, 0.5, 90060)])):
        make(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(make(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream.run_available(stream.track_stream(src, time="at", delay="5 minutes"), folder=str(tmp_path / "out"))
    got = sorted((r.frame_index, r.detection_id) for r in out.where("event = 'observed' and sequence_id = 's'").collect())
    assert got == [(r[1], r[2]) for r in rows] and out.where("event = 'late'").isEmpty()


def test_frame_waits_for_its_latest_row(spark, tmp_path):
    """Rows of frame 0 at 0, 8 and 9 hours with an hour's delay: the third comes when the watermark stands at 7 hours."""
    at = lambda h: 86400 + int(3600 * h)
    parts = [[("s", 0, "a", 0.0, at(0))], [("s", 0, "b", 50.0, at(8))], [("t", 0, "x", 0.0, at(8))], [("s", 0, "c", 90.0, at(9)), ("s", 1, "d", 0.5, at(9.5))], [("t", 9, "y", 0.0, at(99))]]
    make = lambda part: spark.createDataFrame(part, "sequence_id string, frame_index int, detection_id string, x double, at int").select("*", F.lit(0.0).alias("y"), F.lit(0.5).alias("quality_score")).withColumn("at", F.timestamp_seconds("at"))
    for part in parts:
        make(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(make(parts[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream.run_available(stream.track_stream(src, time="at", delay="1 hour"), folder=str(tmp_path / "out"))
    got = sorted((r.frame_index, r.event, r.detection_id) for r in out.where("sequence_id = 's' and detection_id is not null").collect())
    assert got == [(0, "observed", "a"), (0, "observed", "b"), (0, "observed", "c"), (1, "observed", "d")]


@pytest.mark.parametrize("batches", [1, 10])
def test_stream_metrics_equal_batch(spark, sf, batches, monkeypatch):
    from trackframe.operators import evaluation
    from trackframe.plans import sources

    monkeypatch.setattr(sources, "SLICES", batches)
    keys = ["sequence_id", "frame_index"]
    det, truth = views.detections(spark, sf), views.visible_truth(spark, sf)
    want = evaluation.outcome_counts(det, views.truth(spark, sf), 5.0, keys, keys).select(*keys, "tp", "fp", "fn")
    a, delay = sources.timed(spark, det.select(*keys, "detection_id", "x", "y"), "detection_id")
    b, _ = sources.timed(spark, truth.select(*keys, "truth_id", "x", "y"), "truth_id")
    got = stream.run_available(stream.frame_metrics_stream(a, b, 5.0, delay=delay, lasts="1 day")).select(*keys, "tp", "fp", "fn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_result_does_not_depend_on_partitions(spark, sf):
    d = views.detections(spark, sf).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    a = tracking.track_sequences(d, sequences_are_small=True).drop("timestamp_s")
    b = tracking.track_sequences(d.orderBy(F.rand(3)).repartition(7), sequences_are_small=True).drop("timestamp_s")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < a.count()


def plain_tracker(rows, n, gate, confirm, misses):
    """Independent frame loop with exhaustive matching, for small scenes."""
    active, done, no = [], [], 0
    for f in range(n):
        ds = sorted((r for r in rows if r[0] == f), key=lambda r: r[1])
        spots = []
        for t in active:
            (f1, x1, y1), *rest = t["h"][::-1]
            if rest:
                f0, x0, y0 = rest[0]
                spots.append((x1 + (x1 - x0) / (f1 - f0) * (f - f1), y1 + (y1 - y0) / (f1 - f0) * (f - f1)))
            else:
                spots.append((x1, y1))
        best = (0, 0.0, {})

        def go(i, used, k, c, m):
            nonlocal best
            if i == len(spots):
                if k > best[0] or (k == best[0] and c < best[1] - 1e-12):
                    best = (k, c, dict(m))
                return
            for j, r in enumerate(ds):
                w = math.dist(spots[i], r[2:])
                if w <= gate and j not in used:
                    go(i + 1, used | {j}, k + 1, c + w, {**m, i: j})
            go(i + 1, used, k, c, m)

        go(0, frozenset(), 0, 0.0, {})
        keep = []
        for i, t in enumerate(active):
            if i in best[2]:
                r = ds[best[2][i]]
                t["h"].append((f, *r[2:])), t["ids"].append(r[1])
                t["m"] = 0
                keep.append(t)
            else:
                t["m"] += 1
                (done if t["m"] > misses else keep).append(t)
        for j, r in enumerate(ds):
            if j not in best[2].values():
                no += 1
                keep.append({"no": no, "h": [(f, *r[2:])], "ids": [r[1]], "m": 0})
        active = keep
    state = lambda t, over: (t["no"], tuple(t["ids"]), "ended" if over else "confirmed" if len(t["ids"]) >= confirm else "tentative")
    return sorted([state(t, True) for t in done] + [state(t, False) for t in active])


@pytest.mark.parametrize("gate,confirm,misses", [(20.0, 3, 2), (8.0, 3, 0), (45.0, 4, 1)])
def test_tracker_equals_plain_loop(spark, gate, confirm, misses):
    rng = np.random.default_rng(5)
    rows = [(f, f"d{f}-{k}", float(rng.uniform(0, 90)), float(rng.uniform(0, 90))) for f in range(10) for k in range(rng.integers(0, 5))]
    steps = tracking.track_sequences(dets(spark, rows), frames(spark, 10), (TrackerConfig("c", gate, confirm, misses),))
    got: dict = {}
    for r in steps.orderBy("track_no", "obs_no").collect():
        got.setdefault((r.track_no, r.status), []).append(r.detection_id)
    assert sorted((no, tuple(ids), s) for (no, s), ids in got.items()) == plain_tracker(rows, 10, gate, confirm, misses)


def test_trace_explains_the_tracks(spark):
    rows = [(0, "a", 10, 10), (0, "b", 30, 10), (1, "c", 12, 10), (1, "d", 200, 200), (2, "e", 14, 10)]
    trace = tracking.association_trace(dets(spark, rows), frames(spark, 3)).collect()
    at = lambda f, e: [r for r in trace if r.frame_index == f and r.event == e]
    assert {r.detection_id for r in at(0, "birth")} == {"a", "b"} and [r.detection_id for r in at(1, "birth")] == ["d"]
    assert [(r.track_no, r.detection_id, r.selected) for r in at(1, "pair")] == [(1, "c", True), (2, "c", False)]
    assert [r.rejected_pairs for r in at(1, "frame")] == [2] and [r.track_no for r in at(1, "missed")] == [2]
    assert [(r.x_predicted, r.distance) for r in at(2, "pair") if r.selected] == [(14.0, 0.0)]


def test_sweep_order_of_gates(spark, sf):
    d = views.detections(spark, sf).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    f = views.frames(spark, sf).select("sequence_id", "frame_index")
    rows = {r.config_id[:2]: r for r in sweeps.tracking_sweep(d, f, views.truth(spark, sf), sequences_are_small=True).collect()}
    assert len(rows) == 9 and rows["A_"].tp == rows["C1"].tp
    assert rows["D1"].total_tracks > rows["D2"].total_tracks > rows["A_"].total_tracks > rows["D3"].total_tracks
    assert rows["C3"].tp <= rows["C2"].tp <= rows["C1"].tp


def test_forecast_of_exact_motion(spark):
    rows = [(f"q{k}", f, None, 30 + 7 * k + (k - 4) * 1.5 * f, 40 + (3 - k) * 0.75 * f) for k in range(8) for f in range(5)]
    steps = tracking.track_sequences(dets(spark, [r for r in rows if r[1] < 3]))
    p = tracking.points_of(steps)
    truth = dets(spark, rows).select("sequence_id", "frame_index", F.col("x").alias("x_reference_px"), F.col("y").alias("y_reference_px"), F.lit("track-0001").alias("track_id"))
    e = trajectory.forecast_error(trajectory.extrapolate(trajectory.fit_velocity(p)), trajectory.zero_order_forecast(p), truth).orderBy("step").collect()
    assert all(r.velocity_rmse_px < 1e-10 < 1 < r.hold_rmse_px for r in e) and e[1].hold_rmse_px > e[0].hold_rmse_px


@pytest.mark.parametrize("buckets", [1, 5])
def test_state_is_shared_by_sequences(spark, tmp_path, buckets):
    """Sequences of one bucket close on their own: by their marks, their ends, or the watermark."""
    make = lambda part: spark.createDataFrame(part, "sequence_id string, frame_index int, detection_id string, x double, closes int, ends boolean, at int").select("*", F.lit(0.0).alias("y"), F.lit(0.5).alias("quality_score")).withColumn("at", F.timestamp_seconds("at"))
    row = lambda s, f, at: (s, f, f"{s}{f}", float(f), None, None, at)
    parts = [
        [row("a", 0, 100), row("b", 0, 100), row("c", 0, 5000)], [row("a", 1, 200), row("b", 1, 9000), ("a", None, None, None, 0, None, 200)],
        [row("a", 0, 8800), ("a", None, None, None, None, True, 8800)], [row("c", 1, 9100)], [row("z", 9, 99999)], [row("z", 10, 99999)],
    ]
    for part in parts:
        make(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(make(parts[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream.run_available(stream.track_stream(src, time="at", delay="1 hour", buckets=buckets), folder=str(tmp_path / "out"))
    got = sorted((r.sequence_id, r.frame_index, r.event, r.track_no) for r in out.where("detection_id is not null and sequence_id <> 'z'").collect())
    assert got == [("a", 0, "late", None), ("a", 0, "observed", 1), ("a", 1, "observed", 1), *[(s, f, "observed", 1) for s in "bc" for f in (0, 1)]]


def test_frames_of_one_bucket_are_matched_apart(spark, tmp_path):
    make = lambda part, name: spark.createDataFrame(part, f"sequence_id string, frame_index int, {name} string, x double, at int").select("*", F.lit(0.0).alias("y")).withColumn("event_time", F.timestamp_seconds("at")).drop("at")
    rows = [[("s", 0, "a", 0.0, 100), ("t", 0, "b", 0.0, 9000)], [("s", 1, "c", 9.0, 9000), ("u", 0, "d", 0.0, 20000)], [("", 9, "z", 0.0, 99999)], [("", 10, "z", 0.0, 99999)]]
    sides = []
    for name in ("detection_id", "truth_id"):
        for part in rows:
            make(part, name).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(make(rows[0], name).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    out = stream.run_available(stream.frame_metrics_stream(*sides, buckets=1), folder=str(tmp_path / "out"))
    got = sorted(map(tuple, out.where("sequence_id <> ''").collect()))
    assert got == [(s, f, 1, 0, 0, 0.0) for s, f in (("s", 0), ("s", 1), ("t", 0), ("u", 0))]


def test_state_has_a_few_partitions_a_core(spark, tmp_path):
    """A session of 40 shuffle partitions on four cores: eight partitions of state for either operator, settings as before."""
    make = lambda part, name: spark.createDataFrame(part, f"sequence_id string, frame_index int, {name} string, x double, at int").select("*", F.lit(0.0).alias("y"), F.timestamp_seconds("at").alias("event_time")).drop("at")
    rows = [[(f"s{k}", 0, "a", 0.0, 100) for k in range(30)], [("", 9, "z", 0.0, 99999)], [("", 10, "z", 0.0, 99999)]]
    sides = []
    for name in ("detection_id", "truth_id"):
        for part in rows:
            make(part, name).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(make(rows[0], name).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = stream.run_available(stream.frame_metrics_stream(*sides), folder=str(tmp_path / "out"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40" and all(spark.conf.get(k, None) != v for k, v in stream.ROCKSDB.items() if "provider" in k)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, out.where("sequence_id <> ''").collect())) == sorted((f"s{k}", 0, 1, 0, 0, 0.0) for k in range(30))
    stored = [sum(p.name.isdigit() for p in op.iterdir()) for op in (tmp_path / "out/checkpoint/state").iterdir()]
    assert stored == [stream.CORE_STATES * spark.sparkContext.defaultParallelism] * 2 == [8, 8]


def test_staged_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One task reads this table; its stream has a file from each of four tasks, and the ends come last."""
    from trackframe.plans import sources

    monkeypatch.setattr(sources, "ensure_checkpoint_dir", lambda _: str(tmp_path))
    rows = spark.range(400).selectExpr("id as event_id", "timestamp'2024-01-01 12:00:00' + make_interval(0, 0, 0, int(id % 3)) as ts", "id % 20 as user_id", "'view' as event_type", "double(id) as value", "'{\"k\": 1}' as props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sources.staged(spark, str(tmp_path), 2)
    out = spark.read.parquet(*map(str, tmp_path.glob("stream-*"))).select("*", F.input_file_name().alias("file"), F.col("_metadata.file_modification_time").alias("written"))
    assert out.where("not ends").agg(F.countDistinct("detection_id"), F.count("*"), F.countDistinct("file")).first()[:] == (400, 400, 4)
    assert out.where("ends").agg(F.countDistinct("sequence_id"), F.count("*")).first()[:] == (20, 20)
    assert out.where("ends").agg(F.min("written")).first()[0] >= out.where("not ends").agg(F.max("written")).first()[0]


def test_rows_without_times_reach_the_tracker_in_blocks(spark, tmp_path):
    """A NULL name, position or quality goes through blocks and state as it came; late rows come out as such."""
    import pyarrow as pa

    rows = [(s, f, f"{s}{f}", None if f == 1 else 1.0 * f, None if s else 0.5) for s in ("a", None) for f in range(3)]
    make = lambda part, closes, ends: spark.createDataFrame(part, "sequence_id string, frame_index int, detection_id string, x double, quality_score double").select("*", F.lit(0.0).alias("y"), F.lit(closes).cast("int").alias("closes"), F.lit(ends).alias("ends"))
    mark = [(s, None, None, None, None) for s in ("a", None)]
    for part in (make(rows[:1] + rows[3:4], None, None), make(rows, 0, False), make(rows[:1], None, None), make(mark, None, True)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(make(mark, 0, True).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream.run_available(stream.track_stream(src, buckets=3), folder=str(tmp_path / "out")).where("detection_id is not null")
    got = sorted((r.sequence_id or "", r.frame_index, r.event, r.x_reference_px, r.quality_score) for r in out.collect())
    kept = [(s or "", f, "observed", x, q if s is None else 0.0) for s, f, _, x, q in rows]
    assert got == sorted([*kept, ("a", 0, "observed", 0.0, 0.0), ("", 0, "observed", 0.0, 0.5), ("a", 0, "late", 0.0, None)], key=lambda r: r[:3])

    table = pa.table({c: pa.nulls(50_000, t) if c != "frame_index" else pa.array(range(50_000), t) for c, t in zip(stream.ROWS.names, stream.ROWS.types)})
    table = table.append_column("bucket", pa.array([k % 7 for k in range(50_000)], pa.int32()))
    blocks = [b for part in stream._dealt(table.to_batches(max_chunksize=1_000)) for b in zip(*part.to_pydict().values())]
    assert [k for k, _ in blocks] == list(range(7))
    assert all(stream._unpacked(b).equals(table.filter(pa.compute.equal(table["bucket"], k)).select(stream.ROWS.names).combine_chunks()) for k, b in blocks)
