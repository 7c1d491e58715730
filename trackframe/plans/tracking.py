"""Queries: the tracker and everything that reads its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import sweeps as sw
from trackframe.operators import tracking as t
from trackframe.operators import trajectory as r
from trackframe.plans import views as v
from trackframe.plans.registry import query
from trackframe.plans.trajectory import r6


def steps(spark, d, configs=(t.TrackerConfig(),), **options):
    det = v.detections(spark, d).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    return t.track_sequences(det, v.frames(spark, d).select("sequence_id", "frame_index", "timestamp_s"), configs, **options)


@query("track_sequences")
def _(spark, d):
    s = t.points_of(steps(spark, d))
    return s.select("sequence_id", "track_id", "frame_index", "detection_id", *r6("x_reference_px", "y_reference_px"), "timestamp_s")


@query("tracks")
def _(spark, d):
    return t.tracks_of(steps(spark, d)).select("sequence_id", "track_id", "status", "observed_count", *r6("quality_score"), "first_frame", F.array_join("warnings", ";").alias("warnings"))


@query("tracks_registered")
def _(spark, d):
    # One frame without a transform blocks its whole sequence.
    det = v.contract_detections(spark, d)
    det = det.join(det.where("x_reference_px is null").select("sequence_id").distinct(), "sequence_id", "left_anti")
    return t.tracks_of(t.track_sequences(det, v.frames(spark, d), space="reference")).groupBy("sequence_id", "status").agg(F.count("*").alias("tracks"))


@query("association_trace")
def _(spark, d):
    det = v.detections(spark, d).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    return t.association_trace(det, v.frames(spark, d)).drop("config_id")


# Every detection is observed exactly once, so the totals of the tracker are checkable.
@query("tracked_detections", v.sql("detections", "SELECT sequence_id, frame_index, count(*) AS observed FROM detections GROUP BY ALL"))
def _(spark, d):
    return steps(spark, d).groupBy("sequence_id", "frame_index").agg(F.count("*").alias("observed"))


# With a gate below every distance no track ever continues: one track per detection.
@query("tracks_without_association", v.sql("detections", """
    SELECT sequence_id, CASE WHEN frame_index < 27 THEN 'ended' ELSE 'tentative' END AS status, count(*) AS tracks, CAST(sum(first) AS BIGINT) AS first_frames FROM (
      SELECT *, frame_index AS first FROM detections) GROUP BY ALL"""))
def _(spark, d):
    tiny = t.TrackerConfig("tiny", gate_distance_px=1e-9)
    return t.tracks_of(steps(spark, d, (tiny,))).groupBy("sequence_id", "status").agg(F.count("*").alias("tracks"), F.sum("first_frame").alias("first_frames"))


@query("tracking_sweep")
def _(spark, d):
    det = v.detections(spark, d).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    s = sw.tracking_sweep(det, v.frames(spark, d).select("sequence_id", "frame_index"), v.truth(spark, d))
    return s.select("config_id", "tp", "fp", "fn", *r6("precision", "recall", "f1", "localization_rmse_px"), "id_switches", "false_confirmed_tracks", "total_tracks")


@query("tracked_trajectories")
def _(spark, d):
    f = r.fit_velocity(t.points_of(steps(spark, d)))
    return f.where("status = 'fitted'").select("sequence_id", "track_id", *r6("vx", "vy", "speed", "fit_rmse_px"), "observations_used")


@query("predicted_position", v.sql("points", """
    SELECT sequence_id, track_id, frame_index, round(CASE WHEN f2 IS NULL THEN x1 ELSE x1 + (x1 - x2) / (f1 - f2) * (frame_index - f1) END, 6) AS x_predicted,
      round(CASE WHEN f2 IS NULL THEN y1 ELSE y1 + (y1 - y2) / (f1 - f2) * (frame_index - f1) END, 6) AS y_predicted FROM (
      SELECT sequence_id, track_id, frame_index, lag(frame_index) OVER w AS f1, lag(frame_index, 2) OVER w AS f2, lag(x_reference_px) OVER w AS x1, lag(x_reference_px, 2) OVER w AS x2,
        lag(y_reference_px) OVER w AS y1, lag(y_reference_px, 2) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY frame_index)) WHERE f1 IS NOT NULL"""))
def _(spark, d):
    return t.predicted_position(v.points(spark, d)).select("sequence_id", "track_id", "frame_index", *r6("x_predicted", "y_predicted"))


@query("track_summary", v.sql("tracks", "SELECT sequence_id, track_id, observed_count, round(quality_score, 6) AS quality_score, first_frame, last_frame FROM tracks"))
def _(spark, d):
    return t.track_summary(v.points(spark, d)).select("sequence_id", "track_id", "observed_count", *r6("quality_score"), "first_frame", "last_frame")


@query("lifecycle", v.sql("tracks", """
    SELECT sequence_id, track_id, status, CASE WHEN status = 'ended' THEN 'Track ended after 3 consecutive missed frames.' ELSE '' END AS warnings FROM tracks"""))
def _(spark, d):
    return v.tracks(spark, d).select("sequence_id", "track_id", "status", F.array_join("warnings", ";").alias("warnings"))


@query("tracks_with_status", v.sql("tracks", "SELECT sequence_id, track_id, observed_count FROM tracks WHERE status = 'confirmed'"))
def _(spark, d):
    return t.tracks_with_status(v.tracks(spark, d), "confirmed").select("sequence_id", "track_id", "observed_count")


@query("accepted_observations", v.sql("tracks", """
    SELECT p.sequence_id, p.track_id, p.frame_index, p.detection_id FROM points p JOIN tracks t USING (sequence_id, track_id)
    WHERE t.status = 'confirmed' OR (t.status = 'ended' AND t.observed_count >= 3)"""))
def _(spark, d):
    a = t.accepted_observations(v.points(spark, d), v.tracks(spark, d), ["sequence_id", "track_id"])
    return a.select("sequence_id", "track_id", "frame_index", "detection_id")


@query("track_snapshots", v.sql("tracks frames", """
    SELECT k.sequence_id, k.track_id, f.frame_index, count(p.frame_index) AS observed_count, CASE WHEN f.frame_index - max(p.frame_index) > 2 THEN 'ended'
      WHEN count(p.frame_index) >= 3 THEN 'confirmed' ELSE 'tentative' END AS status FROM tracks k JOIN frames f ON f.sequence_id = k.sequence_id AND f.frame_index >= k.first_frame
    JOIN points p ON p.sequence_id = k.sequence_id AND p.track_id = k.track_id AND p.frame_index <= f.frame_index GROUP BY k.sequence_id, k.track_id, f.frame_index"""))
def _(spark, d):
    return t.track_snapshots(v.points(spark, d), v.frames(spark, d))
