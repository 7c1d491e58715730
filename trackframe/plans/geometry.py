"""Queries: coordinate spaces and registration tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import geometry as g
from trackframe.plans import views as v
from trackframe.plans.registry import query
from trackframe.plans.trajectory import r6


def raw_points(spark, d):
    return v.detections(spark, d).select("sequence_id", "frame_index", "detection_id", F.col("x").alias("x_raw_px"), F.col("y").alias("y_raw_px"))


@query("to_reference", v.sql("detections transforms", """
    SELECT d.sequence_id, d.frame_index, d.detection_id, round(x + tx, 6) AS x_reference_px, round(y + ty, 6) AS y_reference_px
    FROM detections d JOIN transforms t USING (sequence_id, frame_index) WHERE d.sequence_id NOT IN (SELECT sequence_id FROM transforms WHERE status = 'failed')"""))
def _(spark, d):
    p = g.to_reference(raw_points(spark, d), v.transforms(spark, d))
    return p.select("sequence_id", "frame_index", "detection_id", *r6("x_reference_px", "y_reference_px"))


@query("to_raw", v.sql("points transforms", """
    SELECT d.sequence_id, d.frame_index, d.detection_id, round(x_reference_px - tx, 6) AS x_raw_px, round(y_reference_px - ty, 6) AS y_raw_px
    FROM points d JOIN transforms t USING (sequence_id, frame_index) WHERE d.sequence_id NOT IN (SELECT sequence_id FROM transforms WHERE status = 'failed')"""))
def _(spark, d):
    p = g.to_reference(v.points(spark, d), v.transforms(spark, d), inverse=True)
    return p.select("sequence_id", "frame_index", "detection_id", *r6("x_raw_px", "y_raw_px"))


@query("registration_status", v.sql("transforms", """
    SELECT sequence_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'estimated' END AS status,
      coalesce(string_agg(CASE WHEN status = 'failed' THEN CAST(frame_index AS VARCHAR) END, ',' ORDER BY frame_index), '') AS failed_frames
    FROM transforms GROUP BY 1"""))
def _(spark, d):
    return g.registration_status(v.transforms(spark, d)).withColumn("failed_frames", F.array_join("failed_frames", ","))


# Frames with an odd detection count play the frames whose own fit failed.
ANCHOR = """st AS (SELECT t.sequence_id, t.frame_index, t.tx, t.ty, CASE WHEN t.status = 'failed' OR coalesce(n, 0) % 2 = 1 THEN 'failed' ELSE 'estimated' END AS status
      FROM transforms t LEFT JOIN (SELECT sequence_id, frame_index, count(*) AS n FROM detections GROUP BY ALL) USING (sequence_id, frame_index)),
    an AS (SELECT s.*, (SELECT max(a.frame_index) FROM st a WHERE a.sequence_id = s.sequence_id AND a.frame_index < s.frame_index AND a.frame_index > 0 AND a.status = 'estimated') AS anchor_frame FROM st s)"""


def shaky_transforms(spark, d):
    n = v.detections(spark, d).groupBy("sequence_id", "frame_index").agg(F.count("*").alias("n"))
    t = v.transforms(spark, d).join(n, ["sequence_id", "frame_index"], "left")
    bad = (F.col("status") == "failed") | (F.coalesce("n", F.lit(0)) % 2 == 1)
    return t.withColumn("status", F.when(bad, "failed").otherwise("estimated")).drop("n")


@query("anchor_frame", v.sql("transforms detections", "SELECT sequence_id, frame_index, anchor_frame FROM an", ANCHOR))
def _(spark, d):
    return g.anchor_frame(shaky_transforms(spark, d)).select("sequence_id", "frame_index", F.col("anchor.frame").alias("anchor_frame"))


@query("compose_shift", v.sql("transforms detections", """
    SELECT n.sequence_id, n.frame_index, n.anchor_frame, CASE WHEN sqrt((a.tx + 3) ** 2 + (a.ty - 1) ** 2) <= 12 THEN a.tx + 3 END AS tx,
      CASE WHEN sqrt((a.tx + 3) ** 2 + (a.ty - 1) ** 2) <= 12 THEN a.ty - 1 END AS ty,
      CASE WHEN sqrt((a.tx + 3) ** 2 + (a.ty - 1) ** 2) <= 12 THEN 'seeded' ELSE 'shift_exceeds_limit' END AS status
    FROM an n JOIN st a ON a.sequence_id = n.sequence_id AND a.frame_index = n.anchor_frame""", ANCHOR))
def _(spark, d):
    t = shaky_transforms(spark, d)
    pair = t.select("sequence_id", "frame_index", F.lit(3.0).alias("dx"), F.lit(-1.0).alias("dy"))
    return g.compose_shift(g.anchor_frame(t), pair, 12.0)


@query("apply_homography", v.sql("detections", """
    SELECT detection_id, CASE WHEN abs(w) >= 1e-10 THEN round((x * 1.5 + y * 0.25 + 3) / w, 6) END AS x_mapped,
      CASE WHEN abs(w) >= 1e-10 THEN round((y * 0.75 - 2) / w, 6) END AS y_mapped FROM (SELECT *, x * 0.01::DOUBLE + y * -0.02::DOUBLE + 1 AS w FROM detections)"""))
def _(spark, d):
    rows = [[1.5, 0.25, 3.0], [0.0, 0.75, -2.0], [0.01, -0.02, 1.0]]
    matrix = F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows])
    p = g.apply_homography(v.detections(spark, d).withColumn("matrix", matrix))
    return p.select("detection_id", *r6("x_mapped", "y_mapped"))


@query("coordinate_choice", v.sql("contract_detections", """
    SELECT detection_id, round(CASE WHEN x_reference_px IS NOT NULL AND y_reference_px IS NOT NULL THEN x_reference_px ELSE x_raw_px END, 6) AS x,
      round(CASE WHEN x_reference_px IS NOT NULL AND y_reference_px IS NOT NULL THEN y_reference_px ELSE y_raw_px END, 6) AS y FROM contract_detections"""))
def _(spark, d):
    return g.coordinate_choice(v.contract_detections(spark, d)).select("detection_id", *r6("x", "y"))


@query("transform_error", v.sql("transforms", """
    SELECT sequence_id, round(max(e), 6) AS max_shift_error_px, round(sqrt(avg(e * e)), 6) AS shift_rmse_px FROM (
      SELECT sequence_id, sqrt((tx - frame_index * 0.4::DOUBLE) ** 2 + (ty + frame_index * 0.3::DOUBLE) ** 2) AS e FROM transforms WHERE status <> 'failed') GROUP BY 1"""))
def _(spark, d):
    t = v.transforms(spark, d)
    shifts = t.select("sequence_id", "frame_index", (F.col("frame_index") * -0.4).alias("dx"), (F.col("frame_index") * 0.3).alias("dy"))
    return g.transform_error(t, shifts)[1].select("sequence_id", *r6("max_shift_error_px", "shift_rmse_px"))


@query("orient_point", v.sql("base", f"""
    SELECT event_id, round(CASE o WHEN 2 THEN w - x WHEN 3 THEN w - x WHEN 5 THEN y WHEN 6 THEN h - y WHEN 7 THEN h - y WHEN 8 THEN y ELSE x END, 6) AS x,
      round(CASE o WHEN 3 THEN h - y WHEN 4 THEN h - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN w - x WHEN 8 THEN w - x ELSE y END, 6) AS y
    FROM (SELECT *, event_id % 8 + 1 AS o, {v.WIDTH - 1} AS w, {v.HEIGHT - 1} AS h FROM base)"""))
def _(spark, d):
    b = v.base(spark, d).withColumn("o", F.col("event_id") % 8 + 1)
    x, y = g.orient_point("x", "y", F.lit(v.WIDTH), F.lit(v.HEIGHT), "o")
    return b.select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


# Consensus by plain SQL: support and median residual by self join, then three medians.
CONSENSUS = """cs AS (SELECT sequence_id, frame_index, feature_ix, ref_x - raw_x AS sx, ref_y - raw_y AS sy FROM correspondences),
    sup AS (SELECT a.sequence_id, a.frame_index, a.feature_ix, a.sx, a.sy, count(*) AS n, median(sqrt((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2)) AS m
      FROM cs a JOIN cs b USING (sequence_id, frame_index) WHERE sqrt((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2) <= 1.25 GROUP BY ALL),
    s0 AS (SELECT sequence_id, frame_index, sx AS tx, sy AS ty FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY n DESC, m, feature_ix) AS rn FROM sup) WHERE rn = 1),
    s1 AS (SELECT c.sequence_id, c.frame_index, median(sx) AS tx, median(sy) AS ty FROM cs c JOIN s0 s USING (sequence_id, frame_index) WHERE sqrt((sx - tx) ** 2 + (sy - ty) ** 2) <= 1.25 GROUP BY ALL),
    s2 AS (SELECT c.sequence_id, c.frame_index, median(sx) AS tx, median(sy) AS ty FROM cs c JOIN s1 s USING (sequence_id, frame_index) WHERE sqrt((sx - tx) ** 2 + (sy - ty) ** 2) <= 1.25 GROUP BY ALL),
    s3 AS (SELECT c.sequence_id, c.frame_index, median(sx) AS tx, median(sy) AS ty FROM cs c JOIN s2 s USING (sequence_id, frame_index) WHERE sqrt((sx - tx) ** 2 + (sy - ty) ** 2) <= 1.25 GROUP BY ALL)"""


@query("translation_consensus", v.sql("correspondences", """
    SELECT c.sequence_id, c.frame_index, c.feature_ix, round(tx, 6) + 0.0::DOUBLE AS tx, round(ty, 6) + 0.0::DOUBLE AS ty, sqrt((sx - tx) ** 2 + (sy - ty) ** 2) <= 1.25 AS inlier
    FROM cs c JOIN s3 s USING (sequence_id, frame_index)""", CONSENSUS))
def _(spark, d):
    fitted, _ = g.translation_consensus(v.correspondences(spark, d))
    return fitted.select("sequence_id", "frame_index", "feature_ix", *r6("tx", "ty"), "inlier")


LOOSE = {**g.REGISTRATION, "min_inliers": 2, "min_axis_coverage": 0.01}
GATES = CONSENSUS.replace("FROM correspondences)", """FROM correspondences WHERE feature_ix % 5 <> 0 AND (sequence_id, frame_index) IN (
      SELECT (sequence_id, frame_index) FROM correspondences GROUP BY sequence_id, frame_index HAVING count(*) FILTER (feature_ix % 5 <> 0) >= 2 AND count(*) FILTER (feature_ix % 5 = 0) >= 1))""") + """,
    rs AS (SELECT c.*, s.tx, s.ty, feature_ix % 5 = 0 AS res, sqrt((raw_x + tx - ref_x) ** 2 + (raw_y + ty - ref_y) ** 2) AS r FROM correspondences c JOIN s3 s USING (sequence_id, frame_index)),
    ag AS (SELECT sequence_id, frame_index, any_value(tx) AS tx, any_value(ty) AS ty, count(*) FILTER (NOT res) AS fm, count(*) FILTER (res) AS vm,
      count(*) FILTER (NOT res AND r <= 1.25) AS fi, count(*) FILTER (res AND r <= 1.25) AS vi, sqrt(avg(r * r) FILTER (res AND r <= 1.25)) AS vr,
      (max(ref_x) FILTER (NOT res AND r <= 1.25) - min(ref_x) FILTER (NOT res AND r <= 1.25)) / 512.0::DOUBLE AS cx,
      (max(ref_y) FILTER (NOT res AND r <= 1.25) - min(ref_y) FILTER (NOT res AND r <= 1.25)) / 128.0::DOUBLE AS cy FROM rs GROUP BY ALL),
    gt AS (SELECT f.sequence_id, f.frame_index, coalesce(a.fi, 0) AS fit_inliers, concat_ws(',', CASE WHEN a.tx IS NULL THEN 'insufficient_verified_matches' END,
      CASE WHEN a.fi < 2 OR a.fi / a.fm::DOUBLE < 0.6 THEN 'weak_translation_consensus' END,
      CASE WHEN a.vi < 1 OR a.vi / a.vm::DOUBLE < 0.6 OR (a.tx IS NOT NULL AND a.vr IS NULL) OR a.vr > 0.8 THEN 'validation_residual_or_support_failed' END,
      CASE WHEN a.tx IS NOT NULL AND least(coalesce(cx, 0), coalesce(cy, 0)) < 0.01 THEN 'features_not_spatially_distributed' END,
      CASE WHEN a.tx IS NOT NULL AND (sqrt(a.tx ** 2 + a.ty ** 2) > 250 OR greatest(0, 512 - abs(a.tx)) * greatest(0, 128 - abs(a.ty)) / (512 * 128) < 0.45) THEN 'shift_or_overlap_exceeds_limit' END) AS reasons,
      a.tx FROM frames f LEFT JOIN ag a USING (sequence_id, frame_index))"""


@query("registration_gates", v.sql("correspondences frames", """
    SELECT sequence_id, frame_index, fit_inliers, reasons, CASE WHEN reasons = '' THEN 'estimated' ELSE 'failed' END AS status,
      CASE WHEN reasons = '' THEN round(tx, 6) + 0.0::DOUBLE END AS tx FROM gt""", GATES))
def _(spark, d):
    r = g.registration_gates(v.correspondences(spark, d), v.frames(spark, d), LOOSE, min_validation=1)
    return r.select(
        "sequence_id", "frame_index", F.coalesce("fit_inliers", F.lit(0)).alias("fit_inliers"), F.array_join("reasons", ",").alias("reasons"),
        "status", *r6("tx"),
    )
