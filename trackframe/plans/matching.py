"""Queries: joins and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import matching as m
from trackframe.plans import views as v
from trackframe.plans.registry import query

FRAME_BOUND = True  # the views hold about 2.5 points per frame at every scale


def pairs(spark, d, gate=5.0):
    return m.match_points(v.detections(spark, d), v.visible_truth(spark, d), gate).pairs


@query("gated_pairs", v.sql("gated", "SELECT sequence_id, frame_index, detection_id, truth_id, round(distance, 6) AS distance FROM gated"))
def _(spark, d):
    p = m.gated_pairs(v.detections(spark, d), v.visible_truth(spark, d), 5.0)
    return p.select(
        "sequence_id", "frame_index", F.col("left_id").alias("detection_id"), F.col("right_id").alias("truth_id"),
        F.round("distance", 6).alias("distance"),
    )


@query("match_points", v.sql("pairs", """
    SELECT sequence_id, frame_index, detection_id, truth_id, round(distance, 6) AS distance, 'tp' AS kind FROM pairs
    UNION ALL SELECT sequence_id, frame_index, detection_id, NULL, NULL, 'fp' FROM detections d
      WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.detection_id = d.detection_id)
    UNION ALL SELECT sequence_id, frame_index, NULL, truth_id, NULL, 'fn' FROM visible_truth t
      WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.truth_id = t.truth_id)"""))
def _(spark, d):
    tags = m.tag_matches(v.detections(spark, d), v.visible_truth(spark, d), 5.0)
    return tags.withColumn("distance", F.round("distance", 6))


BOX_EDGES = """
    bx AS (SELECT p.sequence_id, p.frame_index, detection_id, truth_id,
        greatest(least(p.x1, t.x1) - greatest(p.x0, t.x0), 0) * greatest(least(p.y1, t.y1) - greatest(p.y0, t.y0), 0) AS inter,
        (p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) AS areas
        FROM pred_boxes p JOIN truth_boxes t USING (sequence_id, frame_index)),
    be AS (SELECT *, inter / (areas - inter) AS iou, 1 - inter / (areas - inter) AS cost FROM bx WHERE inter / (areas - inter) >= 0.5),
""" + v.exact_pairs("be", "detection_id", "truth_id", "cost")


@query("match_boxes", v.sql("pred_boxes truth_boxes", """
    SELECT sequence_id, frame_index, detection_id, truth_id, round(1 - cost, 6) AS iou FROM pairs""", BOX_EDGES))
def _(spark, d):
    pairs = m.match_boxes(v.pred_boxes(spark, d), v.truth_boxes(spark, d)).pairs
    return pairs.withColumn("iou", F.round("iou", 6))


@query("nearest_within", v.sql("detections visible_truth", """
    SELECT t.sequence_id, t.frame_index, t.truth_id, b.detection_id, round(b.distance, 6) AS distance FROM visible_truth t LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY distance, detection_id) AS rn FROM (
        SELECT t.truth_id, d.detection_id, sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) AS distance
        FROM visible_truth t JOIN detections d USING (sequence_id, frame_index)) WHERE distance <= 20) b
    ON b.truth_id = t.truth_id AND b.rn = 1"""))
def _(spark, d):
    n = m.nearest_within(v.visible_truth(spark, d), v.detections(spark, d), 20.0)
    return n.select("sequence_id", "frame_index", "truth_id", "detection_id", F.round("distance", 6).alias("distance"))


@query("ambiguous_truth", v.sql("truth", """
    SELECT a.sequence_id, a.frame_index, a.truth_id FROM truth a WHERE EXISTS (
      SELECT 1 FROM truth b WHERE b.sequence_id = a.sequence_id AND b.frame_index = a.frame_index AND b.truth_id <> a.truth_id
      AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3)"""))
def _(spark, d):
    return m.ambiguous_truth(v.truth(spark, d), 3.0).select("sequence_id", "frame_index", "truth_id")


@query("attach_owner", v.sql("detections points", """
    SELECT d.sequence_id, d.frame_index, d.detection_id, p.track_id FROM detections d LEFT JOIN points p ON p.detection_id = d.detection_id"""))
def _(spark, d):
    return m.attach_owner(v.detections(spark, d), v.points(spark, d)).select("sequence_id", "frame_index", "detection_id", "track_id")


NARROW = """g3 AS (SELECT * FROM gated WHERE distance <= 3),
    near3 AS (SELECT sequence_id, frame_index, truth_id FROM (SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY distance) AS rn FROM g3) WHERE rn = 1)"""


@query("compare_matches", v.sql("pairs", """
    SELECT change, count(*) AS truths FROM (
      SELECT CASE WHEN a.truth_id IS NULL THEN 'recovered' WHEN b.truth_id IS NULL THEN 'lost' ELSE 'retained' END AS change
      FROM (SELECT truth_id FROM near3) a FULL OUTER JOIN (SELECT truth_id FROM pairs) b ON a.truth_id = b.truth_id) GROUP BY change""", NARROW))
def _(spark, d):
    # Run a: truths with any candidate within 3 px; run b: one-to-one matches within 5 px.
    near = m.nearest_within(v.visible_truth(spark, d), v.detections(spark, d), 3.0).where("detection_id is not null")
    return m.compare_matches(near, pairs(spark, d)).groupBy("change").agg(F.count("*").alias("truths"))


SCORES = """scores AS (SELECT sequence_id, detection_id, CASE WHEN event_id % 997 = 5 THEN frame_index + 1 ELSE frame_index END AS frame_index,
      quality_score AS score FROM (SELECT d.*, b.event_id FROM detections d JOIN (SELECT 'd' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS detection_id, event_id FROM base) b USING (detection_id)))"""


def scores(spark, d):
    """Quality as the score; a few rows name the wrong frame so that whole sequences fail."""
    number = F.substring("detection_id", 2, 9).cast("long")
    return v.detections(spark, d).select(
        "sequence_id", "detection_id",
        (F.col("frame_index") + F.when(number % 997 == 5, 1).otherwise(0)).alias("frame_index"), F.col("quality_score").alias("score"),
    )


@query("join_scores", v.sql("detections", """
    SELECT d.sequence_id, d.detection_id, CASE WHEN v.ok THEN round(s.score, 6) END AS score,
      CASE WHEN v.ok THEN 'experimental' ELSE 'unavailable' END AS assessment,
      CASE WHEN NOT v.ok THEN NULL WHEN s.score >= 0.7 THEN 'high' WHEN s.score >= 0.4 THEN 'medium' ELSE 'low' END AS category
    FROM detections d LEFT JOIN scores s ON s.detection_id = d.detection_id LEFT JOIN (
      SELECT s.sequence_id, bool_and(s.frame_index = d.frame_index AND score BETWEEN 0 AND 1) AS ok
      FROM scores s JOIN detections d ON d.detection_id = s.detection_id GROUP BY s.sequence_id) v ON v.sequence_id = d.sequence_id""", SCORES))
def _(spark, d):
    j = m.join_scores(v.detections(spark, d), scores(spark, d))
    return j.select("sequence_id", "detection_id", F.round("score", 6).alias("score"), "assessment", "category")


@query("join_labels", v.sql("detections truth", """
    SELECT p.split, p.sequence_id, p.frame_index, p.predicted, t.labelled FROM
      (SELECT 'train' AS split, sequence_id, frame_index, count(*) AS predicted FROM detections GROUP BY ALL) p
      JOIN (SELECT 'train' AS split, sequence_id, frame_index, count(*) AS labelled FROM truth GROUP BY ALL) t USING (split, sequence_id, frame_index)
      JOIN (SELECT sequence_id FROM detections GROUP BY 1 HAVING count(DISTINCT frame_index) = 29) g USING (sequence_id)"""))
def _(spark, d):
    # Sequences with exactly 29 non-empty days count as complete here.
    p = v.detections(spark, d).groupBy("sequence_id", "frame_index").agg(F.count("*").alias("predicted")).withColumn("split", F.lit("train"))
    t = v.truth(spark, d).groupBy("sequence_id", "frame_index").agg(F.count("*").alias("labelled")).withColumn("split", F.lit("train"))
    return m.join_labels(p, t, 29)[0].select("split", "sequence_id", "frame_index", "predicted", "labelled")


@query("as_of_gap_estimate", v.sql("points transforms", """
    SELECT g.sequence_id, g.track_id, t.frame_index, round(g.px - t.tx, 6) AS x_raw_px, round(g.py - t.ty, 6) AS y_raw_px FROM (
      SELECT sequence_id, track_id, frame_index, x_reference_px AS px, y_reference_px AS py,
        lead(frame_index) OVER (PARTITION BY sequence_id, track_id ORDER BY frame_index) AS nxt FROM points) g
    JOIN transforms t ON t.sequence_id = g.sequence_id AND t.frame_index > g.frame_index AND t.frame_index < g.nxt
    WHERE t.status <> 'failed' AND g.px - t.tx >= -0.5 AND g.px - t.tx < 511.5 AND g.py - t.ty >= -0.5 AND g.py - t.ty < 127.5"""))
def _(spark, d):
    g = m.as_of_gap_estimate(v.points(spark, d), v.transforms(spark, d), v.WIDTH, v.HEIGHT)
    return g.select("sequence_id", "track_id", "frame_index", F.round("x_raw_px", 6).alias("x_raw_px"), F.round("y_raw_px", 6).alias("y_raw_px"))
