"""Queries: metrics, diagnostics, sweeps and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import evaluation as ev
from trackframe.operators import sweeps as sw
from trackframe.operators import trajectory as r
from trackframe.plans import views as v
from trackframe.plans.registry import query
from trackframe.plans.trajectory import SUPPORTED, fit_cte, r6

OUTCOMES = """outcomes AS (
    SELECT sequence_id, frame_index, 'tp' AS kind, detection_id, truth_id, distance FROM pairs
    UNION ALL SELECT sequence_id, frame_index, 'fp', detection_id, NULL, NULL FROM detections d WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.detection_id = d.detection_id)
    UNION ALL SELECT sequence_id, frame_index, 'fn', NULL, truth_id, NULL FROM visible_truth t WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.truth_id = t.truth_id))"""

COUNTS = "count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn"
RATIOS = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END, 6) AS recall"""
F1 = "round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1"


@query("detection_metrics_by_sequence", v.sql("pairs", f"""
    SELECT sequence_id, tp, fp, fn, {RATIOS}, CASE WHEN tp + fp = 0 OR tp + fn = 0 THEN NULL ELSE {F1.split(' AS ')[0]} END AS f1,
      round(sqrt(se / tp), 6) AS localization_rmse_px
    FROM (SELECT sequence_id, {COUNTS}, sum(distance * distance) AS se FROM outcomes GROUP BY 1)""", OUTCOMES))
def _(spark, d):
    m = ev.detection_metrics(v.detections(spark, d), v.truth(spark, d), 5.0, ["sequence_id"])
    return m.select("sequence_id", "tp", "fp", "fn", *r6("precision", "recall", "f1", "localization_rmse_px"))


@query("detection_metrics_total", v.sql("pairs", f"""
    SELECT tp, fp, fn, {RATIOS}, {F1}, round(sqrt(se / tp), 6) AS localization_rmse_px
    FROM (SELECT {COUNTS}, sum(distance * distance) AS se FROM outcomes)""", OUTCOMES))
def _(spark, d):
    m = ev.detection_metrics(v.detections(spark, d), v.truth(spark, d), 5.0)
    return m.select("tp", "fp", "fn", *r6("precision", "recall", "f1", "localization_rmse_px"))


@query("null_reasons", v.sql("pairs", """
    SELECT sequence_id, frame_index, concat_ws(',', CASE WHEN tp = 0 THEN 'localization_rmse_px=No matched detections (TP == 0)' END,
      CASE WHEN tp + fp = 0 THEN 'precision=No predicted detections (TP + FP == 0)' END,
      CASE WHEN tp + fn = 0 THEN 'recall=No ground truth targets (TP + FN == 0)' END) AS reasons
    FROM (SELECT sequence_id, frame_index, """ + COUNTS + " FROM outcomes GROUP BY ALL)", OUTCOMES))
def _(spark, d):
    m = ev.detection_metrics(v.detections(spark, d), v.truth(spark, d), 5.0, ["sequence_id", "frame_index"])
    text = F.transform(F.map_entries("null_reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("sequence_id", "frame_index", F.concat_ws(",", F.array_sort(text)).alias("reasons"))


@query("target_counts", v.sql("truth", """
    SELECT sequence_id, count(*) FILTER (visible) AS ground_truth_points, count(DISTINCT CASE WHEN visible THEN target_id END) AS ground_truth_targets
    FROM truth GROUP BY 1"""))
def _(spark, d):
    return ev.target_counts(v.truth(spark, d))


# Track points matched to visible truth: the gated edges of the points view.
POINT_GATED = """pg AS (SELECT p.sequence_id, p.frame_index, p.detection_id, t.truth_id,
      sqrt((p.x_reference_px - t.x) * (p.x_reference_px - t.x) + (p.y_reference_px - t.y) * (p.y_reference_px - t.y)) AS distance
      FROM points p JOIN visible_truth t USING (sequence_id, frame_index)),
    pe AS (SELECT * FROM pg WHERE distance <= 5),
""" + v.exact_pairs("pe", "detection_id", "truth_id", "distance") + """,
    matched AS (SELECT p.*, o.track_id, t.target_id FROM pairs p JOIN points o ON o.detection_id = p.detection_id JOIN visible_truth t ON t.truth_id = p.truth_id)"""

TRACK_COUNTS = """tc AS (SELECT s.sequence_id, coalesce(tp, 0) AS tp, points - coalesce(tp, 0) AS fp, coalesce(truths, 0) - coalesce(tp, 0) AS fn
      FROM (SELECT sequence_id, count(*) AS points FROM points GROUP BY 1) s
      LEFT JOIN (SELECT sequence_id, count(*) AS tp FROM pairs GROUP BY 1) m USING (sequence_id)
      LEFT JOIN (SELECT sequence_id, count(*) AS truths FROM visible_truth GROUP BY 1) t USING (sequence_id)),
    sw AS (SELECT sequence_id, count(*) FILTER (prev <> track_id) AS id_switches FROM (SELECT *, lag(track_id) OVER (
      PARTITION BY sequence_id, target_id ORDER BY frame_index, detection_id) AS prev FROM matched) GROUP BY 1),
    fc AS (SELECT sequence_id, count(*) FILTER (status = 'confirmed' AND NOT hit) AS false_confirmed_tracks, count(*) AS total_tracks,
      count(*) FILTER (status = 'confirmed') AS confirmed_tracks FROM (SELECT t.*, EXISTS (SELECT 1 FROM matched m
      WHERE m.sequence_id = t.sequence_id AND m.track_id = t.track_id) AS hit FROM tracks t) GROUP BY 1)"""


@query("track_metrics", v.sql("visible_truth tracks", f"""
    SELECT sequence_id, tp, fp, fn, {RATIOS}, id_switches, round(tp / (tp + fn)::DOUBLE, 6) AS coverage, false_confirmed_tracks, total_tracks, confirmed_tracks
    FROM tc JOIN sw USING (sequence_id) JOIN fc USING (sequence_id)""", POINT_GATED + "," + TRACK_COUNTS))
def _(spark, d):
    m = ev.track_metrics(v.points(spark, d), v.tracks(spark, d), v.truth(spark, d))
    return m.select(
        "sequence_id", "tp", "fp", "fn", *r6("precision", "recall"), "id_switches", *r6("coverage"),
        "false_confirmed_tracks", "total_tracks", "confirmed_tracks",
    )


FRAME_ROWS = OUTCOMES + """, per AS (SELECT f.sequence_id, f.frame_index, coalesce(o.tp, 0) AS tp, coalesce(o.fp, 0) AS fp, coalesce(o.fn, 0) AS fn,
      coalesce(o.ds, 0) AS ds, coalesce(o.se, 0) AS se, m.ms FROM frames f
      LEFT JOIN (SELECT sequence_id, frame_index, """ + COUNTS + """, sum(distance) AS ds, sum(distance * distance) AS se FROM outcomes GROUP BY ALL) o USING (sequence_id, frame_index)
      LEFT JOIN (SELECT sequence_id, frame_index, sum(quality_score) AS ms FROM detections GROUP BY ALL) m USING (sequence_id, frame_index))"""

SUMMARY = f"""count(*) AS frame_count, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
    sum(ds) AS ds, sum(se) AS se, sum(ms) AS mst, avg(ms) AS msm, quantile_cont(ms, 0.95) AS ms95"""
SUMMARY_OUT = f"""frame_count, tp, fp, fn, {RATIOS}, {F1}, round(CASE WHEN tp > 0 THEN ds / tp END, 6) AS localization_mean_px,
    round(CASE WHEN tp > 0 THEN sqrt(se / tp) END, 6) AS localization_rmse_px, round(fp / frame_count::DOUBLE, 6) AS false_positives_per_frame,
    round(mst, 6) AS processing_ms_total, round(msm, 6) AS processing_ms_mean_per_frame, round(ms95, 6) AS processing_ms_p95_per_frame"""


def frame_rows(spark, d):
    """Outcome counts per declared frame; the summed quality stands in for a timing."""
    det = v.detections(spark, d)
    per = ev.frame_outcomes(det, v.truth(spark, d), v.frames(spark, d).select("sequence_id", "frame_index"))
    ms = det.groupBy("sequence_id", "frame_index").agg(F.sum("quality_score").alias("processing_ms"))
    return per.join(ms, ["sequence_id", "frame_index"], "left")


SUMMARY_COLS = [
    "precision", "recall", "f1", "localization_mean_px", "localization_rmse_px", "false_positives_per_frame",
    "processing_ms_total", "processing_ms_mean_per_frame", "processing_ms_p95_per_frame",
]


@query("frame_summary", v.sql("pairs frames", f"SELECT {SUMMARY_OUT} FROM (SELECT {SUMMARY} FROM per)", FRAME_ROWS))
def _(spark, d):
    return ev.frame_summary(frame_rows(spark, d)).select("frame_count", "tp", "fp", "fn", *r6(*SUMMARY_COLS))


@query("frame_summary_by_sequence", v.sql("pairs frames", f"SELECT sequence_id, {SUMMARY_OUT} FROM (SELECT sequence_id, {SUMMARY} FROM per GROUP BY 1)", FRAME_ROWS))
def _(spark, d):
    return ev.frame_summary(frame_rows(spark, d), ["sequence_id"]).select("sequence_id", "frame_count", "tp", "fp", "fn", *r6(*SUMMARY_COLS))


@query("empty_frame_summary", v.sql("pairs frames", """
    SELECT count(*) AS frame_count, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
      round(sum(fp) / count(*)::DOUBLE, 6) AS false_positives_per_frame FROM per WHERE tp + fn = 0""", FRAME_ROWS))
def _(spark, d):
    s = ev.empty_frame_summary(frame_rows(spark, d), ms=None)
    return s.select("frame_count", "tp", "fp", "fn", *r6("false_positives_per_frame"))


ACCEPTED = POINT_GATED.replace("FROM points p JOIN visible_truth", """FROM (SELECT p.* FROM points p JOIN tracks t USING (sequence_id, track_id)
      WHERE t.status = 'confirmed' OR (t.status = 'ended' AND t.observed_count >= 3)) p JOIN visible_truth""")


@query("accepted_observation_metrics", v.sql("visible_truth tracks", f"""
    SELECT sequence_id, tp, fp, fn, {RATIOS} FROM (SELECT s.sequence_id, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fp, truths - coalesce(tp, 0) AS fn
      FROM (SELECT sequence_id, count(*) AS truths FROM visible_truth GROUP BY 1) s
      LEFT JOIN (SELECT sequence_id, count(*) AS tp FROM pairs GROUP BY 1) m USING (sequence_id)
      LEFT JOIN (SELECT p.sequence_id, count(*) AS n FROM points p JOIN tracks t USING (sequence_id, track_id)
        WHERE t.status = 'confirmed' OR (t.status = 'ended' AND t.observed_count >= 3) GROUP BY 1) a USING (sequence_id))""", ACCEPTED))
def _(spark, d):
    from trackframe.operators.tracking import accepted_observations

    obs = accepted_observations(v.points(spark, d), v.tracks(spark, d), ["sequence_id", "track_id"])
    obs = obs.withColumns({"x": F.col("x_reference_px"), "y": F.col("y_reference_px")})
    m = ev.detection_metrics(obs, v.truth(spark, d), 5.0, ["sequence_id"])
    return m.select("sequence_id", "tp", "fp", "fn", *r6("precision", "recall"))


@query("ablation_report", v.sql("pairs tracks", """
    SELECT a.sequence_id, a.tp AS detector_tp, a.fp AS detector_fp, a.fn AS detector_fn, b.tp AS tracking_tp, b.fp AS tracking_fp, b.fn AS tracking_fn,
      a.fp - b.fp AS fp_reduction, round(b.fp / 30.0::DOUBLE, 6) AS false_positives_per_frame,
      round(b.tp / (b.tp + b.fp)::DOUBLE - a.tp / (a.tp + a.fp)::DOUBLE, 6) + 0.0::DOUBLE AS precision_delta
    FROM (SELECT sequence_id, """ + COUNTS + """ FROM outcomes GROUP BY 1) a JOIN bt b USING (sequence_id)""",
    OUTCOMES + ", acc AS (" + """SELECT p.* FROM points p JOIN tracks t USING (sequence_id, track_id)
      WHERE t.status = 'confirmed' OR (t.status = 'ended' AND t.observed_count >= 3)),
    pe AS (SELECT p.sequence_id, p.frame_index, p.detection_id, t.truth_id,
      sqrt((p.x_reference_px - t.x) * (p.x_reference_px - t.x) + (p.y_reference_px - t.y) * (p.y_reference_px - t.y)) AS distance
      FROM acc p JOIN visible_truth t USING (sequence_id, frame_index)
      WHERE sqrt((p.x_reference_px - t.x) * (p.x_reference_px - t.x) + (p.y_reference_px - t.y) * (p.y_reference_px - t.y)) <= 5),
    """ + v.exact_pairs("pe", "detection_id", "truth_id", "distance").replace("m_", "n_").replace("pairs AS", "pairs2 AS") + """,
    bt AS (SELECT s.sequence_id, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fp, truths - coalesce(tp, 0) AS fn
      FROM (SELECT sequence_id, count(*) AS truths FROM visible_truth GROUP BY 1) s
      LEFT JOIN (SELECT sequence_id, count(*) AS tp FROM pairs2 GROUP BY 1) m USING (sequence_id)
      LEFT JOIN (SELECT sequence_id, count(*) AS n FROM acc GROUP BY 1) a USING (sequence_id))"""))
def _(spark, d):
    counts = v.frames(spark, d).groupBy("sequence_id").agg(F.count("*").alias("frame_count"))
    a = ev.ablation_report(v.detections(spark, d), v.points(spark, d), v.tracks(spark, d), v.truth(spark, d), counts)
    return a.select(
        "sequence_id", *[f"{p}_{c}" for p in ("detector", "tracking") for c in ("tp", "fp", "fn")], "fp_reduction",
        *r6("false_positives_per_frame", "precision_delta"),
    )


DIAG = """vague AS (SELECT DISTINCT a.sequence_id, a.frame_index, a.target_id FROM visible_truth a JOIN visible_truth b
      ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index AND a.truth_id <> b.truth_id
      AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1),
    lab AS (SELECT o.sequence_id, o.track_id, o.frame_index, t.target_id, v.target_id IS NOT NULL AS vague FROM points o
      JOIN pairs p ON p.detection_id = o.detection_id JOIN visible_truth t ON t.truth_id = p.truth_id
      LEFT JOIN vague v ON v.sequence_id = t.sequence_id AND v.frame_index = t.frame_index AND v.target_id = t.target_id),
    clear AS (SELECT * FROM lab WHERE NOT vague)"""


@query("association_diagnostics", v.sql("pairs tracks", """
    SELECT t.sequence_id, coalesce(l.correct, 0) AS correct_links, coalesce(l.wrong, 0) AS incorrect_links, coalesce(s.n, 0) AS identity_switches,
      coalesce(CAST(f.n AS BIGINT), 0) AS fragmentation, t.false_confirmed AS false_confirmed_tracks, t.doubtful AS unscorable_confirmed, coalesce(v.n, 0) AS ambiguous_excluded,
      round(CASE WHEN l.correct + l.wrong > 0 THEN l.correct / (l.correct + l.wrong)::DOUBLE END, 6) AS correct_link_fraction
    FROM (SELECT k.sequence_id, count(*) FILTER (k.observed_count >= 3 AND coalesce(q.doubt, false)) AS doubtful,
        count(*) FILTER (k.observed_count >= 3 AND NOT coalesce(q.doubt, false) AND coalesce(b.best, 0) < 3) AS false_confirmed
      FROM tracks k LEFT JOIN (SELECT sequence_id, track_id, bool_or(vague) AS doubt FROM lab GROUP BY ALL) q USING (sequence_id, track_id)
      LEFT JOIN (SELECT sequence_id, track_id, max(n) AS best FROM (SELECT sequence_id, track_id, target_id, count(*) AS n FROM clear GROUP BY ALL) GROUP BY ALL) b
        USING (sequence_id, track_id) GROUP BY 1) t
    LEFT JOIN (SELECT sequence_id, count(*) FILTER (prev = target_id) AS correct, count(*) FILTER (prev <> target_id) AS wrong FROM (
      SELECT *, lag(target_id) OVER (PARTITION BY sequence_id, track_id ORDER BY frame_index, target_id) AS prev FROM clear) GROUP BY 1) l USING (sequence_id)
    LEFT JOIN (SELECT sequence_id, count(*) FILTER (prev <> track_id) AS n FROM (
      SELECT *, lag(track_id) OVER (PARTITION BY sequence_id, target_id ORDER BY frame_index, track_id) AS prev FROM clear) GROUP BY 1) s USING (sequence_id)
    LEFT JOIN (SELECT sequence_id, sum(k - 1) AS n FROM (SELECT sequence_id, target_id, count(DISTINCT track_id) AS k FROM clear GROUP BY ALL) GROUP BY 1) f USING (sequence_id)
    LEFT JOIN (SELECT sequence_id, count(*) AS n FROM vague GROUP BY 1) v USING (sequence_id)""", DIAG))
def _(spark, d):
    a = ev.association_diagnostics(v.points(spark, d), v.tracks(spark, d), v.detections(spark, d), v.truth(spark, d))
    return a.select(
        "sequence_id", "correct_links", "incorrect_links", "identity_switches", "fragmentation", "false_confirmed_tracks",
        "unscorable_confirmed", "ambiguous_excluded", *r6("correct_link_fraction"),
    )


GAP_TRUTH = """gt AS (SELECT b.sequence_id, b.frame_index, b.event_type AS target_id, t.truth_id, t.x, t.y,
      CASE WHEN quality_score < 0.25 THEN CASE WHEN quality_score < 0.2 THEN 'simulated_miss' ELSE 'outside' END ELSE 'rendered' END AS reason, quality_score >= 0.25 AS visible
      FROM base b JOIN truth t ON t.truth_id = 'g' || lpad(CAST(event_id AS VARCHAR), 9, '0') JOIN detections d ON d.detection_id = 'd' || lpad(CAST(event_id AS VARCHAR), 9, '0')),
    gv AS (SELECT * FROM gt WHERE visible),
    ge AS (SELECT d.sequence_id, d.frame_index, d.detection_id, t.truth_id, sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) AS distance
      FROM detections d JOIN gv t USING (sequence_id, frame_index) WHERE sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) <= 5),
""" + v.exact_pairs("ge", "detection_id", "truth_id", "distance") + """,
    vague AS (SELECT DISTINCT a.sequence_id, a.frame_index, a.target_id FROM gv a JOIN gv b
      ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index AND a.truth_id <> b.truth_id
      AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1),
    own AS (SELECT o.sequence_id, t.target_id, o.frame_index, max(o.track_id) AS track_id FROM points o
      JOIN pairs p ON p.detection_id = o.detection_id JOIN gv t ON t.truth_id = p.truth_id
      LEFT JOIN vague v ON v.sequence_id = t.sequence_id AND v.frame_index = t.frame_index AND v.target_id = t.target_id
      WHERE v.target_id IS NULL GROUP BY ALL),
    ends AS (SELECT *, lead(frame_index) OVER (PARTITION BY sequence_id, target_id ORDER BY frame_index) AS after
      FROM (SELECT DISTINCT sequence_id, target_id, frame_index FROM gv)),
    gaps AS (SELECT e.sequence_id, e.target_id, e.frame_index AS before, e.after, bool_and(h.reason = 'simulated_miss') AS scripted FROM ends e
      JOIN gt h ON h.sequence_id = e.sequence_id AND h.target_id = e.target_id AND h.frame_index > e.frame_index AND h.frame_index < e.after
      WHERE NOT h.visible AND e.after - e.frame_index IN (2, 3) GROUP BY ALL)"""


def gap_truth(spark, d):
    """Truth whose low-quality rows are hidden: below .2 a scripted miss, below .25 not."""
    q = v.detections(spark, d).select("sequence_id", "frame_index", F.concat(F.lit("g"), F.substring("detection_id", 2, 9)).alias("truth_id"), "quality_score")
    t = v.truth(spark, d).drop("visible").join(q, ["sequence_id", "frame_index", "truth_id"])
    low = F.col("quality_score") < 0.25
    return t.withColumn("visible", ~low).withColumn(
        "reason", F.when(F.col("quality_score") < 0.2, "simulated_miss").when(low, "outside").otherwise("rendered")
    )


@query("gap_recovery", v.sql("truth points", """
    SELECT g.sequence_id, count(*) FILTER (a.track_id = b.track_id) AS recovered, count(*) FILTER (a.track_id <> b.track_id) AS failed,
      count(*) FILTER (a.track_id IS NULL OR b.track_id IS NULL) AS unscorable FROM gaps g
    LEFT JOIN own a ON a.sequence_id = g.sequence_id AND a.target_id = g.target_id AND a.frame_index = g.before
    LEFT JOIN own b ON b.sequence_id = g.sequence_id AND b.target_id = g.target_id AND b.frame_index = g.after
    WHERE g.scripted GROUP BY 1""", GAP_TRUTH))
def _(spark, d):
    return ev.gap_recovery(v.points(spark, d), v.detections(spark, d), gap_truth(spark, d))


@query("result_frame_scores", v.sql("detections frames", """
    SELECT f.sequence_id, f.frame_index, coalesce(n, 0) AS detections, q_min, q25, q_median, q75, q_max FROM frames f LEFT JOIN (
      SELECT sequence_id, frame_index, count(*) AS n, round(min(quality_score), 6) AS q_min, round(quantile_cont(quality_score, 0.25), 6) AS q25,
        round(quantile_cont(quality_score, 0.5), 6) AS q_median, round(quantile_cont(quality_score, 0.75), 6) AS q75, round(max(quality_score), 6) AS q_max
      FROM detections GROUP BY ALL) USING (sequence_id, frame_index)"""))
def _(spark, d):
    p = v.points(spark, d)
    s = ev.result_summary(v.detections(spark, d), v.tracks(spark, d), r.fit_velocity(p), v.frames(spark, d))
    return s["per_frame"].select("sequence_id", "frame_index", "detections", *r6("q_min", "q25", "q_median", "q75", "q_max"))


@query("result_status_counts", v.sql("tracks", """
    SELECT sequence_id, count(*) FILTER (status = 'tentative') AS tentative, count(*) FILTER (status = 'confirmed') AS confirmed,
      count(*) FILTER (status = 'ended') AS ended, count(f.vx) AS fits, count(*) AS tracks
    FROM tracks LEFT JOIN fits f USING (sequence_id, track_id) GROUP BY 1""", fit_cte("frame_index")))
def _(spark, d):
    p = v.points(spark, d)
    return ev.result_summary(v.detections(spark, d), v.tracks(spark, d), r.fit_velocity(p), v.frames(spark, d))["status"]


@query("result_support_histogram", v.sql("tracks", "SELECT sequence_id, observed_count, count(*) AS tracks FROM tracks GROUP BY ALL"))
def _(spark, d):
    p = v.points(spark, d)
    return ev.result_summary(v.detections(spark, d), v.tracks(spark, d), r.fit_velocity(p), v.frames(spark, d))["support"]


from trackframe.plans.matching import BOX_EDGES  # noqa: E402


def images(spark, d):
    return v.frames(spark, d).select("sequence_id", "frame_index", (F.col("timestamp_s") % 97).alias("inference_ms"))


IMAGE_ROWS = BOX_EDGES + """,
    img AS (SELECT f.sequence_id, f.frame_index, f.timestamp_s % 97 AS ms, coalesce(p.n, 0) AS predicted, coalesce(t.n, 0) AS truths, coalesce(m.n, 0) AS tp FROM frames f
      LEFT JOIN (SELECT sequence_id, frame_index, count(*) AS n FROM pred_boxes GROUP BY ALL) p USING (sequence_id, frame_index)
      LEFT JOIN (SELECT sequence_id, frame_index, count(*) AS n FROM some_truth GROUP BY ALL) t USING (sequence_id, frame_index)
      LEFT JOIN (SELECT sequence_id, frame_index, count(*) AS n FROM pairs GROUP BY ALL) m USING (sequence_id, frame_index))"""
IMAGE_ROWS = "some_truth AS (SELECT b.* FROM truth_boxes b JOIN visible_truth t USING (sequence_id, frame_index, truth_id))," + IMAGE_ROWS.replace("JOIN truth_boxes t", "JOIN some_truth t")


def some_truth(spark, d):
    return v.truth_boxes(spark, d).join(v.visible_truth(spark, d).select("sequence_id", "frame_index", "truth_id"), ["sequence_id", "frame_index", "truth_id"], "left_semi")


@query("box_metrics", v.sql("pred_boxes truth_boxes visible_truth frames", """
    SELECT count(*) AS images, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(predicted - tp) AS BIGINT) AS fp, CAST(sum(truths - tp) AS BIGINT) AS fn,
      count(*) FILTER (truths = 0) AS negative_images, count(*) FILTER (truths = 0 AND predicted > 0) AS negative_images_with_fp,
      CAST(sum(predicted) FILTER (truths = 0) AS BIGINT) AS negative_fp, round(avg(ms), 6) AS inference_ms_mean, round(quantile_cont(ms, 0.95), 6) AS inference_ms_p95,
      round(sum(tp) / sum(predicted)::DOUBLE, 6) AS fixed_precision, round(sum(tp) / sum(truths)::DOUBLE, 6) AS fixed_recall,
      round(sum(predicted) FILTER (truths = 0) / (count(*) FILTER (truths = 0))::DOUBLE, 6) AS fp_per_negative FROM img""", IMAGE_ROWS))
def _(spark, d):
    t = ev.box_metrics(v.pred_boxes(spark, d), some_truth(spark, d), images(spark, d))[0]
    return t.select(
        "images", "tp", "fp", "fn", "negative_images", "negative_images_with_fp", "negative_fp",
        *r6("inference_ms_mean", "inference_ms_p95", "fixed_precision", "fixed_recall", "fp_per_negative"),
    )


@query("box_failures", v.sql("pred_boxes truth_boxes visible_truth frames", """
    SELECT sequence_id, frame_index, predicted - tp AS false_positives, truths - tp AS missed FROM img WHERE predicted > tp OR truths > tp""", IMAGE_ROWS))
def _(spark, d):
    return ev.box_metrics(v.pred_boxes(spark, d), some_truth(spark, d), images(spark, d))[1]


@query("track_report", v.sql("tracks frames", """
    SELECT t.sequence_id, t.track_id, t.status, t.observed_count, CASE WHEN t.quality_score < 0.4 THEN 'low' WHEN t.quality_score < 0.7 THEN 'medium' ELSE 'high' END AS quality_band,
      coalesce(s.supported, false) AS supported, coalesce(g.missing, '') AS missing_frames, t.observed_count AS linked_detections
    FROM tracks t JOIN supported s USING (sequence_id, track_id) LEFT JOIN (
      SELECT k.sequence_id, k.track_id, string_agg(CAST(f.frame_index AS VARCHAR), ',' ORDER BY f.frame_index) AS missing FROM tracks k JOIN frames f USING (sequence_id)
      WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.sequence_id = k.sequence_id AND p.track_id = k.track_id AND p.frame_index = f.frame_index) GROUP BY ALL) g
    USING (sequence_id, track_id)""", fit_cte("frame_index") + "," + SUPPORTED.replace("LIMIT_PX", "3")))
def _(spark, d):
    p = v.points(spark, d)
    t = ev.track_report(p, v.tracks(spark, d), r.fit_velocity(p), v.frames(spark, d))
    return t.select("sequence_id", "track_id", "status", "observed_count", "quality_band", "supported", F.array_join("missing_frames", ",").alias("missing_frames"), "linked_detections")


def mode_rows(spark, d):
    """Detector-only and track-point outcomes per sequence; sequences of every tenth
    user have a failed registration, which fails the second mode only."""
    seq = ["sequence_id"]
    a = ev.outcome_counts(v.detections(spark, d), v.truth(spark, d), 5.0, seq).withColumn("mode", F.lit("standard"))
    p = v.points(spark, d).withColumns({"x": F.col("x_reference_px"), "y": F.col("y_reference_px")})
    b = ev.outcome_counts(p, v.truth(spark, d), 5.0, seq).withColumn("mode", F.lit("temporal"))
    failed = v.transforms(spark, d).groupBy(*seq).agg(F.bool_or(F.col("status") == "failed").alias("failed"))
    state = failed.withColumn("mode", F.explode(F.array(F.lit("standard"), F.lit("temporal")))).select(
        "mode", *seq, F.when((F.col("mode") == "temporal") & F.col("failed"), "registration_failed").otherwise("succeeded").alias("status")
    )
    return a.unionByName(b), state


@query("compare_modes", v.sql("pairs tracks transforms", f"""
    SELECT mode, failures, shared_sequences, tp, fp, fn, {RATIOS}, {F1} FROM (
      SELECT 'standard' AS mode, 0 AS failures, count(DISTINCT sequence_id) AS shared_sequences, {COUNTS} FROM outcomes JOIN good USING (sequence_id)
      UNION ALL SELECT 'temporal', (SELECT count(DISTINCT sequence_id) FROM transforms WHERE status = 'failed'), count(*), CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT)
        FROM tc JOIN good USING (sequence_id))""",
    OUTCOMES + ", good AS (SELECT sequence_id FROM transforms GROUP BY 1 HAVING NOT bool_or(status = 'failed'))," + POINT_GATED.replace("m_", "n_").replace("pairs AS", "pairs2 AS").replace("FROM pairs p", "FROM pairs2 p")
    + "," + TRACK_COUNTS.replace("FROM pairs GROUP", "FROM pairs2 GROUP")))
def _(spark, d):
    rows, state = mode_rows(spark, d)
    c = ev.compare_modes(rows, state)
    return c.select("mode", "failures", "shared_sequences", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


@query("label_agreement", v.sql("tracks", """
    SELECT expected, actual, count(*) AS n FROM (SELECT sequence_id || '/' || track_id AS k, CASE WHEN observed_count >= 12 THEN 'confirmed' ELSE 'ended' END AS expected,
      status AS actual FROM tracks) GROUP BY ALL"""))
def _(spark, d):
    t = v.tracks(spark, d).withColumn("k", F.concat_ws("/", "sequence_id", "track_id"))
    expected = t.select("k", F.when(F.col("observed_count") >= 12, "confirmed").otherwise("ended").alias("expected"))
    return ev.label_agreement(t.select("k", F.col("status").alias("actual")), expected, "k")


THRESHOLDS = [0.0, 0.2, 0.4, 0.6, 0.8]
# The exact matching at each threshold keeps the threshold inside the frame key.
TH_EDGES = """th AS (SELECT unnest([0.0::DOUBLE, 0.2, 0.4, 0.6, 0.8]) AS threshold),
    td AS (SELECT d.*, threshold, sequence_id || '@' || threshold AS sk FROM detections d JOIN th ON d.quality_score >= th.threshold),
    te AS (SELECT d.sk AS sequence_id, d.frame_index, d.detection_id, t.truth_id, sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) AS distance, d.threshold
      FROM td d JOIN visible_truth t ON t.sequence_id = d.sequence_id AND t.frame_index = d.frame_index
      WHERE sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) <= 5),
""" + v.exact_pairs("te", "detection_id", "truth_id", "distance") + """,
    trials AS (SELECT threshold, coalesce(tp, 0) AS tp, n - coalesce(tp, 0) AS fp, (SELECT count(*) FROM visible_truth) - coalesce(tp, 0) AS fn
      FROM (SELECT threshold, count(*) AS n FROM td GROUP BY 1) LEFT JOIN (SELECT CAST(split_part(sequence_id, '@', 2) AS DOUBLE) AS threshold, count(*) AS tp FROM pairs GROUP BY 1) USING (threshold))"""


def threshold_trials(spark, d):
    scored = v.detections(spark, d).withColumn("score", F.col("quality_score"))
    return sw.threshold_sweep(scored, v.truth(spark, d), THRESHOLDS, 5.0)


@query("threshold_sweep", v.sql("detections visible_truth", f"SELECT threshold, tp, fp, fn, {RATIOS}, {F1} FROM trials", TH_EDGES))
def _(spark, d):
    return threshold_trials(spark, d).select("threshold", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


@query("select_threshold", v.sql("detections visible_truth", """
    SELECT threshold, tp, fp, fn FROM (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM trials)
    WHERE threshold > 0 AND r >= 0.5 * (SELECT tp / (tp + fn)::DOUBLE FROM trials WHERE threshold = 0) ORDER BY p DESC, r DESC LIMIT 1""", TH_EDGES))
def _(spark, d):
    return sw.select_threshold(threshold_trials(spark, d), 0.5).select("threshold", "tp", "fp", "fn")


@query("select_config", v.sql("detections visible_truth", """
    SELECT threshold, tp, fp, fn FROM (SELECT *, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM trials)
    WHERE r >= 0.3 ORDER BY f DESC, p DESC, threshold LIMIT 1""", TH_EDGES))
def _(spark, d):
    trials = threshold_trials(spark, d).withColumn("grid_ix", F.col("threshold"))
    return sw.select_config(trials, 0.3).select("threshold", "tp", "fp", "fn")


@query("pr_points", v.sql("detections visible_truth", f"SELECT trial, recall, precision FROM (SELECT threshold AS trial, {RATIOS} FROM trials) WHERE recall IS NOT NULL AND precision IS NOT NULL", TH_EDGES))
def _(spark, d):
    return ev.pr_points(threshold_trials(spark, d).withColumnRenamed("threshold", "trial")).select("trial", *r6("recall", "precision"))


FEATURES = ["x", "y", "quality_score"]


@query("feature_quantiles", v.sql("pairs", """
    SELECT category, feature, p, round(quantile_cont(val, p), 6) AS value FROM (
      SELECT o.kind AS category, unnest(['x', 'y', 'quality_score']) AS feature, unnest([d.x, d.y, d.quality_score]) AS val FROM outcomes o JOIN detections d USING (detection_id)
      UNION ALL SELECT 'fn', unnest(['x', 'y']), unnest([t.x, t.y]) FROM outcomes o JOIN visible_truth t USING (truth_id) WHERE kind = 'fn')
    CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS p) GROUP BY category, feature, p""".replace("quantile_cont(val, p)", """CASE p WHEN 0.1 THEN quantile_cont(val, 0.1) WHEN 0.25 THEN quantile_cont(val, 0.25)
      WHEN 0.5 THEN quantile_cont(val, 0.5) WHEN 0.75 THEN quantile_cont(val, 0.75) ELSE quantile_cont(val, 0.9) END"""), OUTCOMES))
def _(spark, d):
    det, t = v.detections(spark, d), v.visible_truth(spark, d)
    tags = ev.tag_visible(det, t, 5.0)
    key = ["sequence_id", "frame_index"]
    hit = tags.where("kind <> 'fn'").select(*key, "detection_id", F.col("kind").alias("category")).join(det, [*key, "detection_id"])
    miss = tags.where("kind = 'fn'").select(*key, "truth_id", F.col("kind").alias("category")).join(t, [*key, "truth_id"])
    rows = hit.select("category", *FEATURES).unionByName(miss.select("category", "x", "y"), allowMissingColumns=True)
    return sw.feature_quantiles(rows, FEATURES).select("category", "feature", "p", *r6("value"))


@query("score_gates", v.sql("detections", """
    SELECT config_id, count(*) AS kept, round(avg(quality_score), 6) AS mean_score FROM (
      SELECT d.*, c.* FROM (SELECT *, (x1 - x0) / (y1 - y0) AS aspect FROM detections) d CROSS JOIN (SELECT unnest(['open', 'default', 'strict']) AS config_id,
        unnest([0.0, 4.0, 30.0]) AS min_snr, unnest([1.0, 0.9, 0.6]) AS max_peak, unnest([20.0, 2.5, 2.0]) AS max_ctx, unnest([20.0, 20.0, 1.5]) AS max_aspect, unnest([0.0, 0.3, 0.5]) AS min_score) c)
    WHERE x >= min_snr AND y / 100 <= max_peak AND 1 + quality_score * 2 <= max_ctx AND aspect <= max_aspect AND quality_score >= min_score GROUP BY 1"""))
def _(spark, d):
    det = v.detections(spark, d).select(
        "sequence_id", "detection_id", F.col("x").alias("aperture_snr"), (F.col("y") / 100).alias("peak_fraction"),
        (1 + F.col("quality_score") * 2).alias("context_elongation"),
        ((F.col("box.x1") - F.col("box.x0")) / (F.col("box.y1") - F.col("box.y0"))).alias("component_aspect"), F.col("quality_score").alias("score"),
    )
    names = ["config_id", "min_aperture_snr", "max_peak_fraction", "max_context_elongation", "max_component_aspect", "min_score"]
    grid = [dict(zip(names, row)) for row in (("open", 0.0, 1.0, 20.0, 20.0, 0.0), ("default", 4.0, 0.9, 2.5, 20.0, 0.3), ("strict", 30.0, 0.6, 2.0, 1.5, 0.5))]
    kept = sw.gate_candidates(det, grid)
    return kept.groupBy("config_id").agg(F.count("*").alias("kept"), F.round(F.avg("score"), 6).alias("mean_score"))
