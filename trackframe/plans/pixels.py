"""Queries: pixel statistics, masks, components and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.functions.lineage import cut_lineage
from trackframe.operators import pixels as p
from trackframe.operators.sweeps import feature_quantiles, outcome_features
from trackframe.plans import views as v
from trackframe.plans.registry import query
from trackframe.plans.trajectory import r6

FLOOR = 0.5 / 255


@query("normalize_pixels", v.sql("pixels", """
    SELECT sequence_id, frame_index, x, y, round(CASE WHEN frame_index = 7 THEN value * 50 WHEN frame_index % 2 = 0 THEN value * 50 / 255 ELSE value * 50 / 65535 END, 9) AS value,
      round(CASE WHEN frame_index % 2 = 0 THEN 1 / 255.0::DOUBLE ELSE 1 / 65535.0::DOUBLE END, 9) AS quantum FROM pixels WHERE frame_index <> 7
    UNION ALL SELECT sequence_id, frame_index, x, y, CASE WHEN value * 50 <= 1 THEN value * 50 END, round(1 / 65535.0::DOUBLE, 9) FROM pixels WHERE frame_index = 7"""))
def _(spark, d):
    px = v.pixels(spark, d).withColumn("value", F.col("value") * 50)
    dtypes = px.select("sequence_id", "frame_index").distinct().withColumn(
        "dtype", F.when(F.col("frame_index") == 7, "float64").when(F.col("frame_index") % 2 == 0, "uint8").otherwise("uint16")
    )
    n = p.normalize_pixels(px, dtypes)
    return n.select("sequence_id", "frame_index", "x", "y", F.round("value", 9).alias("value"), F.round("quantum", 9).alias("quantum"))


STATS = """st AS (SELECT sequence_id, frame_index, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS q90,
      quantile_cont(value, 0.99) AS q99, avg(CASE WHEN value >= 1 - 0.5::DOUBLE / 255 THEN 1.0 ELSE 0.0 END) AS sat, avg(CASE WHEN value <= 0.5::DOUBLE / 255 THEN 1.0 ELSE 0.0 END) AS clip,
      avg(CASE WHEN value > 0.5 THEN 1.0 ELSE 0.0 END) AS bright, count(*) AS n, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY ALL)"""


@query("frame_stats", v.sql("pixels", """
    SELECT sequence_id, frame_index, round(q01, 6) AS q01, round(q10, 6) AS q10, round(median, 6) AS median, round(q90, 6) AS q90, round(q99, 6) AS q99, round(q99 - q01, 6) AS dynamic_range,
      round(sat, 6) AS upper_saturation_fraction, round(clip, 6) AS lower_clipping_fraction, round(bright, 6) AS bright_fraction, n AS n_pixels FROM st""", STATS))
def _(spark, d):
    s = p.frame_stats(v.pixels(spark, d))
    return s.select(
        "sequence_id", "frame_index", *r6("q01", "q10", "median", "q90", "q99", "dynamic_range", "upper_saturation_fraction", "lower_clipping_fraction", "bright_fraction"), "n_pixels",
    )


SIGMA = f"""md AS (SELECT sequence_id, frame_index, median(value) AS m FROM pixels GROUP BY ALL),
    sg AS (SELECT sequence_id, frame_index, any_value(m) AS m, greatest(1.4826 * median(abs(value - m)), {FLOOR}) AS sigma FROM pixels JOIN md USING (sequence_id, frame_index) GROUP BY ALL)"""


@query("robust_sigma", v.sql("pixels", "SELECT sequence_id, frame_index, round(m, 6) AS frame_median, round(sigma, 6) AS sigma FROM sg", SIGMA))
def _(spark, d):
    return p.robust_sigma(v.pixels(spark, d)).select("sequence_id", "frame_index", *r6("frame_median", "sigma"))


# The view's frames are 16 x 12; in two of three sequences their pixels are set 40 apart, as a sparse sample of a real frame.
SUIT = "px AS (SELECT * REPLACE (x * k AS x, y * k AS y) FROM (SELECT *, CASE WHEN CAST(substr(sequence_id, 2) AS BIGINT) % 3 = 0 THEN 1 ELSE 40 END AS k FROM pixels))," + STATS.replace("FROM pixels", "FROM px") + "," + SIGMA + """, su AS (SELECT *, CASE WHEN least(w, h) < 32 OR sat > 0.8 OR (q10 > 0.4 AND median > 0.6 AND q90 > 0.7 AND bright > 0.8) THEN 'unsupported' WHEN codes <> '' THEN 'uncertain' ELSE 'supported' END AS status FROM (
      SELECT st.*, concat_ws(',', CASE WHEN least(w, h) < 32 THEN 'dimensions_too_small' END, CASE WHEN sat > 0.8 THEN 'severe_clipping' END,
      CASE WHEN q10 > 0.4 AND median > 0.6 AND q90 > 0.7 AND bright > 0.8 THEN 'broad_bright_field' END, CASE WHEN n < 20 THEN 'low_feature_evidence' END,
      CASE WHEN sigma / 4 > 0.08 THEN 'excessive_noise' END, CASE WHEN n >= 20 AND sat < 0.008 AND frame_index % 2 = 0 THEN 'possible_blur' END) AS codes
      FROM st JOIN sg USING (sequence_id, frame_index)))"""


def suitability(spark, d):
    px = v.pixels(spark, d)
    k = F.when(F.substring("sequence_id", 2, 20).cast("long") % 3 == 0, 1).otherwise(40)
    px = px.withColumns({"x": F.col("x") * k, "y": F.col("y") * k})
    counts = p.value_counts(px)
    s = cut_lineage(p.frame_stats(px, counts=counts))
    noise = p.robust_sigma(px, counts=counts).select("sequence_id", "frame_index", (F.col("sigma") / 4).alias("noise"))
    # Pixel counts and saturation stand in for the kernel metrics of a real frame; every other frame counts as sharp.
    sharp = F.when(F.col("frame_index") % 2 == 0, F.col("upper_saturation_fraction")).otherwise(1.0)
    m = s.select("sequence_id", "frame_index", (F.col("n_pixels") * 8 / 20).alias("features"), sharp.alias("sharpness"))
    return p.frame_suitability(s, m.join(noise, ["sequence_id", "frame_index"]))


@query("frame_suitability", v.sql("pixels", "SELECT sequence_id, frame_index, codes AS reason_codes, status FROM su", SUIT))
def _(spark, d):
    return suitability(spark, d).select("sequence_id", "frame_index", F.array_join("reason_codes", ",").alias("reason_codes"), "status")


@query("sequence_suitability", v.sql("pixels", """
    SELECT sequence_id, reason_codes, status, status = 'supported' AS inference_allowed FROM (SELECT sequence_id, reason_codes,
      CASE WHEN n <> 7 OR hard OR sizes <> 1 THEN 'unsupported' WHEN reason_codes <> '' THEN 'uncertain' ELSE 'supported' END AS status FROM (
      SELECT sequence_id, n, hard, sizes, CASE WHEN n <> 7 THEN 'sequence_length' ELSE concat_ws(',', nullif(codes, ''), CASE WHEN sizes <> 1 THEN 'inconsistent_dimensions' END,
      CASE WHEN spread > 0.25 THEN 'background_inconsistency' END) END AS reason_codes FROM (
      SELECT sequence_id, count(*) AS n, bool_or(status = 'unsupported') AS hard, count(DISTINCT w || 'x' || h) AS sizes, max(median) - min(median) AS spread FROM su GROUP BY 1) a LEFT JOIN (
      SELECT sequence_id, string_agg(c, ',' ORDER BY first_at) AS codes FROM (SELECT sequence_id, c, min(frame_index * 100 + i) AS first_at FROM (
        SELECT sequence_id, frame_index, unnest(string_split(codes, ',')) AS c, unnest(range(1, len(string_split(codes, ',')) + 1)) AS i FROM su WHERE codes <> '') GROUP BY ALL) GROUP BY 1) b USING (sequence_id)))""", SUIT))
def _(spark, d):
    s = p.sequence_suitability(suitability(spark, d), 7)
    return s.withColumn("reason_codes", F.array_join("reason_codes", ","))


MASK = SIGMA + """, mk AS (SELECT p.sequence_id, p.frame_index, x, y, value - m AS response, sigma AS noise, y * 1048576 + x AS node
      FROM pixels p JOIN sg USING (sequence_id, frame_index) WHERE value - m > 1.0 * sigma)"""


def mask(spark, d):
    return p.threshold_mask(v.pixels(spark, d), 1.0)


@query("threshold_mask", v.sql("pixels", "SELECT sequence_id, frame_index, x, y, round(response, 6) AS response, round(noise, 6) AS noise FROM mk", MASK))
def _(spark, d):
    return mask(spark, d).select("sequence_id", "frame_index", "x", "y", *r6("response", "noise"))


COMPONENTS = MASK + """, reach AS (SELECT sequence_id, frame_index, node, node AS seen, x AS sx, y AS sy FROM mk
      UNION SELECT r.sequence_id, r.frame_index, r.node, n.node, n.x, n.y FROM reach r JOIN mk n ON n.sequence_id = r.sequence_id AND n.frame_index = r.frame_index
        AND n.x BETWEEN r.sx - 1 AND r.sx + 1 AND n.y BETWEEN r.sy - 1 AND r.sy + 1),
    lb AS (SELECT sequence_id, frame_index, node, min(seen) AS component FROM reach GROUP BY ALL)"""


@query("connected_components", v.sql("pixels", "SELECT m.sequence_id, m.frame_index, m.x, m.y, CAST(l.component AS BIGINT) AS component FROM mk m JOIN lb l USING (sequence_id, frame_index, node)", COMPONENTS))
def _(spark, d):
    # Tiles of a few pixels, so that components cross many borders; the queries below use the default.
    return p.label_components(mask(spark, d), tile=4).select("sequence_id", "frame_index", "x", "y", "component")


FEATURES = COMPONENTS + """, cp AS (SELECT m.*, l.component FROM mk m JOIN lb l USING (sequence_id, frame_index, node)),
    cw AS (SELECT sequence_id, frame_index, component, sum(response * x) / sum(response) AS cx, sum(response * y) / sum(response) AS cy FROM cp GROUP BY ALL),
    cv AS (SELECT c.sequence_id, c.frame_index, c.component, any_value(cx) AS cx, any_value(cy) AS cy, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, max(response / noise) AS snr,
      sum(response * (x - cx) * (x - cx)) / sum(response) AS vxx, sum(response * (y - cy) * (y - cy)) / sum(response) AS vyy, sum(response * (x - cx) * (y - cy)) / sum(response) AS vxy
      FROM cp c JOIN cw USING (sequence_id, frame_index, component) GROUP BY ALL),
    ce AS (SELECT *, sqrt(((vxx + vyy) / 2 + sqrt(((vxx - vyy) / 2) ** 2 + vxy ** 2) + 1 / 12.0::DOUBLE) / ((vxx + vyy) / 2 - sqrt(((vxx - vyy) / 2) ** 2 + vxy ** 2) + 1 / 12.0::DOUBLE)) AS elong FROM cv WHERE area BETWEEN 2 AND 150),
    cf AS (SELECT *, (1 - exp(-snr / 8)) / greatest(1, elong) AS score FROM ce WHERE elong <= 4)"""


def candidates(spark, d):
    return p.component_features(p.label_components(mask(spark, d)), min_area=2)


@query("component_features", v.sql("pixels", """
    SELECT sequence_id, frame_index, CAST(component AS BIGINT) AS component, round(cx, 6) AS x, round(cy, 6) AS y, x0, y0, x1, y1, area, round(elong, 6) AS elongation, round(snr, 6) AS peak_snr,
      round(score, 6) AS score, CASE WHEN elong <= 2 THEN 'compact' ELSE 'unknown' END AS kind FROM cf""", FEATURES))
def _(spark, d):
    c = candidates(spark, d)
    return c.select("sequence_id", "frame_index", "component", *r6("x", "y"), "box.*", "area", *r6("elongation", "peak_snr", "score"), "kind")


TOP = """, rk AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY score DESC, cy, cx) AS rn FROM cf)"""


@query("cap_candidates", v.sql("pixels", "SELECT sequence_id, frame_index, round(score, 6) AS score, rn AS rank FROM rk WHERE rn <= 2", FEATURES + TOP))
def _(spark, d):
    return p.cap_candidates(candidates(spark, d), 2)[0].select("sequence_id", "frame_index", *r6("score"), F.col("rank").cast("long").alias("rank"))


@query("cap_warnings", v.sql("pixels", """
    SELECT sequence_id, frame_index, count(*) AS proposals, count(*) || ' proposals exceed cap 2; strongest retained' AS warning FROM cf GROUP BY sequence_id, frame_index HAVING count(*) > 2""", FEATURES))
def _(spark, d):
    return p.cap_candidates(candidates(spark, d), 2)[1]


@query("assign_candidate_ids", v.sql("pixels", """
    SELECT sequence_id, frame_index, 's' || substr(sha256(sequence_id || '/global_mad_threshold_v1'), 1, 16) || '-f' || frame_index || '-c' || (rn - 1) AS detection_id, round(score, 6) AS score FROM rk WHERE rn <= 200""", FEATURES + TOP))
def _(spark, d):
    kept = p.cap_candidates(candidates(spark, d), 200)[0]
    return p.assign_candidate_ids(kept, "global_mad_threshold_v1").select("sequence_id", "frame_index", "detection_id", *r6("score"))


def centres(spark, d):
    """One candidate per bright pixel (value above .96), its box one pixel wide."""
    px = v.pixels(spark, d).where("value > 0.96")
    box = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1).alias("x1"), (F.col("y") + 2).alias("y1"))
    return px.select("sequence_id", "frame_index", F.concat_ws("-", "x", "y").alias("candidate_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), box.alias("box"))


APERTURE = f"""ca AS (SELECT sequence_id, frame_index, x AS cx, y AS cy, x || '-' || y AS candidate_id FROM pixels WHERE value > 0.96),
    pt AS (SELECT c.*, p.value, p.x AS px, p.y AS py, (p.x - cx) ** 2 + (p.y - cy) ** 2 AS r2, abs(p.x - cx) <= 1.5 AND abs(p.y - cy) <= 1.5 AS core FROM ca c JOIN pixels p USING (sequence_id, frame_index) WHERE abs(p.x - cx) <= 7 AND abs(p.y - cy) <= 7),
    bg AS (SELECT sequence_id, frame_index, candidate_id, coalesce(median(value) FILTER (r2 >= 12.25 AND r2 <= 42.25), median(value)) AS b, count(*) FILTER (r2 >= 12.25 AND r2 <= 42.25) AS nr FROM pt GROUP BY ALL),
    ns AS (SELECT sequence_id, frame_index, candidate_id, any_value(b) AS b, greatest(1.4826 * coalesce(median(abs(value - b)) FILTER (r2 >= 12.25 AND r2 <= 42.25), median(abs(value - b))), {FLOOR}) AS noise
      FROM pt JOIN bg USING (sequence_id, frame_index, candidate_id) GROUP BY ALL),
    af AS (SELECT sequence_id, frame_index, candidate_id, any_value(noise) AS noise, sum(value - b) FILTER (r2 <= 6.25) / (any_value(noise) * sqrt(count(*) FILTER (r2 <= 6.25))) AS snr,
      max(greatest(value - b, 0)) FILTER (core) AS peak, sum(greatest(value - b, 0)) FILTER (core) AS total FROM pt JOIN ns USING (sequence_id, frame_index, candidate_id) GROUP BY ALL)"""


@query("aperture_features", v.sql("pixels", """
    SELECT sequence_id, frame_index, candidate_id, round(snr, 6) AS aperture_snr_heuristic, round(CASE WHEN total > 0 THEN peak / total ELSE 0 END, 6) AS raw_peak_fraction,
      round(noise, 6) AS local_noise_normalized, round(peak, 6) AS local_contrast_normalized, 2.0::DOUBLE AS component_aspect FROM af""", APERTURE))
def _(spark, d):
    a = p.aperture_features(centres(spark, d), v.pixels(spark, d))
    return a.select("sequence_id", "frame_index", "candidate_id", *r6("aperture_snr_heuristic", "raw_peak_fraction", "local_noise_normalized", "local_contrast_normalized"), "component_aspect")


CONTEXT = APERTURE + """, sp AS (SELECT pt.sequence_id, pt.frame_index, candidate_id, px, py, value - b AS sig, noise, value - b > 2 * noise AND r2 <= 42.25 AS strong, core FROM pt JOIN ns USING (sequence_id, frame_index, candidate_id)),
    sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index, candidate_id ORDER BY sig DESC, py, px) AS rn FROM sp WHERE core) WHERE rn = 1 AND strong),
    cc AS (SELECT sequence_id, frame_index, candidate_id, px, py, sig, noise FROM sd
      UNION SELECT n.sequence_id, n.frame_index, n.candidate_id, n.px, n.py, n.sig, n.noise FROM cc c JOIN sp n ON n.sequence_id = c.sequence_id AND n.frame_index = c.frame_index AND n.candidate_id = c.candidate_id
        AND n.strong AND n.px BETWEEN c.px - 1 AND c.px + 1 AND n.py BETWEEN c.py - 1 AND c.py + 1),
    cm AS (SELECT sequence_id, frame_index, candidate_id, count(*) AS area, sum((sig - noise) * px) / sum(sig - noise) AS mx, sum((sig - noise) * py) / sum(sig - noise) AS my FROM cc GROUP BY ALL),
    ck AS (SELECT sequence_id, frame_index, candidate_id, any_value(area) AS area, sum((sig - noise) * (px - mx) ** 2) / sum(sig - noise) AS vx, sum((sig - noise) * (py - my) ** 2) / sum(sig - noise) AS vy,
      sum((sig - noise) * (px - mx) * (py - my)) / sum(sig - noise) AS vc FROM cc JOIN cm USING (sequence_id, frame_index, candidate_id) GROUP BY ALL)"""


@query("aperture_context", v.sql("pixels", """
    SELECT a.sequence_id, a.frame_index, a.candidate_id, coalesce(CAST(area AS DOUBLE), 0) AS context_area_px, round(coalesce(sqrt(((vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + vc ** 2) + 1 / 12.0::DOUBLE)
      / ((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + vc ** 2) + 1 / 12.0::DOUBLE)), 1), 6) AS context_elongation FROM ca a LEFT JOIN ck USING (sequence_id, frame_index, candidate_id)""", CONTEXT))
def _(spark, d):
    a = p.aperture_features(centres(spark, d), v.pixels(spark, d))
    return a.select("sequence_id", "frame_index", "candidate_id", *r6("context_elongation", "context_area_px"))


# Bright pixels as detections (true above .98), dimmer ones as truth points that nothing found.
OUTCOME = APERTURE.replace("value > 0.96", "value > 0.955") + """, oc AS (SELECT a.*, CASE WHEN p.value > 0.98 THEN 'tp' WHEN p.value > 0.96 THEN 'fp' ELSE 'fn' END AS category
      FROM af a JOIN pixels p ON p.sequence_id = a.sequence_id AND p.frame_index = a.frame_index AND p.x || '-' || p.y = a.candidate_id),
    ol AS (SELECT category, unnest(['aperture_snr_heuristic', 'raw_peak_fraction', 'local_noise_normalized', 'local_contrast_normalized']) AS feature,
      unnest([snr, CASE WHEN total > 0 THEN peak / total ELSE 0 END, noise, peak]) AS val FROM oc)"""


@query("aperture_quantiles", v.sql("pixels", " UNION ALL ".join(f"SELECT category, feature, {q}::DOUBLE AS p, round(quantile_cont(val, {q}), 6) AS value FROM ol GROUP BY ALL" for q in (0.1, 0.25, 0.5, 0.75, 0.9)), OUTCOME))
def _(spark, d):
    px = v.pixels(spark, d)
    found = centres(spark, d).join(px.where("value > 0.98").select("sequence_id", "frame_index", F.concat_ws("-", "x", "y").alias("candidate_id"), F.lit("tp").alias("true")), ["sequence_id", "frame_index", "candidate_id"], "left")
    found = found.withColumn("category", F.coalesce("true", F.lit("fp")))
    missed = px.where("value > 0.955 and value <= 0.96").select("sequence_id", "frame_index", F.concat_ws("-", "x", "y").alias("candidate_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    frames = px.groupBy("sequence_id", "frame_index").agg((F.max("x") + 1).alias("width_px"), (F.max("y") + 1).alias("height_px"))
    names = ["aperture_snr_heuristic", "raw_peak_fraction", "local_noise_normalized", "local_contrast_normalized"]
    return feature_quantiles(outcome_features(found, missed, px, frames), names).select("category", "feature", "p", *r6("value"))


def shifts(spark, d):
    return v.pixels(spark, d).select("sequence_id", "frame_index").distinct().select(
        "sequence_id", "frame_index", F.lit("estimated").alias("status"), (F.col("frame_index") % 3 - 0.8).alias("tx"), (F.col("frame_index") % 2 + 0.3).alias("ty")
    )


TEMPORAL = """ref AS (SELECT *, x + CAST(frame_index % 3 - 1 AS INTEGER) AS xr, y + CAST(frame_index % 2 AS INTEGER) AS yr FROM pixels),
    bk AS (SELECT sequence_id, xr, yr, median(value) AS background, count(*) AS frames FROM ref GROUP BY ALL HAVING count(*) >= 3)"""


@query("temporal_median", v.sql("pixels", "SELECT sequence_id, xr, yr, round(background, 6) AS background, frames FROM bk", TEMPORAL))
def _(spark, d):
    return p.temporal_median(v.pixels(spark, d), shifts(spark, d)).select("sequence_id", "xr", "yr", *r6("background"), "frames")


@query("temporal_residual", v.sql("pixels", """
    SELECT r.sequence_id, r.frame_index, r.x, r.y, round(CASE WHEN n = 9 THEN least(greatest(r.value - b.background + 0.1, 0), 1) ELSE 0.1 END, 6) AS residual FROM ref r
    LEFT JOIN bk b USING (sequence_id, xr, yr) LEFT JOIN (SELECT a.sequence_id, a.xr, a.yr, count(*) AS n FROM bk a JOIN bk o ON o.sequence_id = a.sequence_id
      AND o.xr BETWEEN a.xr - 1 AND a.xr + 1 AND o.yr BETWEEN a.yr - 1 AND a.yr + 1 GROUP BY ALL) s USING (sequence_id, xr, yr)""", TEMPORAL))
def _(spark, d):
    # A 3x3 support square: the view's frames are too small and sparse for 5x5.
    px, t = v.pixels(spark, d), shifts(spark, d)
    return p.temporal_residual(px, t, p.temporal_median(px, t), 1).select("sequence_id", "frame_index", "x", "y", *r6("residual"))


BOX_ROWS = """bx AS (SELECT sequence_id, frame_index, x - 2 AS x0, y - 2 AS y0, x + 2 AS x1, y + 2 AS y1, quality_score * 1.02::DOUBLE AS score, CASE WHEN kind = 'compact' AND quality_score < 0.05 THEN 1 ELSE 0 END AS cls FROM detections),
    bj AS (SELECT *, CASE WHEN score > 1 THEN 'score_range' WHEN cls <> 0 THEN 'class_not_zero' WHEN NOT (x0 >= 0 AND x1 <= 512 AND y0 >= 0 AND y1 <= 128) THEN 'box_outside_image' END AS reason FROM bx),
    br AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY score DESC, x0, y0, x1, y1) AS rn FROM bj WHERE reason IS NULL)"""


def scored_boxes(spark, d):
    det = v.detections(spark, d)
    return det.select(
        "sequence_id", "frame_index", (F.col("x") - 2).alias("x0"), (F.col("y") - 2).alias("y0"), (F.col("x") + 2).alias("x1"), (F.col("y") + 2).alias("y1"),
        (F.col("quality_score") * 1.02).alias("score"), F.when((F.col("kind") == "compact") & (F.col("quality_score") < 0.05), 1).otherwise(0).alias("class"),
    )


@query("boxes_to_detections", v.sql("detections", """
    SELECT sequence_id, frame_index, 'sy' || substr(sha256(sequence_id || '/streak-experimental'), 1, 16) || '-f' || frame_index || '-c' || (rn - 1) AS detection_id,
      round((x0 + x1) / 2, 6) AS x_raw_px, round((y0 + y1) / 2, 6) AS y_raw_px, round(score, 6) AS quality_score FROM br WHERE rn <= 3""", BOX_ROWS))
def _(spark, d):
    dets, _, _ = p.boxes_to_detections(scored_boxes(spark, d), v.frames(spark, d), 3)
    return dets.select("sequence_id", "frame_index", "detection_id", *r6("x_raw_px", "y_raw_px", "quality_score"))


@query("rejected_boxes", v.sql("detections", "SELECT reason, count(*) AS boxes FROM bj WHERE reason IS NOT NULL GROUP BY 1", BOX_ROWS))
def _(spark, d):
    return p.boxes_to_detections(scored_boxes(spark, d), v.frames(spark, d), 3)[1].groupBy("reason").agg(F.count("*").alias("boxes"))


@query("box_cap_warnings", v.sql("detections", """
    SELECT sequence_id, frame_index, max(rn) AS proposals, max(rn) || ' proposals exceed cap 3; strongest retained' AS warning FROM br GROUP BY ALL HAVING max(rn) > 3""", BOX_ROWS))
def _(spark, d):
    return p.boxes_to_detections(scored_boxes(spark, d), v.frames(spark, d), 3)[2]
