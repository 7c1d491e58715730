"""Queries: quality rules, as violations counted or listed per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import rules as q
from trackframe.operators import trajectory as r
from trackframe.plans import views as v
from trackframe.plans.registry import query
from trackframe.plans.trajectory import fit_cte


def listed(parts: list[tuple[str, str, str]]) -> str:
    """UNION ALL of (rule, key columns, source with condition)."""
    return "\nUNION ALL ".join(f"SELECT {keys}, '{rule}' AS rule FROM {src}" for rule, keys, src in parts)


@query("check_detections", v.sql("contract_detections", listed([
    ("centroid_in_box", "sequence_id, detection_id", "cd WHERE NOT (bx0 <= x_raw_px AND x_raw_px < x1 AND y0 <= y_raw_px AND y_raw_px < y1)"),
    ("quality_range", "sequence_id, detection_id", "cd WHERE NOT q BETWEEN 0 AND 1"),
    ("frame_in_range", "sequence_id, detection_id", "cd WHERE frame_index >= 25"),
    ("reference_pair", "sequence_id, detection_id", "cd WHERE (x_reference_px IS NULL) <> (yr IS NULL)"),
]), "cd AS (SELECT *, quality_score * 1.05::DOUBLE AS q, x0 + kx AS bx0, CASE WHEN y_raw_px < 5 THEN NULL ELSE y_reference_px END AS yr FROM (SELECT *, CASE WHEN y_raw_px = 7 THEN 3 ELSE 0 END AS kx FROM contract_detections))"))
def _(spark, d):
    # A few rows are bent on purpose: shifted boxes, quality above 1, half a reference pair.
    c = v.contract_detections(spark, d)
    box = F.struct((F.col("box.x0") + F.when(F.col("y_raw_px") == 7, 3).otherwise(0)).alias("x0"), "box.y0", "box.x1", "box.y1")
    c = c.withColumns({"box": box, "quality_score": F.col("quality_score") * 1.05, "y_reference_px": F.when(F.col("y_raw_px") >= 5, F.col("y_reference_px"))})
    return q.check_detections(c, 25).violations


@query("check_track_points", v.sql("points", listed([
    ("observed_has_detection", "sequence_id, track_id, frame_index", "points WHERE quality_score < 0.05"),
    ("raw_pair", "sequence_id, track_id, frame_index", "points WHERE y_raw_px < 3"),
])))
def _(spark, d):
    p = v.points(spark, d).withColumns(
        {"detection_id": F.when(F.col("quality_score") >= 0.05, F.col("detection_id")), "x_raw_px": F.when(F.col("y_raw_px") >= 3, F.col("x_raw_px"))}
    )
    return q.check_track_points(p).violations


@query("check_trajectories", v.sql("tracks", listed([
    ("unit_matches_basis", "sequence_id, track_id", "fits WHERE vx > 2"),
    ("not_more_than_track", "sequence_id, track_id", "fits JOIN tracks t USING (sequence_id, track_id) WHERE n + 1 > t.observed_count AND n > 15"),
]), fit_cte("frame_index")))
def _(spark, d):
    f = r.fit_velocity(v.points(spark, d)).where("status = 'fitted'")
    f = f.withColumns(
        {
            "speed_unit": F.when(F.col("vx") > 2, "px/s").otherwise(F.col("speed_unit")),
            "observations_used": F.col("observations_used") + F.when(F.col("observations_used") > 15, 1).otherwise(0),
        }
    )
    return q.check_trajectories(f, v.tracks(spark, d)).violations


@query("check_tracks", v.sql("tracks", listed([
    ("observed_count", "sequence_id, track_id", "tracks WHERE observed_count % 9 = 4"),
    ("confirmed_needs_three", "sequence_id, track_id", "tracks WHERE observed_count < 3 AND quality_score > 0.5"),
])))
def _(spark, d):
    t = v.tracks(spark, d).withColumns(
        {
            "status": F.when((F.col("observed_count") < 3) & (F.col("quality_score") > 0.5), "confirmed").otherwise(F.col("status")),
            "observed_count": F.col("observed_count") + F.when(F.col("observed_count") % 9 == 4, 1).otherwise(0),
        }
    )
    return q.check_tracks(t, v.points(spark, d)).violations


@query("frames_out_of_order", v.sql("points", """
    SELECT DISTINCT sequence_id, track_id, 'frames_ordered' AS rule FROM (SELECT sequence_id, track_id, frame_index,
      lag(frame_index) OVER (PARTITION BY sequence_id, track_id ORDER BY detection_id) AS prev FROM points) WHERE frame_index <= prev"""))
def _(spark, d):
    return q.frames_out_of_order(v.points(spark, d), "detection_id")


@query("check_references", v.sql("tracks", """
    SELECT sequence_id, detection_id AS ref, 'observed_point_references_detection' AS rule FROM points p WHERE quality_score < 0.1
    UNION ALL SELECT DISTINCT sequence_id, track_id, 'timestamp_agrees_with_basis' FROM points"""))
def _(spark, d):
    det = v.detections(spark, d).where("quality_score >= 0.1")
    return q.check_references(det, v.tracks(spark, d), v.points(spark, d), "frame")


@query("check_sequences", v.sql("detections", """
    SELECT sequence_id, 'frame_count' AS rule FROM s WHERE n NOT BETWEEN 3 AND 30
    UNION ALL SELECT sequence_id, 'contiguous_frames' FROM s WHERE lo <> 0 OR hi <> n - 1
    UNION ALL SELECT sequence_id, 'equal_dimensions' FROM s WHERE sizes <> 1
    UNION ALL SELECT sequence_id, 'unique_image_refs' FROM s WHERE refs <> n
    UNION ALL SELECT sequence_id, 'timestamps_all_or_none' FROM s WHERE timed NOT IN (0, n)
    UNION ALL SELECT sequence_id, 'pixel_limit' FROM s WHERE px > 4000000""",
    """s AS (SELECT sequence_id, count(*) AS n, min(frame_index) AS lo, max(frame_index) AS hi, count(DISTINCT w) AS sizes, count(DISTINCT ref) AS refs, count(ts) AS timed, max(w * 128) AS px FROM (
      SELECT sequence_id, frame_index, 1000 * count(*) AS w, min(detector_name) AS ref, CASE WHEN min(quality_score) > 0.01 THEN min(timestamp_s) END AS ts FROM detections GROUP BY ALL) GROUP BY 1)"""))
def _(spark, d):
    # Days with events play the stored frames: gaps, sizes, refs and times come from the data.
    f = v.detections(spark, d).groupBy("sequence_id", "frame_index").agg(
        (F.count("*") * 1000).alias("width_px"), F.lit(128).alias("height_px"), F.min("detector_name").alias("image_ref"),
        F.when(F.min("quality_score") > 0.01, F.min("timestamp_s")).alias("timestamp_s"),
    )
    return q.check_sequences(f)


@query("check_payload", v.sql("contract_detections frames", """
    SELECT sequence_id, frame_index, detection_id AS ref, 'frame_declared' AS rule FROM contract_detections WHERE frame_index >= 28
    UNION ALL SELECT sequence_id, frame_index, detection_id, 'inside_image' FROM contract_detections WHERE frame_index < 28
      AND NOT (x0 >= 0 AND x1 <= 512 AND y0 >= 0 AND y1 <= 96 AND x0 <= x_raw_px AND x_raw_px < x1 AND y0 <= y_raw_px AND y_raw_px < y1)
    UNION ALL SELECT sequence_id, frame_index, detection_id, 'not_registered' FROM contract_detections WHERE x_reference_px IS NOT NULL OR y_reference_px IS NOT NULL
    UNION ALL SELECT sequence_id, frame_index, NULL, 'frame_missing' FROM frames WHERE frame_index < 28 AND (sequence_id, frame_index) NOT IN (SELECT (sequence_id, frame_index) FROM contract_detections)
    UNION ALL SELECT DISTINCT sequence_id, NULL::BIGINT, NULL, 'tracking_performed' FROM frames WHERE CAST(substr(sequence_id, 2) AS BIGINT) % 2 = 1"""))
def _(spark, d):
    f = v.frames(spark, d).where("frame_index < 28").withColumn("height_px", F.lit(96))
    meta = f.select("sequence_id").distinct().select("sequence_id", *[F.lit(x).alias(c) for c, x in q.PAYLOAD.items() if c != "tracking_performed"], (F.substring("sequence_id", 2, 20).cast("long") % 2 == 1).alias("tracking_performed"))
    det = v.contract_detections(spark, d)
    return q.check_payload(det, f, payload_frames=det, metadata=meta)


@query("check_point_labels", v.sql("detections", """
    SELECT sequence_id, CAST(frame AS INTEGER) AS frame, 'frame_range' AS rule FROM pl WHERE frame NOT BETWEEN 1 AND 5
    UNION ALL SELECT sequence_id, CAST(frame AS INTEGER), 'object_count_matches' FROM pl WHERE n <> declared
    UNION ALL SELECT sequence_id, CAST(frame AS INTEGER), 'inside_image' FROM pl WHERE mx > 199.5 OR my > 95.5
    UNION ALL SELECT sequence_id, NULL, 'five_frames' FROM pl GROUP BY 1 HAVING count(DISTINCT frame) <> 5
    UNION ALL SELECT sequence_id, NULL, 'constant_count' FROM pl GROUP BY 1 HAVING count(DISTINCT declared) <> 1""",
    """pl AS (SELECT sequence_id, frame_index + 1 AS frame, count(*) AS n, count(*) + CASE WHEN min(quality_score) < 0.02 THEN 1 ELSE 0 END AS declared, max(x) AS mx, max(y) AS my FROM detections GROUP BY ALL)"""))
def _(spark, d):
    labels = v.detections(spark, d).groupBy("sequence_id", (F.col("frame_index") + 1).alias("frame")).agg(
        (F.count("*") + F.when(F.min("quality_score") < 0.02, 1).otherwise(0)).alias("num_objects"),
        F.collect_list(F.array("x", "y")).alias("object_coords"),
    )
    return q.check_point_labels(labels, 200, 96)


def norm_boxes(spark, d):
    return v.detections(spark, d).select(
        F.col("sequence_id").alias("split"), F.col("detection_id").alias("image"), F.lit(1).alias("line"),
        F.when(F.col("quality_score") < 0.02, 1).otherwise(0).alias("class"), (F.col("x") / 300).alias("cx"), (F.col("y") / 99).alias("cy"),
        F.col("quality_score").alias("w"), F.lit(0.1).alias("h"),
    )


BOXES = """nb AS (SELECT sequence_id AS split, detection_id AS image, 1 AS line, CASE WHEN quality_score < 0.02 THEN 1 ELSE 0 END AS class, x / 300 AS cx, y / 99 AS cy,
    quality_score AS w, 0.1::DOUBLE AS h FROM detections)"""
OUTSIDE = "least(cx - w / 2, cy - h / 2) < -{t} OR greatest(cx + w / 2, cy + h / 2) > 1 + {t}"


@query("check_boxes", v.sql("detections", listed([
    ("class_zero", "split, image, line", "nb WHERE class <> 0"),
    ("centre_in_unit", "split, image, line", "nb WHERE cx > 1 OR cy > 1 OR cx < 0 OR cy < 0"),
    ("size_in_unit", "split, image, line", "nb WHERE w <= 0 OR w > 1"),
    ("inside_image", "split, image, line", "nb WHERE " + OUTSIDE.format(t="1e-7")),
]), BOXES))
def _(spark, d):
    return q.check_boxes(norm_boxes(spark, d)).violations


@query("boxes_extend_outside", v.sql("detections", "SELECT split, count(*) AS boxes, count(*) FILTER (" + OUTSIDE.format(t="1e-6") + ") AS outside FROM nb GROUP BY 1", BOXES))
def _(spark, d):
    return norm_boxes(spark, d).groupBy("split").agg(F.count("*").alias("boxes"), F.count_if(q.box_extends_outside()).alias("outside"))


@query("check_manifest_entries", v.sql("", """
    SELECT archive, name, 'safe_name' AS rule FROM en WHERE name LIKE '%..%' OR name LIKE '%//%'
    UNION ALL SELECT archive, name, 'member_size' FROM en WHERE size > 5000
    UNION ALL SELECT archive, name, 'compression_ratio' FROM en WHERE size / greatest(1, compressed)::DOUBLE > 30
    UNION ALL SELECT archive, max(name), 'case_folded_duplicate' FROM en GROUP BY archive, lower(name) HAVING count(*) > 1
    UNION ALL SELECT archive, NULL, 'total_size' FROM en GROUP BY archive HAVING sum(size) > 100000
    UNION ALL SELECT archive, NULL, 'entry_count' FROM en GROUP BY archive HAVING count(*) > 50""",
    """en AS (SELECT source AS archive, lang || CASE WHEN doc_id % 17 = 0 THEN '/../' WHEN doc_id % 19 = 0 THEN '//' ELSE '/' END || CASE WHEN doc_id % 2 = 0 THEN 'Doc' ELSE 'doc' END || (doc_id // 2) || '.txt' AS name,
      n_chars AS size, doc_id % 90 AS compressed FROM documents)"""))
def _(spark, d):
    x = v.read(spark, d, "documents")
    slash = F.when(F.col("doc_id") % 17 == 0, "/../").when(F.col("doc_id") % 19 == 0, "//").otherwise("/")
    name = F.concat("lang", slash, F.when(F.col("doc_id") % 2 == 0, "Doc").otherwise("doc"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".txt"))
    entries = x.select(F.col("source").alias("archive"), name.alias("name"), F.col("n_chars").alias("size"), (F.col("doc_id") % 90).alias("compressed"))
    return q.check_manifest_entries(entries, {"member_bytes": 5000, "total_bytes": 100_000, "ratio": 30.0, "entries": 50})


@query("check_configs", v.sql("detections", """
    SELECT config_id, param, 'within_bounds' AS rule FROM st WHERE param = 'gate_distance_px' AND (value <= 0 OR value > 200)
    UNION ALL SELECT config_id, param, 'within_bounds' FROM st WHERE param = 'max_candidates' AND (value < 1 OR value > 2000)
    UNION ALL SELECT config_id, param, 'whole_number' FROM st WHERE param = 'max_candidates' AND value <> floor(value)
    UNION ALL SELECT config_id, param, 'known_parameter' FROM st WHERE param = 'colour'""",
    """st AS (SELECT detection_id AS config_id, unnest(['gate_distance_px', 'max_candidates', 'colour']) AS param, unnest([x, y / 2, quality_score]) AS value FROM detections)"""))
def _(spark, d):
    pairs = [("gate_distance_px", F.col("x")), ("max_candidates", F.col("y") / 2), ("colour", F.col("quality_score"))]
    s = v.detections(spark, d).select(F.col("detection_id").alias("config_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("param"), c.alias("value")) for n, c in pairs])).alias("s"))
    return q.check_configs(s.select("config_id", "s.*"))


@query("out_of_field", v.sql("contract_detections", """
    SELECT detection_id, NOT (0 <= x_reference_px AND x_reference_px < 200 AND 0 <= y_reference_px AND y_reference_px < 96) AS out_of_field FROM contract_detections WHERE x_reference_px IS NOT NULL
    UNION ALL SELECT detection_id, NULL FROM contract_detections WHERE x_reference_px IS NULL"""))
def _(spark, d):
    size = lambda n: F.when(F.col("x_reference_px").isNotNull(), F.lit(float(n)))
    return v.contract_detections(spark, d).select("detection_id", r.out_of_field("x_reference_px", "y_reference_px", size(200), size(96)).alias("out_of_field"))


@query("irregular_cadence", v.sql("frames", """
    SELECT sequence_id, count(DISTINCT round_even(gap, 9)) AS distinct_gaps FROM (SELECT sequence_id, timestamp_s - lag(timestamp_s) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS gap FROM frames)
    GROUP BY 1 HAVING count(DISTINCT round_even(gap, 9)) > 1"""))
def _(spark, d):
    return q.irregular_cadence(v.frames(spark, d))


@query("check_input_limits", v.sql("", """
    SELECT sequence_id, 'file_count' AS rule FROM s WHERE n NOT BETWEEN 3 AND 30 UNION ALL SELECT sequence_id, 'file_size' FROM s WHERE big > 10485760
    UNION ALL SELECT sequence_id, 'sequence_size' FROM s WHERE total > 52428800 UNION ALL SELECT sequence_id, 'equal_dimensions' FROM s WHERE sizes <> 1
    UNION ALL SELECT sequence_id, 'extension_agrees' FROM s WHERE NOT typed""",
    """s AS (SELECT source || '-' || lang AS sequence_id, count(*) AS n, max(n_chars * 1000) AS big, sum(n_chars * 1000) AS total, count(DISTINCT doc_id % 3) AS sizes, bool_and(doc_id % 23 <> 0) AS typed FROM documents GROUP BY 1)"""))
def _(spark, d):
    x = v.read(spark, d, "documents")
    f = x.select(
        F.concat_ws("-", "source", "lang").alias("sequence_id"), F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 23 == 0, ".jpg").otherwise(".PNG")).alias("name"),
        F.lit("image/png").alias("media_type"), (F.col("n_chars") * 1000).alias("size"), (F.col("doc_id") % 3).alias("width"), F.lit(480).alias("height"),
    )
    return q.check_input_limits(f)


@query("check_coordinates_preserved", v.sql("detections points", """
    SELECT d.sequence_id, d.detection_id, CASE WHEN p.detection_id IS NULL THEN 'detection_lost' ELSE 'coordinates_changed' END AS rule
    FROM detections d LEFT JOIN points p ON p.detection_id = d.detection_id WHERE p.detection_id IS NULL OR p.quality_score > 0.9"""))
def _(spark, d):
    det = v.detections(spark, d).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    moved = v.points(spark, d).withColumn("x_raw_px", F.col("x_raw_px") + F.when(F.col("quality_score") > 0.9, 0.5).otherwise(0.0))
    return q.check_coordinates_preserved(det, moved)


def outcome(spark, d):
    """Irregular cadence plays invalid input; quality and transforms give the rest."""
    ids = v.frames(spark, d).select("sequence_id").distinct()
    invalid = q.irregular_cadence(v.frames(spark, d)).select("sequence_id", F.lit("irregular_cadence").alias("rule"))
    mean = F.avg("quality_score")
    suit = v.detections(spark, d).groupBy("sequence_id").agg(
        F.when(mean < 0.46, "unsupported").when(mean < 0.48, "uncertain").otherwise("supported").alias("status"), F.lit("quality").alias("detail")
    )
    reg = v.transforms(spark, d).groupBy("sequence_id").agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("estimated").alias("status"), F.lit("28").alias("detail"))
    return q.sequence_outcome(ids, invalid, suit, reg)


OUTCOME = """oc AS (SELECT i.sequence_id, CASE WHEN i.user_id % 7 = 0 THEN 'invalid_input' WHEN s.m < 0.46 THEN 'unsupported_observation' WHEN s.m < 0.48 THEN 'uncertain_observation'
      WHEN i.user_id % 10 = 0 THEN 'registration_failed' ELSE 'succeeded' END AS status FROM ids i JOIN (SELECT sequence_id, avg(quality_score) AS m FROM detections GROUP BY 1) s USING (sequence_id))"""


@query("sequence_outcome", v.sql("detections ids", """
    SELECT sequence_id, status, CASE status WHEN 'invalid_input' THEN 'irregular_cadence' WHEN 'registration_failed' THEN '28' WHEN 'succeeded' THEN NULL ELSE 'quality' END AS detail FROM oc""", OUTCOME))
def _(spark, d):
    return outcome(spark, d)


@query("succeeded_only", v.sql("detections ids", """
    SELECT sequence_id, count(*) AS detections FROM detections WHERE sequence_id IN (SELECT sequence_id FROM oc WHERE status = 'succeeded') GROUP BY 1""", OUTCOME))
def _(spark, d):
    return q.succeeded_only(v.detections(spark, d), outcome(spark, d)).groupBy("sequence_id").agg(F.count("*").alias("detections"))
