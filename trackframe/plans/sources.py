"""Queries: parsing, exploding, exporting, digests and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackframe import schemas as s
from trackframe.functions.lineage import ensure_checkpoint_dir
from trackframe.operators import trajectory as r
from trackframe.plans import views as v
from trackframe.plans.evaluation import OUTCOMES
from trackframe.plans.registry import query
from trackframe.plans.trajectory import FORECAST, fit_cte, n6, r6
from trackframe.sources import readers as rd
from trackframe.sources import sinks as sk
from trackframe.streaming import tracks as st


@query("read_sequences", v.sql("frames", """
    SELECT sequence_id, CAST(frame_index AS INTEGER) AS position, frame_index, sequence_id || '-' || frame_index AS image_ref, width_px, height_px, round(timestamp_s, 6) AS timestamp_s FROM frames"""))
def _(spark, d):
    # Manifests are written as JSON text per sequence and parsed back with the declared schema.
    f = v.frames(spark, d).withColumn("image_ref", F.concat_ws("-", "sequence_id", "frame_index"))
    frame = F.struct("frame_index", "image_ref", "width_px", "height_px", "timestamp_s")
    text = f.groupBy("sequence_id").agg(F.array_sort(F.collect_list(frame)).alias("frames")).select(F.to_json(F.struct("sequence_id", "frames")).alias("j"))
    seq = text.select(F.from_json("j", s.SEQUENCE).alias("m")).select("m.*")
    return rd.sequence_frames(seq).select("sequence_id", "position", "frame_index", "image_ref", "width_px", "height_px", *r6("timestamp_s"))


@query("unknown_fields", v.sql("detections", """
    SELECT detection_id, 'colour' AS unknown_fields FROM detections WHERE quality_score > 0.5"""))
def _(spark, d):
    det = v.detections(spark, d)
    text = F.to_json(F.struct("sequence_id", "frame_index", F.when(F.col("quality_score") > 0.5, F.lit("red")).alias("colour")))
    u = rd.unknown_fields(det.select("detection_id", text.alias("j")), "j", ["sequence_id", "frame_index"])
    return u.select("detection_id", F.array_join("unknown_fields", ",").alias("unknown_fields"))


@query("read_frame_listing", v.sql("", """
    SELECT CASE WHEN l_returnflag = 'N' THEN 'test' ELSE 'train' END AS split, CAST(l_orderkey AS VARCHAR) AS sequence_id, l_linenumber AS frame, l_orderkey AS sequence_number
    FROM lineitem WHERE l_linenumber <= 5"""))
def _(spark, d):
    x = v.read(spark, d, "lineitem")
    path = F.concat(F.lit("/data/raw/"), F.when(F.col("l_returnflag") == "N", "test").otherwise("train"), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit(".png"))
    return rd.parse_frame_paths(x.select(path.alias("path")))[0].select("split", "sequence_id", "frame", "sequence_number")


@query("rejected_frame_names", v.sql("", """
    SELECT '/data/raw/train/' || lpad(CAST(l_orderkey AS VARCHAR), 7, '0') || '/' || l_linenumber || '.png' AS path,
      CASE WHEN l_orderkey < 1000000 THEN 'sequence is not a canonical number' ELSE 'unsupported frame name' END AS reason
    FROM lineitem WHERE l_orderkey < 1000000 OR l_linenumber > 5"""))
def _(spark, d):
    x = v.read(spark, d, "lineitem")
    path = F.concat(F.lit("/data/raw/train/"), F.lpad(F.col("l_orderkey").cast("string"), 7, "0"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit(".png"))
    return rd.parse_frame_paths(x.select(path.alias("path")))[1]


@query("read_point_labels", v.sql("detections frames", """
    SELECT f.sequence_id, f.frame_index + 1 AS frame, coalesce(n, 0) AS num_objects, CAST(d.i AS INTEGER) AS label_index, round(d.x, 6) AS x, round(d.y, 6) AS y FROM frames f
    LEFT JOIN (SELECT sequence_id, frame_index, count(*) AS n FROM detections GROUP BY ALL) c USING (sequence_id, frame_index)
    LEFT JOIN (SELECT sequence_id, frame_index, x, y, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY detection_id) - 1 AS i FROM detections) d USING (sequence_id, frame_index)"""))
def _(spark, d):
    det = v.detections(spark, d).groupBy("sequence_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("detection_id", "x", "y"))).alias("a"))
    f = v.frames(spark, d).select("sequence_id", "frame_index").join(det, ["sequence_id", "frame_index"], "left")
    coords = F.coalesce(F.transform("a", lambda e: F.array(e["x"], e["y"])), F.array().cast("array<array<double>>"))
    rec = f.select(F.to_json(F.struct("sequence_id", (F.col("frame_index") + 1).alias("frame"), F.size(coords).alias("num_objects"), coords.alias("object_coords"))).alias("j"))
    points = rd.label_points(rec.select(F.from_json("j", s.POINT_LABEL).alias("m")).select("m.*"))
    return points.select("sequence_id", "frame", F.col("num_objects").cast("long").alias("num_objects"), "label_index", *r6("x", "y"))


@query("read_box_labels", v.sql("detections", """
    SELECT detection_id, round(CASE WHEN quality_score >= 0.97 THEN NULL ELSE x / 500 END, 6) AS cx, CASE WHEN quality_score < 0.03 THEN 'expected five fields' WHEN quality_score >= 0.97 THEN 'not a finite number'
      WHEN kind = 'compact' AND quality_score < 0.06 THEN 'class is not 0' WHEN y > 96 THEN 'normalized coordinates outside bounds' END AS reason FROM detections"""))
def _(spark, d):
    det = v.detections(spark, d)
    q = F.col("quality_score")
    text = F.concat_ws(
        "  ", F.when((F.col("kind") == "compact") & (q < 0.06), "1").otherwise("0"), F.when(q >= 0.97, "x").otherwise((F.col("x") / 500).cast("string")),
        (F.col("y") / 96).cast("string"), F.lit("0.1"), F.when(q >= 0.03, F.lit("0.2")),
    )
    return rd.parse_box_lines(det.select("detection_id", text.alias("value"))).select("detection_id", *r6("cx"), "reason")


BOX_CSV = """bc AS (SELECT user_id AS u, event_type, count(*) AS n, bool_or(value > 200) AS broken FROM events GROUP BY ALL)"""


@query("read_box_csv", v.sql("", """
    SELECT arity, CAST(sum(b) AS BIGINT) AS boxes FROM (SELECT CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN 4 ELSE 2 END AS arity,
      CASE WHEN event_type = 'view' THEN 1 ELSE n END AS b FROM bc WHERE NOT broken) GROUP BY 1""", BOX_CSV))
def _(spark, d):
    return rd.box_arity_histogram(rd.parse_box_csv(box_csv(spark, d))[0])


@query("box_csv_errors", v.sql("", "SELECT u || '-' || event_type AS \"ImageID\", 'not a box list' AS reason FROM bc WHERE broken", BOX_CSV))
def _(spark, d):
    return rd.parse_box_csv(box_csv(spark, d))[1]


def box_csv(spark, d):
    e = v.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list("value").alias("a"), F.max("value").alias("m"))
    lists = F.array_join(F.transform("a", lambda x: F.when(F.col("event_type") == "click", F.format_string("(%s, 1, 2.5, 3)", x.cast("string"))).otherwise(F.format_string("[%s, 7]", x.cast("string")))), ", ")
    text = F.when(F.col("m") > 200, F.lit("__import__('os')")).when(F.col("event_type") == "view", F.lit("[]")).otherwise(F.concat(F.lit("["), lists, F.lit("]")))
    return e.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("ImageID"), text.alias("bboxes"))


def nested(spark, d):
    p = v.points(spark, d)
    fits = r.fit_velocity(p)
    det = v.detections(spark, d).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    seq = v.frames(spark, d).select("sequence_id").distinct()
    return sk.nest_results(seq, outcomes(seq, lambda i: F.lit(True)), det, v.tracks(spark, d), p, fits, r.extrapolate(fits))


def outcomes(sequences, fine):
    """Outcome rows by a rule on the number in the sequence's name; others have failed registration."""
    ok = fine(F.substring("sequence_id", 2, 20).cast("long"))
    return sequences.select("sequence_id", F.when(ok, "succeeded").otherwise("registration_failed").alias("status"), F.when(~ok, "weak_translation_consensus").alias("detail"))


@query("results_round_trip", v.sql("detections tracks points frames", """
    SELECT f.sequence_id, CASE WHEN ok THEN 'succeeded' ELSE 'registration_failed' END AS status, CASE WHEN NOT ok THEN 'weak_translation_consensus' END AS detail,
      CASE WHEN ok THEN coalesce(d.n, 0) ELSE 0 END AS detections, round(CASE WHEN ok THEN coalesce(d.s, 0) ELSE 0 END, 4) AS x_sum, CASE WHEN ok THEN coalesce(t.n, 0) ELSE 0 END AS tracks,
      CASE WHEN ok THEN coalesce(p.n, 0) ELSE 0 END AS points, CASE WHEN ok THEN coalesce(c.n, 0) ELSE 0 END AS predictions, 'synthetic' AS source_type
    FROM (SELECT DISTINCT sequence_id, CAST(substr(sequence_id, 2) AS BIGINT) % 3 <> 0 AS ok FROM frames) f
    LEFT JOIN (SELECT sequence_id, count(*) AS n, sum(x) AS s FROM detections GROUP BY 1) d USING (sequence_id) LEFT JOIN (SELECT sequence_id, count(*) AS n FROM tracks GROUP BY 1) t USING (sequence_id)
    LEFT JOIN (SELECT sequence_id, count(*) AS n FROM points GROUP BY 1) p USING (sequence_id) LEFT JOIN (SELECT sequence_id, count(*) AS n FROM forecast GROUP BY 1) c USING (sequence_id)""",
    fit_cte("frame_index") + "," + FORECAST))
def _(spark, d):
    # Written by the sink below the session's checkpoint folder, read back by the reader, counted per sequence.
    p = v.points(spark, d)
    fits = r.fit_velocity(p)
    det = v.detections(spark, d).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    seq = v.frames(spark, d).select("sequence_id").distinct().withColumn("source_type", F.lit("synthetic"))
    out = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    sk.write_results_json(sk.nest_results(seq, outcomes(seq, lambda i: i % 3 != 0), det, v.tracks(spark, d), p, fits, r.extrapolate(fits)), out)
    back = rd.read_results(spark, out)
    rows = back["sequences"].select("sequence_id", "status", "detail", "source_type")
    for name in ("detections", "tracks", "points", "predictions"):
        more = [F.sum("x_raw_px").alias("x_sum")] if name == "detections" else []
        rows = rows.join(back[name].groupBy("sequence_id").agg(F.count("*").alias(name), *more), "sequence_id", "left")
    return rows.na.fill(0, ["detections", "tracks", "points", "predictions", "x_sum"]).withColumn("x_sum", F.round("x_sum", 4))


def reread(spark, d):
    """Results nested, written as JSON text and read back through the contract schema."""
    text = nested(spark, d).select(F.to_json(F.struct("*")).alias("j"))
    return rd.result_tables(text.select(F.from_json("j", s.RESULT).alias("m")).select("m.*"))


@query("read_results_points", v.sql("points", """
    SELECT sequence_id, track_id, CAST(row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_index) - 1 AS INTEGER) AS position, frame_index, detection_id,
      round(x_reference_px, 6) AS x_reference_px FROM points"""))
def _(spark, d):
    return reread(spark, d)["points"].select("sequence_id", "track_id", "position", "frame_index", "detection_id", *r6("x_reference_px"))


@query("read_results_trajectories", v.sql("points", "SELECT sequence_id, track_id, round(vx + 3e-8, 6) + 0.0::DOUBLE AS vx, CAST(n AS INTEGER) AS observations_used FROM fits", fit_cte("frame_index")))
def _(spark, d):
    return reread(spark, d)["trajectories"].select("sequence_id", "track_id", *n6("vx"), "observations_used")


@query("read_results_predictions", v.sql("points", "SELECT sequence_id, track_id, CAST(frame_index AS INTEGER) AS frame_index, round(x + 3e-8, 6) + 0.0::DOUBLE AS x_reference_px FROM forecast", fit_cte("frame_index") + "," + FORECAST))
def _(spark, d):
    return reread(spark, d)["predictions"].select("sequence_id", "track_id", "frame_index", *n6("x_reference_px"))


@query("read_results_tracks", v.sql("tracks", "SELECT sequence_id, track_id, status, CAST(observed_count AS INTEGER) AS observed_count FROM tracks"))
def _(spark, d):
    return reread(spark, d)["tracks"].select("sequence_id", "track_id", "status", "observed_count")


@query("read_results_detections", v.sql("detections", "SELECT sequence_id, detection_id, frame_index, round(x, 6) AS x_raw_px, round(x0, 6) AS box_x0 FROM detections"))
def _(spark, d):
    x = reread(spark, d)["detections"]
    return x.select("sequence_id", "detection_id", "frame_index", *r6("x_raw_px"), F.round(F.col("bbox_raw_px")[0], 6).alias("box_x0"))


@query("read_rendered_truth", v.sql("truth", """
    SELECT sequence_id, frame_index, target_id, visible, count(*) AS objects, round(sum(x), 4) AS x_sum FROM truth GROUP BY ALL"""))
def _(spark, d):
    t = v.truth(spark, d)
    obj = F.struct(F.col("target_id").alias("object_id"), "visible", F.lit("rendered").alias("reason"), F.array("x", "y").alias("raw_xy_px"), F.array("x", "y").alias("reference_xy_px"))
    f = t.groupBy("sequence_id", "frame_index").agg(F.array_sort(F.collect_list(obj)).alias("objects"))
    text = f.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", "objects"))).alias("frames")).select(F.to_json(F.struct("*")).alias("j"))
    p = rd.rendered_truth_points(text.select(F.from_json("j", s.RENDERED_TRUTH).alias("m")).select("m.*"))
    return p.groupBy("sequence_id", "frame_index", "target_id", "visible").agg(F.count("*").alias("objects"), F.round(F.sum("x"), 4).alias("x_sum"))


@query("track_point_rows", v.sql("points", """
    SELECT sequence_id, track_id, frame_index, point_type, detection_id, round(x_reference_px + 3e-8, 6) AS x_reference_px, 'raw' AS coordinate_frame, 'frame' AS time_basis FROM points
    UNION ALL SELECT sequence_id, track_id, frame_index, 'extrapolated', NULL, round(x + 3e-8, 6) + 0.0::DOUBLE, 'raw', 'frame' FROM forecast""", fit_cte("frame_index") + "," + FORECAST))
def _(spark, d):
    p = v.points(spark, d)
    rows = sk.track_point_rows(p, r.extrapolate(r.fit_velocity(p)))
    return rows.select("sequence_id", "track_id", "frame_index", "point_type", "detection_id", *n6("x_reference_px"), "coordinate_frame", "time_basis")


TREE = """lf AS (SELECT split, substr(sha256(name), 1, 4) AS leaf, sha256(string_agg(sha256 || ' ' || name, chr(10) ORDER BY sha256 || ' ' || name)) AS dg, count(*) AS n FROM manifest GROUP BY ALL),
    br AS (SELECT split, substr(leaf, 1, 2) AS br, sha256(string_agg(leaf || ' ' || dg, chr(10) ORDER BY leaf || ' ' || dg)) AS dg, sum(n) AS n FROM lf GROUP BY ALL)"""


@query("hash_manifest", v.sql("manifest", """
    SELECT split, sha256(string_agg(br || ' ' || dg, chr(10) ORDER BY br || ' ' || dg)) AS manifest_sha256, CAST(sum(n) AS BIGINT) AS files FROM br GROUP BY 1""", TREE))
def _(spark, d):
    return rd.manifest_digest(v.manifest(spark, d), ["split"])


@query("provenance", v.sql("ids", """
    SELECT sequence_id, sha256('{"sequence_id":"' || sequence_id || '","user_id":' || user_id || '}') AS input_sha256, sha256('{"gate":20,"mode":"standard"}') AS config_sha256 FROM ids"""))
def _(spark, d):
    ids = v.read(spark, d, "events").select("user_id").distinct().withColumn("sequence_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return rd.provenance(ids, {"mode": "standard", "gate": 20}, ["user_id", "sequence_id"])


def event_stream(spark, d):
    """The events table as a stream of detections with their day as frame."""
    schema = v.read(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sequence_id"), F.expr("datediff(cast(ts as date), date'2024-01-01')").alias("frame_index"),
        F.concat(F.lit("d"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("detection_id"), F.col("value").alias("x"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("y"), ((F.col("event_id") * 37 % 101) / 100.0).alias("quality_score"),
        F.expr("datediff(cast(ts as date), date'2024-01-01') - 1").alias("closes"), F.col("ts").cast("timestamp").alias("event_time"),
    )


def staged(spark, d, batches=4):
    """The detections as files of a stream folder, out of order, and last files that end every sequence."""
    det = v.detections(spark, d).select("sequence_id", "frame_index", "detection_id", "x", "y", "quality_score").withColumn("ends", F.lit(False))
    null = lambda c: F.lit(None).cast(det.schema[c].dataType).alias(c)
    ends = det.select("sequence_id").distinct().select("sequence_id", *[null(c) for c in det.columns[1:-1]], F.lit(True).alias("ends"))
    tasks = batches * -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    return stream_of(spark, [det.repartition(tasks, F.xxhash64("detection_id")), ends], batches + 1)


def stream_of(spark, tables, batches):
    """Tables written one after the other, each by as many tasks as it has, and read in about `batches` micro-batches in that order."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for t in tables:
        t.write.mode("append").parquet(folder)
    files = spark.read.parquet(folder).select(F.input_file_name().alias("f")).distinct().count()
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(folder)


SLICES, DAY = 8, 86400


def timed(spark, rows, ident):
    """Rows as a stream in order of frames by slices, with event times spread over the frame's day, and how far the order is off.

    A row far ahead, of a sequence without a name, moves the watermark past all others; its own frame stays open.
    """
    last = rows.agg(F.max("frame_index").alias("m")).first()["m"] or 0
    width = last // SLICES + 1
    at = F.timestamp_seconds(F.col("frame_index") * DAY + F.pmod(F.xxhash64(ident), F.lit(DAY)))
    rows = rows.withColumn("event_time", at)
    first = {f.name: "" if f.dataType.simpleString() == "string" else 0 for f in rows.schema if f.name != "event_time"}
    ahead = spark.range(1).select(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in first.items()], F.timestamp_seconds(F.lit((last + 4 * width + 9) * DAY)).alias("event_time"))
    return stream_of(spark, [rows.where(F.floor(F.col("frame_index") / width) == k) for k in range(SLICES)] + [ahead], SLICES), f"{width + 1} days"


@query("track_stream")
def _(spark, d):
    return st.run_available(st.track_stream(staged(spark, d)))


# Every detection comes out once, in its own frame, and none is late.
@query("track_stream_observed", v.sql("detections", "SELECT sequence_id, CAST(frame_index AS INTEGER) AS frame_index, detection_id, 'observed' AS event FROM detections"))
def _(spark, d):
    out = st.run_available(st.track_stream(staged(spark, d)))
    return out.where("detection_id is not null").select("sequence_id", "frame_index", "detection_id", "event")


# The same, with frames closed by event times that are spread over each frame.
@query("track_stream_timed", v.sql("detections", "SELECT sequence_id, CAST(frame_index AS INTEGER) AS frame_index, detection_id, 'observed' AS event FROM detections"))
def _(spark, d):
    rows, delay = timed(spark, v.detections(spark, d).select("sequence_id", "frame_index", "detection_id", "x", "y", "quality_score"), "detection_id")
    out = st.run_available(st.track_stream(rows, time="event_time", delay=delay))
    return out.where("detection_id is not null").select("sequence_id", "frame_index", "detection_id", "event")


@query("frame_metrics_stream", v.sql("pairs", """
    SELECT sequence_id, CAST(frame_index AS INTEGER) AS frame_index, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn,
      round(coalesce(sum(distance * distance), 0), 6) AS squared_error FROM outcomes GROUP BY ALL""", OUTCOMES))
def _(spark, d):
    det, delay = timed(spark, v.detections(spark, d).select("sequence_id", "frame_index", "detection_id", "x", "y"), "detection_id")
    truth, _ = timed(spark, v.visible_truth(spark, d).select("sequence_id", "frame_index", "truth_id", "x", "y"), "truth_id")
    out = st.run_available(st.frame_metrics_stream(det, truth, 5.0, delay=delay, lasts="1 day"))
    return out.select("sequence_id", "frame_index", "tp", "fp", "fn", *r6("squared_error"))


@query("frame_counts_stream", v.sql("detections", """
    SELECT sequence_id, frame_index, count(*) AS detections, round(avg(quality_score), 6) AS mean_quality FROM detections GROUP BY ALL"""))
def _(spark, d):
    c = st.run_available(st.frame_counts_stream(event_stream(spark, d)), "complete")
    day = F.expr("datediff(cast(window_start as date), date'2024-01-01')")
    return c.select("sequence_id", day.alias("frame_index"), "detections", *r6("mean_quality"))
