"""Detections, truth, frames, tracks, pixels … derived from the driver's tables.

Every view has two spellings: a DataFrame builder and the same text in plain SQL for
the side-by-side check. They read whole tables; work grows with the number of users
(sequences), suppliers (pixel sequences) and documents (manifest rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WIDTH, HEIGHT, N_FRAMES = 512, 128, 30


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sequence_id"),
        F.expr("datediff(cast(ts as date), date'2024-01-01')").alias("frame_index"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6).alias("timestamp_s"),
        F.col("value").alias("x"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("y"),
        "event_id", "user_id", "event_type",
    )


def detections(spark, d) -> DataFrame:
    b = base(spark, d)
    return b.select(
        "sequence_id", "frame_index", F.concat(F.lit("d"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("detection_id"),
        "x", "y",
        F.struct(
            F.greatest(F.col("x") - 2, F.lit(0.0)).alias("x0"), F.greatest(F.col("y") - 2, F.lit(0.0)).alias("y0"),
            (F.col("x") + 2).alias("x1"), (F.col("y") + 2).alias("y1"),
        ).alias("box"),
        F.when(F.col("event_type").isin("click", "view"), "compact").otherwise("unknown").alias("kind"),
        ((F.col("event_id") * 37 % 101) / 100.0).alias("quality_score"),
        F.col("event_type").alias("detector_name"), "timestamp_s",
    )


def contract_detections(spark, d) -> DataFrame:
    """Detections under the contract's column names, reference = raw + transform."""
    t = transforms(spark, d).select("sequence_id", "frame_index", "tx", "ty")
    return (
        detections(spark, d).join(t, ["sequence_id", "frame_index"])
        .withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
        .withColumn("x_reference_px", F.col("x_raw_px") + F.col("tx"))
        .withColumn("y_reference_px", F.col("y_raw_px") + F.col("ty"))
        .drop("tx", "ty")
    )


def truth(spark, d) -> DataFrame:
    return base(spark, d).select(
        "sequence_id", "frame_index", F.concat(F.lit("g"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("truth_id"),
        (F.col("x") + F.col("event_id") % 11 - 5).alias("x"), (F.col("y") + F.col("event_id") % 9 - 4).alias("y"),
        F.col("event_type").alias("target_id"), (F.col("event_type") != "error").alias("visible"),
    )


def visible_truth(spark, d) -> DataFrame:
    return truth(spark, d).where("visible").drop("visible")


def frames(spark, d) -> DataFrame:
    ids = read(spark, d, "events").select("user_id").distinct()
    return ids.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sequence_id"), "user_id",
        F.explode(F.sequence(F.lit(0), F.lit(N_FRAMES - 1))).alias("frame_index"),
    ).select(
        "sequence_id", "frame_index", F.lit(WIDTH).alias("width_px"), F.lit(HEIGHT).alias("height_px"),
        (F.col("frame_index") * 60.0 + F.when(F.col("user_id") % 7 == 0, F.col("frame_index") % 2).otherwise(0) * 0.5).alias("timestamp_s"),
    )


def transforms(spark, d) -> DataFrame:
    ids = read(spark, d, "events").select("user_id").distinct()
    failed = (F.col("frame_index") == 28) & (F.col("user_id") % 10 == 0)
    return ids.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(N_FRAMES - 1))).alias("frame_index")).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sequence_id"), "frame_index",
        F.when(failed, "failed").otherwise("estimated").alias("status"),
        F.when(~failed, F.col("frame_index") / 2.0).alias("tx"), F.when(~failed, F.col("frame_index") / -4.0).alias("ty"),
    )


def points(spark, d) -> DataFrame:
    """One track per (sequence, event type): its best-quality detection per frame."""
    best = detections(spark, d).groupBy("sequence_id", F.concat(F.lit("trk-"), "detector_name").alias("track_id"), "frame_index").agg(
        F.max(F.struct("quality_score", "detection_id", "x", "y")).alias("m")
    )
    return best.select(
        "sequence_id", "track_id", "frame_index", F.col("m.detection_id").alias("detection_id"),
        F.col("m.x").alias("x_reference_px"), F.col("m.y").alias("y_reference_px"),
        F.col("m.x").alias("x_raw_px"), F.col("m.y").alias("y_raw_px"), F.lit("observed").alias("point_type"),
        F.col("m.quality_score").alias("quality_score"), (F.col("frame_index") * 60.0).alias("timestamp_s"),
    )


def tracks(spark, d) -> DataFrame:
    from trackframe.operators.tracking import lifecycle

    last = frames(spark, d).groupBy("sequence_id").agg(F.max("frame_index").alias("sequence_last_frame"))
    return lifecycle(points(spark, d), last)


def pred_boxes(spark, d) -> DataFrame:
    box = F.struct(*[(F.col(c) + s).alias(n) for n, c, s in (("x0", "x", -2), ("y0", "y", -2), ("x1", "x", 2), ("y1", "y", 2))])
    return detections(spark, d).select("sequence_id", "frame_index", "detection_id", box.alias("box"))


def truth_boxes(spark, d) -> DataFrame:
    half = lambda c, s: (F.col(c) + s * (2 + F.length("target_id") / 8.0))
    box = F.struct(half("x", -1).alias("x0"), half("y", -1).alias("y0"), half("x", 1).alias("x1"), half("y", 1).alias("y1"))
    # Boxes sit near their detection: a third of the point offset keeps overlaps common.
    b = base(spark, d)
    near = b.select(
        "sequence_id", "frame_index", F.concat(F.lit("g"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("truth_id"),
        (F.col("x") + (F.col("event_id") % 11 - 5) / 4.0).alias("x"), (F.col("y") + (F.col("event_id") % 9 - 4) / 4.0).alias("y"),
        F.col("event_type").alias("target_id"),
    )
    return near.select("sequence_id", "frame_index", "truth_id", box.alias("box"))


def correspondences(spark, d) -> DataFrame:
    w = W.partitionBy("sequence_id", "frame_index").orderBy("detection_id")
    moved = F.when(F.col("feature_ix") % 4 == 3, 12.0).otherwise(0.0)
    return detections(spark, d).select(
        "sequence_id", "frame_index", (F.row_number().over(w) - 1).alias("feature_ix"), F.col("x").alias("ref_x"), F.col("y").alias("ref_y")
    ).select(
        "*", (F.col("ref_x") - F.col("frame_index") / 2.0 + moved).alias("raw_x"), (F.col("ref_y") + F.col("frame_index") / 4.0).alias("raw_y")
    )


def pixels(spark, d) -> DataFrame:
    """Sparse 16 x 12 frames: one sequence per supplier, one frame per line number."""
    return read(spark, d, "lineitem").groupBy(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("sequence_id"), F.col("l_linenumber").alias("frame_index"),
        (F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_orderkey") % 12).cast("int").alias("y"),
    ).agg((F.max("l_quantity") / 50.0).alias("value"))


def manifest(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "source", F.col("lang").alias("split"),
        F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"),
    )


SQL = {
    "base": ("", """SELECT 'u' || user_id AS sequence_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS frame_index,
        date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6 AS timestamp_s, value AS x,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y, event_id, user_id, event_type FROM events"""),
    "detections": ("base", """SELECT sequence_id, frame_index, 'd' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS detection_id, x, y,
        greatest(x - 2, 0) AS x0, greatest(y - 2, 0) AS y0, x + 2 AS x1, y + 2 AS y1,
        CASE WHEN event_type IN ('click', 'view') THEN 'compact' ELSE 'unknown' END AS kind,
        (event_id * 37 % 101) / 100.0::DOUBLE AS quality_score, event_type AS detector_name, timestamp_s FROM base"""),
    "contract_detections": ("detections transforms", """SELECT d.sequence_id, d.frame_index, detection_id, x AS x_raw_px, y AS y_raw_px, x0, y0, x1, y1, kind,
        quality_score, detector_name, timestamp_s, x + tx AS x_reference_px, y + ty AS y_reference_px
        FROM detections d JOIN transforms t USING (sequence_id, frame_index)"""),
    "truth": ("base", """SELECT sequence_id, frame_index, 'g' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS truth_id,
        x + event_id % 11 - 5 AS x, y + event_id % 9 - 4 AS y, event_type AS target_id, event_type <> 'error' AS visible FROM base"""),
    "visible_truth": ("truth", "SELECT sequence_id, frame_index, truth_id, x, y, target_id FROM truth WHERE visible"),
    "ids": ("", "SELECT DISTINCT user_id, 'u' || user_id AS sequence_id FROM events"),
    "frames": ("ids", f"""SELECT sequence_id, CAST(f AS INTEGER) AS frame_index, {WIDTH} AS width_px, {HEIGHT} AS height_px,
        f * 60.0::DOUBLE + CASE WHEN user_id % 7 = 0 THEN f % 2 ELSE 0 END * 0.5::DOUBLE AS timestamp_s
        FROM ids CROSS JOIN (SELECT unnest(range(0, {N_FRAMES})) AS f)"""),
    "transforms": ("ids", f"""SELECT sequence_id, CAST(f AS INTEGER) AS frame_index,
        CASE WHEN f = 28 AND user_id % 10 = 0 THEN 'failed' ELSE 'estimated' END AS status,
        CASE WHEN NOT (f = 28 AND user_id % 10 = 0) THEN f / 2.0::DOUBLE END AS tx,
        CASE WHEN NOT (f = 28 AND user_id % 10 = 0) THEN f / -4.0::DOUBLE END AS ty
        FROM ids CROSS JOIN (SELECT unnest(range(0, {N_FRAMES})) AS f)"""),
    "points": ("detections", """SELECT sequence_id, 'trk-' || detector_name AS track_id, frame_index, detection_id, x AS x_reference_px, y AS y_reference_px,
        x AS x_raw_px, y AS y_raw_px, 'observed' AS point_type, quality_score, frame_index * 60.0::DOUBLE AS timestamp_s FROM (SELECT *, row_number() OVER (
        PARTITION BY sequence_id, detector_name, frame_index ORDER BY quality_score DESC, detection_id DESC) AS rn FROM detections) WHERE rn = 1"""),
    "tracks": ("points", f"""SELECT sequence_id, track_id, count(*) AS observed_count, avg(quality_score) AS quality_score,
        min(frame_index) AS first_frame, max(frame_index) AS last_frame,
        CASE WHEN {N_FRAMES - 1} - max(frame_index) > 2 THEN 'ended' WHEN count(*) >= 3 THEN 'confirmed' ELSE 'tentative' END AS status
        FROM points GROUP BY sequence_id, track_id"""),
    "pred_boxes": ("detections", "SELECT sequence_id, frame_index, detection_id, x - 2 AS x0, y - 2 AS y0, x + 2 AS x1, y + 2 AS y1 FROM detections"),
    "truth_boxes": ("base", """SELECT sequence_id, frame_index, truth_id, x - h AS x0, y - h AS y0, x + h AS x1, y + h AS y1 FROM (
        SELECT sequence_id, frame_index, 'g' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS truth_id, x + (event_id % 11 - 5) / 4.0::DOUBLE AS x,
        y + (event_id % 9 - 4) / 4.0::DOUBLE AS y, 2 + length(event_type) / 8.0::DOUBLE AS h FROM base)"""),
    "correspondences": ("detections", """SELECT sequence_id, frame_index, feature_ix, ref_x, ref_y,
        ref_x - frame_index / 2.0::DOUBLE + CASE WHEN feature_ix % 4 = 3 THEN 12.0 ELSE 0.0 END AS raw_x, ref_y + frame_index / 4.0::DOUBLE AS raw_y FROM (
        SELECT sequence_id, frame_index, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY detection_id) - 1 AS feature_ix,
        x AS ref_x, y AS ref_y FROM detections)"""),
    "pixels": ("", """SELECT 's' || l_suppkey AS sequence_id, l_linenumber AS frame_index, CAST(l_partkey % 16 AS INTEGER) AS x,
        CAST(l_orderkey % 12 AS INTEGER) AS y, max(l_quantity) / 50.0::DOUBLE AS value FROM lineitem GROUP BY ALL"""),
    "manifest": ("", """SELECT 'doc-' || doc_id AS name, source, lang AS split, sha256(text) AS sha256, n_chars AS size FROM documents"""),
    # Every one-to-one choice of gated pairs of a frame, built one prediction at a time;
    # the best by (number of pairs, total distance) is the exact matching.
    "gated": ("detections visible_truth", """SELECT d.sequence_id, d.frame_index, d.detection_id, t.truth_id,
        sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) AS distance
        FROM detections d JOIN visible_truth t USING (sequence_id, frame_index)
        WHERE sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) <= 5"""),
    "pairs": ("gated", ""),
}


def exact_pairs(edges: str, left: str, right: str, cost: str) -> str:
    """SQL CTE chain: exact one-to-one matching of a small frame graph by enumeration."""
    return f"""
    m_left AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY {left}) AS li
        FROM (SELECT DISTINCT sequence_id, frame_index, {left} FROM {edges})),
    m_edge AS (SELECT e.*, l.li FROM {edges} e JOIN m_left l USING (sequence_id, frame_index, {left})),
    m_try AS (
        SELECT DISTINCT sequence_id, frame_index, 0 AS li, CAST([] AS VARCHAR[]) AS used, CAST([] AS VARCHAR[]) AS chosen,
            0 AS k, CAST(0 AS DOUBLE) AS total FROM m_edge
        UNION ALL
        SELECT s.sequence_id, s.frame_index, s.li + 1, CASE WHEN e.{right} IS NULL THEN s.used ELSE list_append(s.used, e.{right}) END,
            CASE WHEN e.{right} IS NULL THEN s.chosen ELSE list_append(s.chosen, e.{left}) END,
            s.k + CASE WHEN e.{right} IS NULL THEN 0 ELSE 1 END, s.total + coalesce(e.{cost}, 0)
        FROM m_try s JOIN m_left l ON l.sequence_id = s.sequence_id AND l.frame_index = s.frame_index AND l.li = s.li + 1
        JOIN (SELECT sequence_id, frame_index, li, {left}, {right}, {cost} FROM m_edge
              UNION ALL SELECT sequence_id, frame_index, li, {left}, NULL, NULL FROM m_left) e
          ON e.sequence_id = s.sequence_id AND e.frame_index = s.frame_index AND e.li = l.li
        WHERE e.{right} IS NULL OR NOT list_contains(s.used, e.{right})),
    m_best AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY k DESC, total, chosen, used) AS rn
        FROM m_try s WHERE li = (SELECT max(li) FROM m_left l WHERE l.sequence_id = s.sequence_id AND l.frame_index = s.frame_index)),
    pairs AS (SELECT b.sequence_id, b.frame_index, b.{left}, b.{right}, e.{cost} FROM (
            SELECT sequence_id, frame_index, unnest(chosen) AS {left}, unnest(used) AS {right} FROM m_best WHERE rn = 1) b
        JOIN m_edge e USING (sequence_id, frame_index, {left}, {right}))"""


def sql(needs: str, body: str, extra: str = "") -> str:
    """WITH RECURSIVE … over the named views, optional extra CTEs, then the body."""
    done: dict[str, str] = {}

    def add(name):
        if name in done:
            return
        deps, text = SQL[name]
        for dep in deps.split():
            add(dep)
        done[name] = exact_pairs("gated", "detection_id", "truth_id", "distance").strip() if name == "pairs" else f"{name} AS ({text})"

    for name in needs.split():
        add(name)
    ctes = list(done.values()) + ([extra.strip()] if extra else [])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body
