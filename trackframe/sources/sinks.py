"""Sinks: flat CSV of track points and nested result JSON. Nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.schemas import CSV_COLUMNS, LABEL, VERSION

KEY = ["sequence_id", "track_id"]


def track_point_rows(points: DataFrame, predictions: DataFrame, coordinate_frame: str = "raw", time_basis: str = "frame") -> DataFrame:
    """Observed, then predicted points in the nine export columns, plus sequence_id."""

    def shape(df):
        for c, t in (("detection_id", "string"), ("timestamp_s", "double")):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast(t))
        full = df.withColumns({"coordinate_frame": F.lit(coordinate_frame), "time_basis": F.lit(time_basis)})
        return full.select("sequence_id", *CSV_COLUMNS)

    return shape(points).unionByName(shape(predictions))


def write_track_points_csv(rows: DataFrame, path: str) -> None:
    """One sorted CSV part per range of sequences; an existing path is an error."""
    ordered = rows.repartitionByRange("sequence_id", "track_id").sortWithinPartitions("sequence_id", "track_id", "frame_index")
    ordered.write.mode("errorifexists").option("header", True).csv(path)


def nest_results(
    sequences: DataFrame, outcomes: DataFrame, detections: DataFrame, tracks: DataFrame, points: DataFrame, fits: DataFrame, predictions: DataFrame,
    coordinate_frame: str = "raw", time_basis: str = "frame", registration: DataFrame | None = None, provenance: DataFrame | None = None,
) -> DataFrame:
    """One nested row per sequence in the result contract's shape.

    `outcomes` (sequence_outcome) gives status and detail; a sequence that it does not
    call succeeded, or does not name, is written with empty lists and never as a success.
    sequences may carry job_id, source_type, profile, runtime_ms and warnings;
    registration(sequence_id, status, warnings) and provenance(sequence_id, input_sha256,
    config_sha256, …) fill the rest of the envelope. Export only: the contract wants a
    sequence in one document, and it bounds a sequence to 30 frames.
    """
    done = outcomes.where("status = 'succeeded'").select("sequence_id")
    detections, tracks, points, fits, predictions = (t.join(done, "sequence_id", "left_semi") for t in (detections, tracks, points, fits, predictions))
    null = lambda t: F.lit(None).cast(t)
    col = lambda df, c, t: F.col(c) if c in df.columns else null(t)

    def point(df, kind):
        return F.struct(
            F.col("frame_index").cast("int").alias("frame_index"), (col(df, "timestamp_s", "double") if time_basis == "second" else null("double")).alias("timestamp_s"),
            "x_reference_px", "y_reference_px", col(df, "x_raw_px", "double").alias("x_raw_px"), col(df, "y_raw_px", "double").alias("y_raw_px"),
            F.lit(kind).alias("point_type"), col(df, "detection_id", "string").alias("detection_id"), col(df, "out_of_field", "boolean").alias("out_of_field"),
        )

    listed = lambda df, c: df.agg(F.array_sort(F.collect_list(c)).alias("items"))
    seen = listed(points.where("point_type = 'observed'").groupBy(*KEY), point(points, "observed")).withColumnRenamed("items", "points")
    ahead = listed(predictions.groupBy(*KEY), point(predictions, "extrapolated")).withColumnRenamed("items", "predictions")
    path = fits.where("status = 'fitted'").join(ahead, KEY, "left").select(
        *KEY,
        F.struct(
            F.lit("constant_velocity").alias("model"), F.lit(coordinate_frame).alias("coordinate_frame"), F.lit(time_basis).alias("time_basis"), "vx", "vy", "speed",
            "speed_unit", "fit_rmse_px", F.col("observations_used").cast("int").alias("observations_used"), "reference_epoch", "x_at_epoch_px", "y_at_epoch_px", "predictions",
        ).alias("trajectory"),
    )
    full = tracks.join(seen, KEY, "left").join(path, KEY, "left")
    track = F.struct(
        "track_id", "status", F.lit(LABEL).alias("candidate_label"), "points", F.col("observed_count").cast("int").alias("observed_count"), "quality_score",
        col(tracks, "warnings", "array<string>").alias("warnings"), "trajectory",
    )
    by_track = listed(full.groupBy("sequence_id"), track).withColumnRenamed("items", "tracks")
    evidence = [F.map_entries("evidence_statistics").alias("evidence_statistics")] if "evidence_statistics" in detections.columns else []
    box = F.array("box.x0", "box.y0", "box.x1", "box.y1")
    det = F.struct(
        "detection_id", F.col("frame_index").cast("int").alias("frame_index"), "x_raw_px", "y_raw_px", box.alias("bbox_raw_px"), "kind", "quality_score", "detector_name",
        col(detections, "x_reference_px", "double").alias("x_reference_px"), col(detections, "y_reference_px", "double").alias("y_reference_px"),
        col(detections, "endpoints_raw_px", "array<array<double>>").alias("endpoints_raw_px"), *evidence,
    )
    by_det = listed(detections.groupBy("sequence_id"), det).withColumnRenamed("items", "detections")
    if evidence:  # maps have no order to sort by: put back after the sort
        by_det = by_det.withColumn("detections", F.transform("detections", lambda e: e.withField("evidence_statistics", F.map_from_entries(e["evidence_statistics"]))))
    envelope = sequences.select(
        "sequence_id", *[col(sequences, c, t).alias(c) for c, t in (("job_id", "string"), ("source_type", "string"), ("profile", "string"), ("runtime_ms", "double"), ("warnings", "array<string>"))]
    )
    given = registration.select("sequence_id", F.struct("status", "warnings").alias("registration")) if registration is not None else None
    made = None
    if provenance is not None:
        parts = [col(provenance, c, "string").alias(c) for c in ("input_sha256", "config_sha256", "code_commit", "dataset_version")]
        made = provenance.select("sequence_id", F.struct(*parts).alias("provenance"))
    rows = envelope.join(outcomes.select("sequence_id", "status", "detail"), "sequence_id", "left").join(by_det, "sequence_id", "left").join(by_track, "sequence_id", "left")
    for extra in (given, made):
        rows = rows.join(extra, "sequence_id", "left") if extra is not None else rows
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    own = lambda c, t: (F.col(c) if c in rows.columns else null(t)).alias(c)
    return rows.select(
        F.lit(VERSION).alias("schema_version"), "job_id", "sequence_id", "source_type", "profile", F.coalesce("status", F.lit("uncertain_observation")).alias("status"),
        F.when(F.col("status").isNull(), "no outcome was recorded").otherwise(F.col("detail")).alias("detail"), F.lit(time_basis).alias("time_basis"),
        F.lit(coordinate_frame).alias("coordinate_frame"), own("registration", "struct<status:string,warnings:array<string>>"), empty("detections"), empty("tracks"), "runtime_ms",
        empty("warnings"), own("provenance", "struct<input_sha256:string,config_sha256:string,code_commit:string,dataset_version:string>"),
    )


def write_results_json(results: DataFrame, path: str) -> None:
    """One JSON document per sequence and line; an existing path is an error."""
    results.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
