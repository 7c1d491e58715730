"""Readers: nested and textual inputs to flat tables.

Each reader is a thin scan plus a table function over its rows, so that the same
expressions serve files, tables and streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe import schemas as s
from trackframe.functions.columns import all_of, finite


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON with a declared schema; unparsable records keep their text in `_corrupt`.

    One document a line by default, so files are split. `multiline=True` is for files
    of a single document (or one array) spread over lines: each such file is one task.
    """
    full = s.ddl(schema + ", _corrupt string")
    return spark.read.schema(full).option("multiLine", multiline).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def split_rejected(raw: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good documents, rejected ones with sequence_id, record and reason); no document is lost."""
    reason = F.when(F.col("_corrupt").isNotNull(), "not a document of the declared form")
    for c in required:
        reason = reason.when(F.col(c).isNull(), f"{c} is missing")
    judged = raw.withColumn("reason", reason)
    record = F.coalesce("_corrupt", F.to_json(F.struct(*[c for c in raw.columns if c != "_corrupt"]))).alias("record")
    return judged.where("reason is null").drop("_corrupt", "reason"), judged.where("reason is not null").select("sequence_id", record, "reason")


def unknown_fields(raw: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows of JSON text whose top level has a key outside `allowed` (strict schema)."""
    keys = F.json_object_keys(column)
    extra = F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))
    return raw.withColumn("unknown_fields", extra).where(F.size("unknown_fields") > 0)


def sequence_frames(sequences: DataFrame) -> DataFrame:
    """One row per declared frame, with its stored position."""
    return sequences.select("sequence_id", F.posexplode("frames").alias("position", "f")).select("sequence_id", "position", "f.*")


def read_sequences(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, frames, rejected documents) from sequence manifests."""
    good, rejected = split_rejected(read_json(spark, path, s.SEQUENCE, multiline), ["sequence_id", "frames"])
    return good.drop("frames"), sequence_frames(good), rejected


def parse_frame_paths(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(frames, rejected paths with reason) of …/split/<sequence>/<1..5>.png.

    A sequence number is written without leading zeros; any other name is rejected.
    """
    part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)$", i)
    reason = (
        F.when(~F.col(path).rlike(r"[^/]+/[^/]+/[^/]+$"), "not split/sequence/frame").when(~part(2).rlike(r"^(0|[1-9][0-9]*)$"), "sequence is not a canonical number")
        .when(~part(3).rlike(r"^[1-5]\.png$"), "unsupported frame name")
    )
    judged = files.withColumn("reason", reason)
    frames = judged.where("reason is null").select(
        part(1).alias("split"), part(2).alias("sequence_id"), F.substring(part(3), 1, 1).cast("int").alias("frame"), F.col(path).alias("path"),
        *[c for c in files.columns if c != path],
    )
    return frames.withColumn("sequence_number", F.col("sequence_id").cast("bigint")), judged.where("reason is not null").select(F.col(path).alias("path"), "reason")


def incomplete_folders(frames: DataFrame, expected: int = 5) -> DataFrame:
    """Sequences that lack some of their frames, with the numbers that are missing."""
    seen = frames.groupBy("split", "sequence_id").agg(F.collect_set("frame").alias("seen"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(expected)), "seen")
    return seen.where(F.size(missing) > 0).select("split", "sequence_id", F.array_sort(missing).alias("missing"))


def read_frame_listing(spark: SparkSession, root: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(frame files, rejected names) below root, by name only: file contents are never opened."""
    files = spark.read.format("binaryFile").load(f"{root}/{split or '*'}/*/*").select("path", "length")
    return parse_frame_paths(files)


def label_points(records: DataFrame) -> DataFrame:
    """One row per labelled point; frames without objects keep one row of NULLs."""
    return records.select("sequence_id", "frame", "num_objects", F.posexplode_outer("object_coords").alias("label_index", "p")).select(
        "sequence_id", "frame", (F.col("frame") - 1).alias("frame_index"), "num_objects", "label_index", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")
    )


def read_point_labels(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(label records, exploded points, rejected records) from lines of JSON records or arrays of them."""
    good, rejected = split_rejected(read_json(spark, path, s.POINT_LABEL, multiline), ["sequence_id", "frame"])
    return good, label_points(good), rejected


def parse_box_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """`class cx cy w h` lines to columns; a bad line keeps its reason, blank ones go."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    p = lines.where(F.trim(text) != "").withColumns({"_n": F.size(parts), "class": n(0), "cx": n(1), "cy": n(2), "w": n(3), "h": n(4)})
    names = ["class", "cx", "cy", "w", "h"]
    unit = F.col("cx").between(0, 1) & F.col("cy").between(0, 1) & (F.col("w") > 0) & (F.col("w") <= 1) & (F.col("h") > 0) & (F.col("h") <= 1)
    reason = (
        F.when(F.col("_n") != 5, "expected five fields").when(~all_of([finite(c) for c in names]), "not a finite number")
        .when(F.col("class") != 0, "class is not 0").when(~unit, "normalized coordinates outside bounds")
    )
    return p.withColumn("reason", reason).drop("_n")


def read_box_labels(spark: SparkSession, path: str, listing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(box rows with reasons, files) from label text files.

    Spark's file scans leave out files of zero bytes. A `listing` with a column path
    (a manifest of the folder) brings them back as empty files.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    files = raw.select(stem.alias("stem"), (F.trim(F.regexp_replace("value", r"\s+", " ")) == "").alias("empty"))
    if listing is not None:
        named = listing.select(stem.alias("stem")).distinct()
        files = named.join(files, "stem", "left").select("stem", F.coalesce("empty", F.lit(True)).alias("empty"))
    lines = raw.select("path", stem.alias("stem"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return parse_box_lines(lines.withColumn("line", F.col("line") + 1)), files


def parse_box_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes, error rows) from rows(ImageID, bboxes); the list is parsed, never run."""
    text = F.translate("bboxes", "()", "[]")
    r = rows.withColumn("parsed", F.from_json(text, "array<array<double>>"))
    bad_value = F.exists("parsed", lambda b: b.isNull() | (F.size(b) == 0) | F.exists(b, lambda x: ~finite(x)))
    r = r.withColumn("reason", F.when(F.col("parsed").isNull(), "not a box list").when(F.coalesce(bad_value, F.lit(False)), "invalid box values"))
    repeats = rows.groupBy("ImageID").agg(F.count("*").alias("n")).where("n > 1").select("ImageID", F.lit("duplicate ID").alias("reason"))
    errors = r.where("reason is not null").select("ImageID", "reason").unionByName(repeats)
    boxes = r.where("reason is null").select("ImageID", F.posexplode_outer("parsed").alias("box_index", "box"))
    return boxes.withColumn("arity", F.size("box")), errors


def box_arity_histogram(boxes: DataFrame) -> DataFrame:
    """Boxes by number of values, and rows without any box as arity 0."""
    return boxes.groupBy(F.when(F.col("box").isNull(), 0).otherwise(F.col("arity")).alias("arity")).agg(F.count("*").alias("boxes"))


def read_box_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    schema = s.ddl("ImageID string, bboxes string")
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"').csv(path)
    return parse_box_csv(rows)


def result_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Nested results to detections, tracks, points, trajectories and predictions."""
    dets = results.select("sequence_id", F.explode("detections").alias("d")).select("sequence_id", "d.*")
    t = results.select("sequence_id", "coordinate_frame", "time_basis", F.explode("tracks").alias("t"))
    key = ["sequence_id", F.col("t.track_id").alias("track_id")]
    points = t.select(*key, F.posexplode("t.points").alias("position", "p")).select("sequence_id", "track_id", "position", "p.*")
    tracks = t.select(*key, "t.status", "t.candidate_label", "t.observed_count", "t.quality_score", "t.warnings")
    j = t.where("t.trajectory is not null").select(*key, "t.trajectory")
    fits = j.select("sequence_id", "track_id", "trajectory.*").drop("predictions")
    ahead = j.select("sequence_id", "track_id", F.explode("trajectory.predictions").alias("p")).select("sequence_id", "track_id", "p.*")
    return {"detections": dets, "tracks": tracks, "points": points, "trajectories": fits, "predictions": ahead}


def read_results(spark: SparkSession, path: str, multiline: bool = False) -> dict[str, DataFrame]:
    """The tables of `result_tables`, the outcome and envelope per sequence, and rejected documents."""
    good, rejected = split_rejected(read_json(spark, path, s.RESULT, multiline), ["sequence_id", "status"])
    return {**result_tables(good), "sequences": good.drop("detections", "tracks"), "rejected": rejected}


def rendered_truth_points(rendered: DataFrame, space: str = "raw") -> DataFrame:
    """Truth rows with visibility and reason from nested rendered truth."""
    f = rendered.select("sequence_id", F.explode("frames").alias("f")).select("sequence_id", "f.frame_index", F.explode("f.objects").alias("o"))
    xy = F.col(f"o.{space}_xy_px")
    return f.select(
        "sequence_id", "frame_index", F.concat_ws("/", F.col("frame_index").cast("string"), "o.object_id").alias("truth_id"),
        F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"), F.col("o.object_id").alias("target_id"), F.col("o.visible").alias("visible"), F.col("o.reason").alias("reason"),
    )


def read_rendered_truth(spark: SparkSession, path: str, space: str = "raw", multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(truth points, rejected documents)."""
    good, rejected = split_rejected(read_json(spark, path, s.RENDERED_TRUTH, multiline), ["sequence_id", "frames"])
    return rendered_truth_points(good, space), rejected


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, size) of every file; contents are hashed in the scan's tasks."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")
    )


def manifest_digest(manifest: DataFrame, by: list[str] = []) -> DataFrame:
    """One digest over all (name, sha256) rows, whatever their order.

    A hash tree: rows fall into 65,536 leaves by their name's hash, leaf digests into
    256 branches, branches into the root; no step gathers a whole manifest.
    """
    line = F.concat_ws(" ", "sha256", "name")
    leaf = manifest.select(*by, F.substring(F.sha2("name", 256), 1, 4).alias("leaf"), line.alias("line"))

    def fold(df, keys, text, out):
        return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias(out), F.sum("n").alias("n"))

    leaves = fold(leaf.withColumn("n", F.lit(1)), [*by, "leaf"], "line", "digest")
    leaves = leaves.select(*by, F.substring("leaf", 1, 2).alias("branch"), F.concat_ws(" ", "leaf", "digest").alias("line"), "n")
    branches = fold(leaves, [*by, "branch"], "line", "digest").select(*by, F.concat_ws(" ", "branch", "digest").alias("line"), "n")
    return fold(branches, by, "line", "manifest_sha256").withColumnRenamed("n", "files")


def provenance(sequences: DataFrame, config: dict, input_columns: list[str]) -> DataFrame:
    """Input digest per sequence and digest of the configuration in sorted-key JSON."""
    import json

    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    own = F.sha2(F.to_json(F.struct(*sorted(input_columns))), 256)
    given = F.col("input_sha256") if "input_sha256" in sequences.columns else F.lit(None).cast("string")
    return sequences.select("sequence_id", F.coalesce(given, own).alias("input_sha256"), F.sha2(F.lit(text), 256).alias("config_sha256"))
