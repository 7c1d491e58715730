"""Quality rules: valid rows beside a violations table (keys, rule)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackframe.functions.columns import finite

# Id pattern, size limits and parameter bounds of the contract.
ID_PATTERN = "^[A-Za-z0-9][A-Za-z0-9_-]{0,95}$"
MAX_PIXELS = 4_000_000
MIN_FRAMES, MAX_FRAMES = 3, 30
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_SEQUENCE_BYTES = 50 * 1024 * 1024
BOUNDS = {
    "denoise_sigma": (0.3, 2.0),
    "background_sigma": (2.0, 30.0),
    "noise_sigma": (2.0, 40.0),
    "threshold_sigma": (2.0, 15.0),
    "max_elongation": (1.0, 20.0),
    "min_area_px": (1, 10_000),
    "max_area_px": (1, 10_000),
    "max_candidates": (1, 2000),
    "min_aperture_snr": (0.0, 100.0),
    "max_peak_fraction": (0.1, 1.0),
    "max_context_elongation": (1.0, 20.0),
    "max_component_aspect": (1.0, 20.0),
    "min_score": (0.0, 1.0),
    "gate_distance_px": (0.0, 200.0),
    "confirmation_observations": (3, 30),
    "max_consecutive_misses": (0, 5),
    "prediction_horizon_frames": (1, 2),
    "max_features": (20, 1000),
    "min_inliers": (6, 1000),
    "inlier_radius_px": (0.0, 1000.0),
    "min_inlier_ratio": (0.0, 1.0),
    "max_validation_rmse_px": (0.0, 1000.0),
    "max_shift_px": (0.0, 1000.0),
    "min_axis_coverage": (0.0, 1.0),
    "min_overlap": (0.0, 1.0),
}
OPEN_LOWER = {
    "gate_distance_px", "inlier_radius_px", "min_inlier_ratio", "max_validation_rmse_px", "max_shift_px", "min_axis_coverage", "min_overlap",
}
WHOLE_NUMBERS = {
    "min_area_px", "max_area_px", "max_candidates", "confirmation_observations", "max_consecutive_misses", "prediction_horizon_frames",
    "max_features", "min_inliers",
}
ARCHIVE_LIMITS = {"member_bytes": 64 * 1024 * 1024, "total_bytes": 16 * 1024**3, "ratio": 1000.0, "entries": 100_000}


@dataclass(frozen=True)
class Checked:
    """Rows that pass every rule, and one row per broken rule."""

    valid: DataFrame
    violations: DataFrame


def apply_rules(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> Checked:
    """Row rules: True means fine, NULL counts as broken. No shuffle."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(n)) for n, ok in rules.items()]))
    tagged = df.withColumn("_broken", broken)
    return Checked(
        tagged.where(F.size("_broken") == 0).drop("_broken"),
        tagged.select(*keys, F.explode("_broken").alias("rule")),
    )


def repeated(df: DataFrame, keys: list[str], rule: str, report: list[str]) -> DataFrame:
    """Violations for keys that occur more than once; counts combine before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*report, F.lit(rule).alias("rule"))


def merge(checked: Checked, extra: list[DataFrame], keys: list[str]) -> Checked:
    """Add key-level violations and take their rows out of the valid side."""
    violations, valid = checked.violations, checked.valid
    for e in extra:
        violations = violations.unionByName(e.select(*keys, "rule"))
        valid = valid.join(e.select(*keys).distinct(), keys, "left_anti")
    return Checked(valid, violations)


def inside_box(x: str, y: str, box: str) -> Column:
    b = lambda n: F.col(f"{box}.{n}")
    return (F.col(x) >= b("x0")) & (F.col(x) < b("x1")) & (F.col(y) >= b("y0")) & (F.col(y) < b("y1"))


def both_or_none(a: str, b: str) -> Column:
    return F.col(a).isNull() == F.col(b).isNull()


def check_detections(detections: DataFrame, frame_count: int | Column, x: str = "x_raw_px", y: str = "y_raw_px", box: str = "box") -> Checked:
    """Centroid in box, reference pair, quality, finite, frame range, unique id."""
    n = F.lit(frame_count) if isinstance(frame_count, int) else frame_count
    rules = {
        "id_pattern": F.col("detection_id").rlike(ID_PATTERN),
        "finite_coordinates": finite(x) & finite(y),
        "centroid_in_box": inside_box(x, y, box),
        "box_not_negative": (F.col(f"{box}.x0") >= 0) & (F.col(f"{box}.y0") >= 0),
        "quality_range": F.col("quality_score").between(0.0, 1.0),
        "kind_known": F.col("kind").isin("compact", "streak", "unknown"),
        "frame_in_range": (F.col("frame_index") >= 0) & (F.col("frame_index") < n),
    }
    if "x_reference_px" in detections.columns:
        rules["reference_pair"] = both_or_none("x_reference_px", "y_reference_px")
    keys = ["sequence_id", "detection_id"]
    return merge(apply_rules(detections, rules, keys), [repeated(detections, keys, "unique_id", keys)], keys)


def check_track_points(points: DataFrame) -> Checked:
    """Only observed points name a detection; raw coordinates come in pairs."""
    rules = {
        "point_type_known": F.col("point_type").isin("observed", "interpolated", "extrapolated"),
        "observed_has_detection": (F.col("point_type") == "observed") == F.col("detection_id").isNotNull(),
        "raw_pair": both_or_none("x_raw_px", "y_raw_px"),
        "finite_reference": finite("x_reference_px") & finite("y_reference_px"),
    }
    return apply_rules(points, rules, ["sequence_id", "track_id", "frame_index"])


def check_trajectories(fits: DataFrame, tracks: DataFrame, predictions: DataFrame | None = None) -> Checked:
    """Unit agrees with time basis, n >= 3 and n <= the track's observed_count,
    predictions are extrapolated only."""
    keys = ["sequence_id", "track_id"]
    j = fits.join(tracks.select(*keys, F.col("observed_count").alias("_seen")), keys, "left")
    rules = {
        "unit_matches_basis": F.col("speed_unit") == F.when(F.col("time_basis") == "frame", "px/frame").otherwise("px/s"),
        "at_least_three": F.col("observations_used") >= 3,
        "not_more_than_track": F.col("observations_used") <= F.col("_seen"),
        "finite_velocity": finite("vx") & finite("vy"),
    }
    checked = apply_rules(j, rules, keys)
    checked = Checked(checked.valid.drop("_seen"), checked.violations)
    if predictions is None:
        return checked
    wrong = predictions.where("point_type <> 'extrapolated'").select(*keys, F.lit("prediction_not_extrapolated").alias("rule")).distinct()
    return merge(checked, [wrong], keys)


def check_tracks(tracks: DataFrame, points: DataFrame) -> Checked:
    """observed_count counts observations; frames ordered and unique; confirmed needs 3."""
    keys = ["sequence_id", "track_id"]
    p = points.groupBy(*keys, "frame_index").agg(F.count("*").alias("_c"), F.count_if(F.col("point_type") == "observed").alias("_o"))
    p = p.groupBy(*keys).agg(F.sum("_o").alias("_observed"), F.max("_c").alias("_most"))
    j = tracks.join(p, keys, "left")
    rules = {
        "status_known": F.col("status").isin("tentative", "confirmed", "ended"),
        "observed_count": F.col("observed_count") == F.coalesce("_observed", F.lit(0)),
        "frames_unique": F.coalesce("_most", F.lit(1)) == 1,
        "confirmed_needs_three": (F.col("status") != "confirmed") | (F.col("observed_count") >= 3),
        "quality_range": F.col("quality_score").between(0.0, 1.0),
    }
    checked = apply_rules(j, rules, keys)
    return Checked(checked.valid.drop("_observed", "_most"), checked.violations)


def frames_out_of_order(points: DataFrame, position: str = "position") -> DataFrame:
    """Tracks whose stored point order is not strictly increasing by frame."""
    keys = ["sequence_id", "track_id"]
    w = W.partitionBy(*keys).orderBy(position)
    return (
        points.select(*keys, (F.col("frame_index") <= F.lag("frame_index").over(w)).alias("_back")).where("_back")
        .select(*keys, F.lit("frames_ordered").alias("rule")).distinct()
    )


def check_references(detections: DataFrame, tracks: DataFrame, points: DataFrame, time_basis: str = "frame", fits: DataFrame | None = None) -> DataFrame:
    """Referential rules of a whole result, as violations (sequence_id, ref, rule)."""
    seq = ["sequence_id"]
    out = lambda df, ref, rule: df.select(*seq, F.col(ref).alias("ref"), F.lit(rule).alias("rule"))
    observed = points.where("point_type = 'observed'")
    dup = lambda df, c: df.groupBy(*seq, c).agg(F.count("*").alias("n")).where("n > 1")
    orphan = observed.join(detections.select(*seq, "detection_id", "frame_index"), [*seq, "detection_id", "frame_index"], "left_anti")
    stamped = F.col("timestamp_s").isNotNull()
    off = points.where(stamped != F.lit(time_basis == "second"))
    parts = [
        out(dup(detections, "detection_id"), "detection_id", "detection_id_unique"),
        out(dup(tracks, "track_id"), "track_id", "track_id_unique"),
        out(orphan, "detection_id", "observed_point_references_detection"),
        out(dup(observed, "detection_id"), "detection_id", "detection_supports_one_point"),
        out(off, "track_id", "timestamp_agrees_with_basis"),
    ]
    if fits is not None:
        parts.append(out(fits.where(F.col("time_basis") != time_basis), "track_id", "trajectory_basis"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result.distinct()


def check_sequences(frames: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """Sequence rules as violations (sequence_id, rule).

    frames(sequence_id, frame_index, image_ref, width_px, height_px, timestamp_s) in
    stored order `position` when that column exists.
    """
    position = "position" if "position" in frames.columns else "frame_index"
    w = W.partitionBy("sequence_id").orderBy(position)
    step = frames.withColumns(
        {
            "_jump": F.col("frame_index") - F.coalesce(F.lag("frame_index").over(w), F.lit(-1)),
            "_gain": F.col("timestamp_s") - F.lag("timestamp_s").over(w),
        }
    )
    s = step.groupBy("sequence_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("_jump") == 1).alias("steady"),
        F.count_distinct("width_px", "height_px").alias("sizes"), F.count_distinct("image_ref").alias("refs"), F.count("timestamp_s").alias("timed"),
        F.bool_or(F.col("_gain") <= 0).alias("backward"), F.max(F.col("width_px").cast("long") * F.col("height_px")).alias("pixels"),
    )
    rules = {
        "id_pattern": F.col("sequence_id").rlike(ID_PATTERN),
        "frame_count": F.col("n").between(MIN_FRAMES, MAX_FRAMES),
        "contiguous_frames": F.col("steady"),
        "equal_dimensions": F.col("sizes") == 1,
        "unique_image_refs": F.col("refs") == F.col("n"),
        "timestamps_all_or_none": F.col("timed").isin(0) | (F.col("timed") == F.col("n")),
        "timestamps_increase": ~F.coalesce("backward", F.lit(False)),
        "pixel_limit": F.col("pixels") <= MAX_PIXELS,
    }
    v = apply_rules(s, rules, ["sequence_id"]).violations
    if sequences is not None:
        known = {
            "source_type": F.col("source_type").isin("synthetic", "real", "user_upload"),
            "profile": F.col("profile").isin("synthetic_static_stars", "ground_static_star_streaks", "spotgeo"),
        }
        v = v.unionByName(apply_rules(sequences, known, ["sequence_id"]).violations)
    return v


# What a hand-over says about itself.
PAYLOAD = {"schema_version": "0.1.0", "coordinate_system": "raw_top_left_xy_px_integer_centers", "score_type": "uncalibrated_heuristic", "tracking_performed": False}


def check_payload(
    detections: DataFrame, frames: DataFrame, x: str = "x_raw_px", y: str = "y_raw_px", box: str = "box",
    payload_frames: DataFrame | None = None, metadata: DataFrame | None = None, expected: dict = PAYLOAD,
) -> DataFrame:
    """Hand-over rules as violations (sequence_id, frame_index, ref, rule).

    Every detection lies in a declared frame and inside the native image, ids are
    unique per sequence, and no reference coordinates exist yet. payload_frames are the
    frames the payload lists, empty ones too: a declared frame that is not among them
    is named. metadata(sequence_id, …) must hold the values of `expected`.
    """
    key = ["sequence_id", "frame_index"]
    j = detections.join(frames.select(*key, "width_px", "height_px"), key, "left")
    b = lambda n: F.col(f"{box}.{n}")
    rules = {
        "frame_declared": F.col("width_px").isNotNull(),
        "inside_image": F.col("width_px").isNull()
        | ((b("x0") >= 0) & (b("x1") <= F.col("width_px")) & (b("y0") >= 0) & (b("y1") <= F.col("height_px")) & inside_box(x, y, box)),
    }
    if "x_reference_px" in detections.columns:
        rules["not_registered"] = F.col("x_reference_px").isNull() & F.col("y_reference_px").isNull()
    v = apply_rules(j, rules, [*key, "detection_id"]).violations
    copies = detections.groupBy("sequence_id", "detection_id").agg(F.count("*").alias("n"), F.min("frame_index").alias("frame_index")).where("n > 1")
    v = v.unionByName(copies.select(*key, "detection_id", F.lit("unique_id").alias("rule")))
    none = F.lit(None).cast("string").alias("detection_id")
    if payload_frames is not None:
        lost = frames.select(*key).join(payload_frames.select(*key), key, "left_anti")
        v = v.unionByName(lost.select(*key, none, F.lit("frame_missing").alias("rule")))
    if metadata is not None:
        wrong = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lit(value)), F.lit(c)) for c, value in expected.items()]))
        bad = metadata.select("sequence_id", F.explode(wrong).alias("rule"))
        v = v.unionByName(bad.select("sequence_id", F.lit(None).cast(v.schema["frame_index"].dataType).alias("frame_index"), none, "rule"))
    return v.withColumnRenamed("detection_id", "ref")


def check_point_labels(records: DataFrame, width: int = 640, height: int = 480, complete: bool = True) -> DataFrame:
    """Violations (sequence_id, frame, rule) of point label records.

    records(sequence_id, frame, num_objects, object_coords array<array<double>>).
    """
    c = F.col("object_coords")
    pair = F.forall(c, lambda p: p.isNotNull() & (F.size(p) == 2))
    fin = F.forall(c, lambda p: F.forall(p, lambda q: finite(q)))
    at = lambda p, i: F.get(p, F.lit(i))
    within = F.forall(c, lambda p: at(p, 0).between(-0.5, width - 0.5) & at(p, 1).between(-0.5, height - 0.5))
    rules = {
        "frame_range": F.col("frame").between(1, 5),
        "object_count_range": F.col("num_objects").between(0, 30),
        "object_count_matches": F.col("num_objects") == F.size(c),
        "coordinate_pairs": pair,
        "finite_coordinates": fin,
        "inside_image": within,
    }
    keys = ["sequence_id", "frame"]
    v = apply_rules(records, rules, keys).violations.unionByName(repeated(records, keys, "unique_frame", keys))
    if not complete:
        return v
    s = records.groupBy("sequence_id").agg(F.count_distinct("frame").alias("n"), F.count_distinct("num_objects").alias("counts"))
    whole = {"five_frames": F.col("n") == 5, "constant_count": F.col("counts") == 1}
    return v.unionByName(apply_rules(s.withColumn("frame", F.lit(None).cast("int")), whole, keys).violations)


def check_boxes(boxes: DataFrame, tolerance: float = 1e-7, keys: list[str] = ["split", "image", "line"]) -> Checked:
    """Normalised class-0 boxes; a box past the image edge by more than `tolerance` is broken."""
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    rules = {
        "class_zero": F.col("class") == 0,
        "finite": finite("cx") & finite("cy") & finite("w") & finite("h"),
        "centre_in_unit": cx.between(0, 1) & cy.between(0, 1),
        "size_in_unit": (w > 0) & (w <= 1) & (h > 0) & (h <= 1),
        "inside_image": ~box_extends_outside(tolerance),
    }
    return apply_rules(boxes, rules, keys)


def box_extends_outside(tolerance: float = 1e-6) -> Column:
    """Inventory form: counted, not refused."""
    low = F.least(F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2)
    high = F.greatest(F.col("cx") + F.col("w") / 2, F.col("cy") + F.col("h") / 2)
    return (low < -tolerance) | (high > 1 + tolerance)


def check_manifest_entries(entries: DataFrame, limits: dict = ARCHIVE_LIMITS) -> DataFrame:
    """Violations (archive, name, rule) of archive member names and sizes.

    The total and the entry count are checked per archive by one sum each (name is
    NULL there): no running total over an archive in one task.
    """
    name = F.col("name")
    parts = F.split(F.regexp_replace(name, "/+$", ""), "/")
    reserved = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\.|$)"
    safe = (
        (F.length(name) > 0) & ~name.contains("\\") & ~name.startswith("/")
        & F.forall(
            parts,
            lambda p: (F.length(p) > 0) & ~p.isin(".", "..") & ~p.rlike("[. ]$") & ~p.rlike('[:<>"|?*\\x00-\\x1f]') & ~p.rlike(reserved),
        )
    )
    rules = {
        "safe_name": safe,
        "member_size": F.col("size") <= limits["member_bytes"],
        "compression_ratio": F.col("size") / F.greatest(F.lit(1), F.col("compressed")) <= limits["ratio"],
    }
    keys = ["archive", "name"]
    v = apply_rules(entries, rules, keys).violations
    folded = entries.groupBy("archive", F.lower("name").alias("_n")).agg(F.count("*").alias("n"), F.max("name").alias("name")).where("n > 1")
    totals = entries.groupBy("archive").agg(F.sum("size").alias("total"), F.count("*").alias("n")).withColumn("name", F.lit(None).cast("string"))
    caps = {"total_size": F.col("total") <= limits["total_bytes"], "entry_count": F.col("n") <= limits["entries"]}
    return v.unionByName(folded.select(*keys, F.lit("case_folded_duplicate").alias("rule"))).unionByName(apply_rules(totals, caps, keys).violations)


def check_configs(settings: DataFrame, bounds: dict = BOUNDS) -> DataFrame:
    """Violations (config_id, param, rule) of settings(config_id, param, value)."""
    lo, hi = (F.create_map(*[x for k, b in bounds.items() for x in (F.lit(k), F.lit(float(b[i])))])[F.col("param")] for i in (0, 1))
    opened = F.col("param").isin(*OPEN_LOWER)
    rules = {
        "known_parameter": lo.isNotNull(),
        "finite": finite("value"),
        "within_bounds": lo.isNull() | ((F.col("value") >= lo) & (F.col("value") <= hi) & ~(opened & (F.col("value") == lo))),
        "whole_number": ~F.col("param").isin(*WHOLE_NUMBERS) | (F.col("value") == F.floor("value")),
    }
    v = apply_rules(settings, rules, ["config_id", "param"]).violations
    by = settings.groupBy("config_id").pivot("param", ["background_sigma", "denoise_sigma", "min_area_px", "max_area_px"]).agg(F.max("value"))
    cross = {
        "background_exceeds_denoise": F.coalesce(F.col("background_sigma") > F.col("denoise_sigma"), F.lit(True)),
        "area_range": F.coalesce(F.col("min_area_px") <= F.col("max_area_px"), F.lit(True)),
    }
    return v.unionByName(apply_rules(by.withColumn("param", F.lit(None).cast("string")), cross, ["config_id", "param"]).violations)


def irregular_cadence(frames: DataFrame) -> DataFrame:
    """Sequences whose frame gaps, rounded to 9 places, are not all equal."""
    w = W.partitionBy("sequence_id").orderBy("frame_index")
    gap = F.bround(F.col("timestamp_s") - F.lag("timestamp_s").over(w), 9)
    return (
        frames.where("timestamp_s is not null").select("sequence_id", gap.alias("gap")).groupBy("sequence_id")
        .agg(F.count_distinct("gap").alias("distinct_gaps")).where("distinct_gaps > 1")
    )


def check_input_limits(files: DataFrame) -> DataFrame:
    """Upload rules as violations (sequence_id, rule).

    files(sequence_id, name, media_type, size, width, height).
    """
    ext = F.lower(F.regexp_extract("name", "\\.([A-Za-z0-9]+)$", 1))
    agrees = ((F.col("media_type") == "image/png") & (ext == "png")) | ((F.col("media_type") == "image/jpeg") & ext.isin("jpg", "jpeg"))
    s = files.groupBy("sequence_id").agg(
        F.count("*").alias("n"), F.max("size").alias("largest"), F.sum("size").alias("total"), F.count_distinct("width", "height").alias("sizes"),
        F.bool_and(F.coalesce(agrees, F.lit(False))).alias("typed"),
    )
    rules = {
        "file_count": F.col("n").between(MIN_FRAMES, MAX_FRAMES), "file_size": F.col("largest") <= MAX_FILE_BYTES,
        "sequence_size": F.col("total") <= MAX_SEQUENCE_BYTES, "equal_dimensions": F.col("sizes") == 1, "extension_agrees": F.col("typed"),
    }
    return apply_rules(s, rules, ["sequence_id"]).violations


def check_coordinates_preserved(detections: DataFrame, points: DataFrame) -> DataFrame:
    """Violations (sequence_id, detection_id, rule): each detection appears in exactly
    one observed point with the same frame and raw coordinates, and none is invented."""
    key = ["sequence_id", "detection_id"]
    shape = lambda p: F.struct("frame_index", "x_raw_px", "y_raw_px").alias(p)
    d = detections.select(*key, shape("d"))
    o = points.where("point_type = 'observed'").groupBy(*key).agg(F.count("*").alias("uses"), F.first(F.struct("frame_index", "x_raw_px", "y_raw_px")).alias("o"))
    j = d.join(o, key, "full_outer")
    rule = (
        F.when(F.col("o").isNull(), "detection_lost").when(F.col("d").isNull(), "observation_invented")
        .when(F.col("uses") > 1, "detection_used_twice").when(~F.col("d").eqNullSafe(F.col("o")), "coordinates_changed")
    )
    return j.select(*key, rule.alias("rule")).where("rule is not null")


def sequence_outcome(sequences: DataFrame, invalid: DataFrame, suitability: DataFrame, registration: DataFrame) -> DataFrame:
    """One status per sequence, first failing stage wins.

    invalid(sequence_id, rule…), suitability(sequence_id, status, detail),
    registration(sequence_id, status, detail). Only 'succeeded' rows may carry results.
    """
    bad = invalid.groupBy("sequence_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("_rules"))
    s = suitability.select("sequence_id", F.col("status").alias("_suit"), F.col("detail").alias("_suit_detail"))
    g = registration.select("sequence_id", F.col("status").alias("_reg"), F.col("detail").alias("_reg_detail"))
    j = sequences.select("sequence_id").join(bad, "sequence_id", "left").join(s, "sequence_id", "left").join(g, "sequence_id", "left")
    status = (
        F.when(F.col("_rules").isNotNull(), "invalid_input").when(F.col("_suit") == "unsupported", "unsupported_observation")
        .when(F.col("_suit").isNull() | (F.col("_suit") == "uncertain"), "uncertain_observation")
        .when(F.col("_reg").isNull() | (F.col("_reg") == "failed"), "registration_failed").otherwise("succeeded")
    )
    detail = F.when(status == "invalid_input", F.col("_rules")).when(status.isin("unsupported_observation", "uncertain_observation"), F.col("_suit_detail")).when(
        status == "registration_failed", F.col("_reg_detail")
    )
    return j.select("sequence_id", status.alias("status"), detail.alias("detail"))


def succeeded_only(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Result rows of succeeded sequences; a rejected one is never an empty success."""
    return results.join(outcomes.where("status = 'succeeded'").select("sequence_id"), "sequence_id", "left_semi")
