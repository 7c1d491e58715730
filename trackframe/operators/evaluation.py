"""Detection, track and gap metrics with reasons for undefined values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackframe.functions.columns import f1_counts, f1_ratios, ratio, reason_map, snap_zero
from trackframe.functions.lineage import cut_lineage
from trackframe.functions.ranks import exact_percentiles
from trackframe.operators.matching import FRAME, ambiguous_truth, match_points, tag_matches

# The messages that explain an undefined metric.
NO_PREDICTIONS = "No predicted detections (TP + FP == 0)"
NO_TRUTH = "No ground truth targets (TP + FN == 0)"
NO_MATCHES = "No matched detections (TP == 0)"


def observed_only(pred: DataFrame) -> DataFrame:
    return pred.where("point_type = 'observed'") if "point_type" in pred.columns else pred


def visible_only(truth: DataFrame) -> DataFrame:
    return truth.where("visible") if "visible" in truth.columns else truth


def tag_visible(pred: DataFrame, truth: DataFrame, gate: float, keys: list[str] = FRAME, **options) -> DataFrame:
    """tp / fp / fn rows over observed predictions and visible truth."""
    return tag_matches(observed_only(pred), visible_only(truth), gate, keys=keys, **options)


def tally(pairs: DataFrame, pred: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn and error sums per `by` from matched pairs and the two whole sides.

    fp and fn are differences of counts, so unmatched rows are never looked up: one
    aggregate over a union, combined before its shuffle.
    """
    d = F.col("distance")
    zero, one = F.lit(0), F.lit(1)
    side = lambda df, p, t: df.select(*by, zero.alias("tp"), p.alias("p"), t.alias("t"), *[F.lit(None).cast("double").alias(c) for c in ("d", "dd")])
    rows = pairs.select(*by, one.alias("tp"), zero.alias("p"), zero.alias("t"), d.alias("d"), (d * d).alias("dd"))
    rows = rows.unionByName(side(pred, one, zero)).unionByName(side(truth, zero, one))
    sums = rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "p", "t")], F.sum("d").alias("distance_sum"), F.sum("dd").alias("squared_error"))
    return sums.select(
        *by, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), "distance_sum", "squared_error"
    )


def outcome_counts(pred: DataFrame, truth: DataFrame, gate: float, by: list[str], keys: list[str] = FRAME, **options) -> DataFrame:
    """Counts of matched and unmatched rows per `by` (columns of `keys`, or none)."""
    pred, truth = observed_only(pred), visible_only(truth)
    return tally(match_points(pred, truth, gate, keys=keys, **options).pairs, pred, truth, by)


def with_ratios(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and RMSE over counts; undefined ones NULL with a reason."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", f1_ratios("precision", "recall"))
        .withColumn("localization_rmse_px", F.when(tp > 0, snap_zero(F.sqrt(F.col("squared_error") / tp))))
        .withColumn("null_reasons", null_reasons())
        .drop("squared_error", "distance_sum")
    )


def null_reasons() -> Column:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return reason_map(
        [
            (tp + fp == 0, "precision", NO_PREDICTIONS),
            (tp + fn == 0, "recall", NO_TRUTH),
            (tp == 0, "localization_rmse_px", NO_MATCHES),
        ]
    )


def detection_metrics(pred: DataFrame, truth: DataFrame, gate: float = 5.0, by: list[str] = [], keys: list[str] = FRAME, **options) -> DataFrame:
    """Micro-aggregated detection metrics; by=[] gives one row for everything.

    The one-row form also answers on empty input (zero counts and three reasons).
    """
    return with_ratios(outcome_counts(pred, truth, gate, by, keys, **options))


def target_counts(truth: DataFrame, by: list[str] = ["sequence_id"]) -> DataFrame:
    """Visible truth points and distinct visible targets."""
    return truth.groupBy(*by).agg(
        F.count_if("visible").alias("ground_truth_points"),
        F.count_distinct(F.when(F.col("visible") & (F.col("target_id") != ""), F.col("target_id"))).alias("ground_truth_targets"),
    )


def matched_points(points: DataFrame, truth: DataFrame, gate: float = 5.0, keys: list[str] = FRAME, **options) -> DataFrame:
    """Observed track points paired with visible truth, with track and target ids."""
    obs = observed_only(points).withColumns({"x": F.col("x_reference_px"), "y": F.col("y_reference_px")})
    seen = visible_only(truth)
    pairs = match_points(obs, seen, gate, keys=keys, **options).pairs
    return pairs.join(obs.select(*keys, "detection_id", "track_id"), [*keys, "detection_id"]).join(
        seen.select(*keys, "truth_id", "target_id"), [*keys, "truth_id"]
    )


def id_switches(matched: DataFrame, by: list[str] = ["sequence_id"]) -> DataFrame:
    """Consecutive matched observations of one target that name different tracks."""
    w = W.partitionBy(*by, "target_id").orderBy("frame_index", "detection_id")
    flips = matched.where("target_id is not null and target_id <> ''").select(
        *by, "target_id", (F.lag("track_id").over(w) != F.col("track_id")).alias("flip")
    )
    return flips.groupBy(*by).agg(F.count_if(F.col("flip")).alias("id_switches"))


def track_metrics(
    points: DataFrame, tracks: DataFrame, truth: DataFrame, gate: float = 5.0, by: list[str] = ["sequence_id"],
    keys: list[str] = FRAME, **options,
) -> DataFrame:
    """Identity metrics per `by`: switches, coverage, false confirmed tracks, totals."""
    matched = matched_points(points, truth, gate, keys, **options)
    counts = with_ratios(tally(matched, observed_only(points), visible_only(truth), by))
    hit = matched.select(*by, "track_id").distinct().withColumn("hit", F.lit(True))
    per_track = tracks.join(hit, [*by, "track_id"], "left").groupBy(*by).agg(
        F.count_if((F.col("status") == "confirmed") & F.col("hit").isNull()).alias("false_confirmed_tracks"),
        F.count("*").alias("total_tracks"), F.count_if(F.col("status") == "confirmed").alias("confirmed_tracks"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    whole = counts.join(id_switches(matched, by), by, "left").join(per_track, by, "full_outer")
    return whole.select(
        *by, zero("tp"), zero("fp"), zero("fn"), "precision", "recall", "localization_rmse_px", zero("id_switches"),
        ratio(F.coalesce("tp", F.lit(0)), F.coalesce(F.col("tp") + F.col("fn"), F.lit(0))).alias("coverage"),
        zero("false_confirmed_tracks"), zero("total_tracks"), zero("confirmed_tracks"),
    )


def frame_outcomes(pred: DataFrame, truth: DataFrame, frames: DataFrame, gate: float = 5.0, keys: list[str] = FRAME, **options) -> DataFrame:
    """Per declared frame: tp, fp, fn (zero when empty), summed and squared distance."""
    return frames.join(outcome_counts(pred, truth, gate, keys, keys, **options), keys, "left").na.fill(0, ["tp", "fp", "fn"])


def frame_summary(per_frame: DataFrame, by: list[str] = [], ms: str | None = "processing_ms") -> DataFrame:
    """Counts first, then ratios, F1, localisation, fp per frame and timing.

    Timing percentiles are exact and use no single-task sort. The rows per frame are written
    down once, for both.
    """
    per_frame = cut_lineage(per_frame) if ms else per_frame
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    aggs = [F.count("*").alias("frame_count"), *[F.sum(k).alias(k) for k in ("tp", "fp", "fn")]]
    aggs += [F.sum("distance_sum").alias("distance_sum"), F.sum("squared_error").alias("squared_error")]
    if ms:
        aggs += [F.sum(ms).alias("processing_ms_total"), F.avg(ms).alias("processing_ms_mean_per_frame")]
    s = per_frame.groupBy(*by).agg(*aggs).na.fill(0, ["tp", "fp", "fn"])
    s = (
        s.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", f1_counts(tp, fp, fn))
        .withColumn("localization_mean_px", F.when(tp > 0, F.col("distance_sum") / tp))
        .withColumn("localization_rmse_px", F.when(tp > 0, F.sqrt(F.col("squared_error") / tp)))
        .withColumn("false_positives_per_frame", ratio(fp, F.col("frame_count")))
        .withColumn(
            "null_reasons",
            reason_map(
                [
                    (tp + fp == 0, "precision", "zero denominator"), (tp + fn == 0, "recall", "zero denominator"),
                    (2 * tp + fp + fn == 0, "f1", "zero denominator"), (tp == 0, "localization", "no matched predictions"),
                ]
            ),
        )
        .drop("distance_sum", "squared_error")
    )
    if not ms:
        return s
    p95 = exact_percentiles(per_frame, ms, [0.95], by).withColumnRenamed("value", "processing_ms_p95_per_frame").drop("p")
    if by:
        return s.join(p95, by, "left")
    return s.withColumn("processing_ms_p95_per_frame", p95.select("processing_ms_p95_per_frame").scalar())


def empty_frame_summary(per_frame: DataFrame, by: list[str] = [], ms: str | None = "processing_ms") -> DataFrame:
    """The same summary over frames without any truth."""
    return frame_summary(per_frame.where("tp + fn = 0"), by, ms)


def ablation_report(
    detections: DataFrame, points: DataFrame, tracks: DataFrame, truth: DataFrame, frame_counts: DataFrame, gate: float = 5.0,
    min_observations: int = 3, **options,
) -> DataFrame:
    """Detector-only against tracking-assisted metrics, one row per sequence.

    Deltas stay NULL where either side is undefined.
    """
    from trackframe.operators.tracking import accepted_observations, confirmed_in_lifecycle

    by = ["sequence_id"]
    key = ["sequence_id", "track_id"]
    seen = visible_only(truth)
    a = with_ratios(outcome_counts(detections, seen, gate, by, **options))
    accepted = accepted_observations(points, tracks, key, min_observations).withColumns(
        {"x": F.col("x_reference_px"), "y": F.col("y_reference_px")}
    )
    b = with_ratios(outcome_counts(accepted, seen, gate, by, **options))
    t = track_metrics(points, tracks, seen, gate, **options)
    kept = confirmed_in_lifecycle(tracks, min_observations).groupBy(*by).agg(F.count("*").alias("confirmed_in_lifecycle"))
    status = tracks.groupBy(*by).agg(
        F.count_if(F.col("status") == "tentative").alias("tentative"), F.count_if(F.col("status") == "ended").alias("ended")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))

    def side(df, p):
        return df.select(
            *by, *[F.col(c).alias(f"{p}_{c}") for c in ("tp", "fp", "fn", "precision", "recall", "f1", "localization_rmse_px")]
        )

    j = frame_counts.join(side(a, "detector"), by, "left").join(side(b, "tracking"), by, "left")
    j = j.join(t.select(*by, "id_switches", "coverage", "false_confirmed_tracks", "total_tracks", "confirmed_tracks"), by, "left")
    j = j.join(kept, by, "left").join(status, by, "left")
    delta = lambda c: (F.col(f"tracking_{c}") - F.col(f"detector_{c}")).alias(f"{c}_delta")
    return j.select(
        *by, "frame_count",
        *[zero(f"{p}_{c}").alias(f"{p}_{c}") for p in ("detector", "tracking") for c in ("tp", "fp", "fn")],
        *[F.col(f"{p}_{c}") for p in ("detector", "tracking") for c in ("precision", "recall", "f1", "localization_rmse_px")],
        delta("precision"), delta("recall"), delta("f1"), delta("localization_rmse_px"),
        (zero("detector_fp") - zero("tracking_fp")).alias("fp_reduction"),
        (zero("tracking_fp") / F.col("frame_count")).alias("false_positives_per_frame"),
        *[zero(c).alias(c) for c in ("id_switches", "false_confirmed_tracks", "total_tracks", "confirmed_tracks", "confirmed_in_lifecycle", "tentative", "ended")],
        F.col("coverage").alias("target_coverage"),
    )


def identity_matches(points: DataFrame, detections: DataFrame, truth: DataFrame, gate: float, radius: float, **options):
    """(labelled observations, ambiguous truth keys) for the association diagnostics.

    Each observed point with the target its detection matched, and whether that truth
    is ambiguous (another visible truth within `radius`).
    """
    seen = visible_only(truth)
    pairs = match_points(detections, seen, gate, **options).pairs
    named = pairs.join(seen.select(*FRAME, "truth_id", "target_id"), [*FRAME, "truth_id"])
    vague = ambiguous_truth(seen, radius).select(*FRAME, "target_id").distinct()
    named = named.join(vague.withColumn("ambiguous", F.lit(True)), [*FRAME, "target_id"], "left").select(
        "sequence_id", "detection_id", "target_id", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous")
    )
    obs = observed_only(points).select("sequence_id", "track_id", "frame_index", "detection_id")
    return obs.join(named, ["sequence_id", "detection_id"], "left"), vague


def association_diagnostics(
    points: DataFrame, tracks: DataFrame, detections: DataFrame, truth: DataFrame, gate: float = 5.0, radius: float = 1.0, **options
) -> DataFrame:
    """Identity continuity per sequence over matches that are not ambiguous.

    Here a track is falsely confirmed when it has >= 3 observations but fewer than
    three of any one target; `track_metrics` keeps the other definition.
    """
    seq = ["sequence_id"]
    labelled, vague = identity_matches(points, detections, truth, gate, radius, **options)
    clear = labelled.where("target_id is not null and not ambiguous")
    along_track = W.partitionBy(*seq, "track_id").orderBy("frame_index", "target_id")
    along_target = W.partitionBy(*seq, "target_id").orderBy("frame_index", "track_id")
    links = clear.select(
        *seq, (F.lag("target_id").over(along_track) == F.col("target_id")).alias("same"),
    ).groupBy(*seq).agg(
        F.count_if(F.col("same")).alias("correct_links"), F.count_if(~F.col("same")).alias("incorrect_links")
    )
    switches = clear.select(*seq, (F.lag("track_id").over(along_target) != F.col("track_id")).alias("flip")).groupBy(*seq).agg(
        F.count_if("flip").alias("identity_switches")
    )
    pieces = clear.groupBy(*seq, "target_id").agg(F.count_distinct("track_id").alias("n")).groupBy(*seq).agg(
        F.sum(F.col("n") - 1).alias("fragmentation")
    )
    support = clear.groupBy(*seq, "track_id", "target_id").agg(F.count("*").alias("n")).groupBy(*seq, "track_id").agg(F.max("n").alias("best"))
    doubt = labelled.groupBy(*seq, "track_id").agg(F.bool_or(F.coalesce("ambiguous", F.lit(False))).alias("doubt"))
    judged = (
        tracks.where("observed_count >= 3").join(support, [*seq, "track_id"], "left").join(doubt, [*seq, "track_id"], "left")
        .groupBy(*seq).agg(
            F.count_if(F.coalesce("doubt", F.lit(False))).alias("unscorable_confirmed"),
            F.count_if(~F.coalesce("doubt", F.lit(False)) & (F.coalesce("best", F.lit(0)) < 3)).alias("false_confirmed_tracks"),
        )
    )
    totals = tracks.groupBy(*seq).agg(F.count("*").alias("tracks"), F.count_if(F.col("status") == "confirmed").alias("confirmed_tracks"))
    excluded = vague.groupBy(*seq).agg(F.count("*").alias("ambiguous_excluded"))
    out = totals
    for part in (links, switches, pieces, judged, excluded):
        out = out.join(part, seq, "left")
    names = ["correct_links", "incorrect_links", "identity_switches", "fragmentation", "false_confirmed_tracks", "unscorable_confirmed", "ambiguous_excluded"]
    out = out.na.fill(0, names)
    return out.withColumn("correct_link_fraction", ratio("correct_links", F.col("correct_links") + F.col("incorrect_links")))


def gap_recovery(
    points: DataFrame, detections: DataFrame, truth: DataFrame, gate: float = 5.0, radius: float = 1.0, **options
) -> DataFrame:
    """Gaps of one or two scripted misses between visible rows of a target, per sequence.

    Recovered when both ends are matched to one track, failed when to two, unscorable
    when an end has no clear match. truth needs `visible` and `reason`.
    """
    key = ["sequence_id", "target_id"]
    labelled, _ = identity_matches(points, detections, truth, gate, radius, **options)
    owner = labelled.where("target_id is not null and not ambiguous").groupBy(*key, "frame_index").agg(F.max("track_id").alias("track_id"))
    shown = truth.where("visible").select(*key, "frame_index").distinct()
    ends = shown.withColumn("after", F.lead("frame_index").over(W.partitionBy(*key).orderBy("frame_index")))
    ends = ends.where("after - frame_index in (2, 3)").withColumnRenamed("frame_index", "before")
    hidden = truth.where("not visible").select(*key, "frame_index", "reason")
    inside = ends.withColumn("frame_index", F.explode(F.expr("sequence(before + 1, after - 1)"))).join(hidden, [*key, "frame_index"])
    gaps = inside.groupBy(*key, "before", "after").agg(F.bool_and(F.col("reason") == "simulated_miss").alias("scripted")).where("scripted")
    side = lambda end: owner.select(*key, F.col("frame_index").alias(end), F.col("track_id").alias(f"{end}_track"))
    judged = gaps.join(side("before"), [*key, "before"], "left").join(side("after"), [*key, "after"], "left")
    open_end = F.col("before_track").isNull() | F.col("after_track").isNull()
    return judged.groupBy("sequence_id").agg(
        F.count_if(~open_end & (F.col("before_track") == F.col("after_track"))).alias("recovered"),
        F.count_if(~open_end & (F.col("before_track") != F.col("after_track"))).alias("failed"),
        F.count_if(open_end).alias("unscorable"),
    )


def result_summary(detections: DataFrame, tracks: DataFrame, fits: DataFrame, frames: DataFrame) -> dict[str, DataFrame]:
    """Small result tables per sequence: frame counts with score quartiles, status
    counts, support histogram, number of fits."""
    scores = detections.groupBy(*FRAME).agg(
        F.count("*").alias("detections"),
        F.percentile("quality_score", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"),
    )
    per_frame = frames.select(*FRAME).join(scores, FRAME, "left").select(
        *FRAME, F.coalesce("detections", F.lit(0)).alias("detections"),
        *[F.col("q")[i].alias(n) for i, n in enumerate(("q_min", "q25", "q_median", "q75", "q_max"))],
    )
    seq = ["sequence_id"]
    status = tracks.groupBy(*seq).pivot("status", ["tentative", "confirmed", "ended"]).count().na.fill(0)
    fitted = fits.where("status = 'fitted'").groupBy(*seq).agg(F.count("*").alias("fits"))
    status = status.join(fitted, seq, "left").na.fill(0, ["fits"]).withColumn("tracks", F.col("tentative") + F.col("confirmed") + F.col("ended"))
    support = tracks.groupBy(*seq, "observed_count").agg(F.count("*").alias("tracks"))
    return {"per_frame": per_frame, "status": status, "support": support}


def box_metrics(pred: DataFrame, truth: DataFrame, images: DataFrame, iou_gate: float = 0.5, **options) -> tuple[DataFrame, DataFrame]:
    """(totals row, failing images) of fixed-confidence box matching.

    images(sequence_id, frame_index, inference_ms) lists every image, also empty ones; ids are
    unique inside an image. What is not matched follows from counts; rows per image are written once.
    """
    from trackframe.operators.matching import match_boxes

    m = match_boxes(pred, truth, iou_gate, **options)
    parts = [df.select(*FRAME, F.lit(n).alias("side")) for df, n in ((m.pairs, "tp"), (truth, "truths"), (pred, "predicted"))]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*FRAME).agg(*[F.count_if(F.col("side") == n).alias(n) for n in ("tp", "truths", "predicted")])
    per = images.join(counts, FRAME, "left").na.fill(0, ["tp", "truths", "predicted"])
    per = cut_lineage(per.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("truths") - F.col("tp")}))
    empty = F.col("truths") == 0
    totals = per.agg(
        F.count("*").alias("images"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        F.count_if(empty).alias("negative_images"), F.count_if(empty & (F.col("predicted") > 0)).alias("negative_images_with_fp"),
        F.coalesce(F.sum(F.when(empty, F.col("predicted"))), F.lit(0)).alias("negative_fp"), F.avg("inference_ms").alias("inference_ms_mean"),
    )
    p95 = exact_percentiles(per, "inference_ms", [0.95]).select("value").scalar()
    totals = totals.withColumn("inference_ms_p95", p95).select(
        "*", ratio("tp", F.col("tp") + F.col("fp")).alias("fixed_precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("fixed_recall"),
        ratio("negative_fp", "negative_images").alias("fp_per_negative"),
    )
    failures = per.where("fp > 0 or fn > 0").select(*FRAME, F.col("fp").alias("false_positives"), F.col("fn").alias("missed"))
    return totals, failures


def pr_points(trials: DataFrame) -> DataFrame:
    """(recall, precision) per trial, undefined ones left out."""
    return trials.where("precision is not null and recall is not null").select("trial", "recall", "precision")


def compare_modes(metrics_by_mode: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Micro-averaged metrics per mode over sequences that succeeded in every mode.

    metrics_by_mode: (mode, sequence_id, tp, fp, fn); outcomes: (mode, sequence_id,
    status). Failures are counted per mode beside the metrics, never as zeros in them.
    """
    modes = outcomes.select("mode").distinct().agg(F.count("*").alias("modes"))
    done = outcomes.where("status = 'succeeded'").groupBy("sequence_id").agg(F.count_distinct("mode").alias("n"))
    shared = done.join(F.broadcast(modes), F.col("n") == F.col("modes")).select("sequence_id")
    failures = outcomes.groupBy("mode").agg(F.count_if(F.col("status") != "succeeded").alias("failures"))
    sums = metrics_by_mode.join(shared, "sequence_id", "left_semi").groupBy("mode").agg(
        F.count_distinct("sequence_id").alias("shared_sequences"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return failures.join(sums, "mode", "left").select(
        "mode", "failures", "shared_sequences", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        f1_counts(tp, fp, fn).alias("f1"),
    )


def label_agreement(assigned: DataFrame, expected: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Confusion counts of expected against assigned status."""
    return assigned.join(expected, key).groupBy("expected", "actual").agg(F.count("*").alias("n"))


def track_report(points: DataFrame, tracks: DataFrame, fits: DataFrame, frames: DataFrame) -> DataFrame:
    """One evidence row per track: direction, band, support, gaps, linked detections."""
    from trackframe.operators import trajectory as r

    key = r.TRACK
    missing = r.missing_frames(points, frames).groupBy(*key).agg(F.array_sort(F.collect_list("frame_index")).alias("missing_frames"))
    linked = points.where("point_type = 'observed'").groupBy(*key).agg(F.count("detection_id").alias("linked_detections"))
    ok = r.supported_motion(points, tracks, fits).select(*key, "supported")
    return (
        tracks.join(r.displacement_direction(points), key, "left").join(ok, key, "left").join(missing, key, "left").join(linked, key, "left")
        .select(
            *key, "status", "observed_count", "quality_score", r.quality_band().alias("quality_band"), "dx_px", "dy_px", "direction",
            "supported", F.coalesce("missing_frames", F.array().cast("array<int>")).alias("missing_frames"),
            F.coalesce("linked_detections", F.lit(0)).alias("linked_detections"),
        )
    )
