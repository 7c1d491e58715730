"""Parameter sweeps and constrained selection in a single job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.functions.columns import all_of
from trackframe.functions.stepper import TrackerConfig
from trackframe.functions.groups import spread
from trackframe.functions.lineage import cut_lineage
from trackframe.operators import evaluation as ev
from trackframe.operators.matching import FRAME, frames_fit, gated_pairs, match_points
from trackframe.operators.pixels import aperture_features
from trackframe.operators.tracking import accepted_observations, fold_accepted, fold_configs, track_sequences, unfold_configs

# The nine tracker settings of the published sweep.
SWEEP = tuple(
    TrackerConfig(name, gate, confirm, misses, True)
    for name, gate, confirm, misses in (
        ("A_full_tracking_default", 20.0, 3, 2),
        ("B1_reduced_continuity_misses_0", 20.0, 3, 0),
        ("B2_reduced_continuity_misses_1", 20.0, 3, 1),
        ("C1_confirmation_threshold_3", 20.0, 3, 2),
        ("C2_confirmation_threshold_4", 20.0, 4, 2),
        ("C3_confirmation_threshold_5", 20.0, 5, 2),
        ("D1_association_gate_5px", 5.0, 3, 2),
        ("D2_association_gate_10px", 10.0, 3, 2),
        ("D3_association_gate_40px", 40.0, 3, 2),
    )
)


def with_configs(df: DataFrame, configs: DataFrame | Sequence[dict]) -> DataFrame:
    """Every row once per parameter row; the parameter list is literal and short."""
    if isinstance(configs, DataFrame):
        raise TypeError("pass the parameter grid as a list; it is part of the plan, not data")
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in configs])
    return df.withColumn("_c", F.explode(rows)).select(*df.columns, "_c.*")


def tracking_sweep(
    detections: DataFrame, frames: DataFrame, truth: DataFrame, configs: Sequence[TrackerConfig] = SWEEP, gate: float = 5.0,
    space: str = "raw", **options,
) -> DataFrame:
    """Tracking-assisted metrics for every configuration over all sequences.

    One pass steps all configurations over the same shuffled rows; the metrics carry
    config_id in every key, so they too run once for the whole grid. Every detection
    ends up in exactly one track whatever the configuration, so the identity metrics
    need the detections matched only once; only the accepted subsets are matched per
    configuration. What is stored and shuffled has one row per detection with its steps under
    all configurations, and pairs inside the gate are found once: those of an accepted
    observation are the ones of its detection.
    """
    key = ["config_id", *FRAME]
    by_seq = ["config_id", "sequence_id"]
    steps = cut_lineage(fold_configs(track_sequences(detections, frames, configs, space, **options), configs))
    limits = {c.config_id: c.confirmation_observations for c in configs}
    confirm = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("config_id")]
    observed = lambda folded: unfold_configs(folded, configs).withColumn("confirm", confirm)
    seen = ev.visible_only(truth)
    truths = with_configs(seen, [{"config_id": c.config_id} for c in configs])
    small = frames_fit(detections, seen)
    spots = detections.withColumns({"x": F.col(f"x_{space}_px"), "y": F.col(f"y_{space}_px")})
    near = cut_lineage(gated_pairs(spots, seen, gate).select(*FRAME, "left_id", "lx", "ly", "right_id", "distance"))
    ends = near.withColumnsRenamed({"left_id": "detection_id", "lx": "x", "ly": "y"})
    accept = lambda folded: accepted_observations(observed(folded), None, [*by_seq, "track_no"], "confirm")
    edges = accept(fold_accepted(steps, configs).join(ends.hint("merge"), [*FRAME, "detection_id", "x", "y"])).withColumnRenamed("detection_id", "left_id")
    counts = ev.with_ratios(ev.outcome_counts(accept(steps), truths, gate, ["config_id"], key, frames_are_small=small, edges=edges))
    pairs = match_points(spots, seen, gate, frames_are_small=small, edges=near).pairs
    named = pairs.join(seen.select(*FRAME, "truth_id", "target_id").hint("merge"), [*FRAME, "truth_id"]).select("sequence_id", "detection_id", "target_id")
    # Rows that repeat an id are taken in the order in which a join by hash gave them, whatever the join.
    matched = steps.withColumn("steps", F.reverse("steps")).join(named.hint("merge"), ["sequence_id", "detection_id"])
    matched = observed(spread(matched, ["sequence_id", "target_id"])).withColumnRenamed("track_no", "track_id")
    switches = ev.id_switches(matched, by_seq).groupBy("config_id").agg(F.sum("id_switches").alias("id_switches"))
    hits = matched.where("status = 'confirmed'").select(*by_seq, "track_id").distinct().groupBy("config_id").agg(F.count("*").alias("hits"))
    totals = observed(steps).where("first").groupBy("config_id").agg(F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count("*").alias("total_tracks"))
    totals = totals.join(hits, "config_id", "left").select(
        "config_id", (F.col("confirmed") - F.coalesce("hits", F.lit(0))).alias("false_confirmed_tracks"), "total_tracks"
    )
    out = counts.join(switches, "config_id", "left").join(totals, "config_id", "left")
    return out.na.fill(0, ["id_switches", "false_confirmed_tracks", "total_tracks"]).drop("null_reasons")


def gate_candidates(candidates: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """Candidates passing every score gate of every configuration row."""
    ok = all_of(
        [
            F.col("aperture_snr") >= F.col("min_aperture_snr"), F.col("peak_fraction") <= F.col("max_peak_fraction"),
            F.col("context_elongation") <= F.col("max_context_elongation"), F.col("component_aspect") <= F.col("max_component_aspect"),
            F.col("score") >= F.col("min_score"),
        ]
    )
    return with_configs(candidates, configs).where(ok).select("config_id", *candidates.columns)


def threshold_sweep(
    scored: DataFrame, truth: DataFrame, thresholds: Sequence[float], gate: float = 5.0, **options
) -> DataFrame:
    """Detection metrics at every score threshold; matching is redone per threshold."""
    key = ["threshold", *FRAME]
    cuts = [{"threshold": float(t)} for t in thresholds]
    options.setdefault("frames_are_small", frames_fit(scored, ev.visible_only(truth)))
    kept = with_configs(scored, cuts).where("score >= threshold")
    truths = with_configs(ev.visible_only(truth), cuts)
    return ev.with_ratios(ev.outcome_counts(kept, truths, gate, ["threshold"], key, **options)).drop("null_reasons")


def select_config(trials: DataFrame, recall_floor: float | Column = 0.0, order: str = "grid_ix") -> DataFrame:
    """Best F1 among trials that keep the recall floor; ties by precision, grid order.

    Empty when no trial qualifies: the caller must not fall back silently.
    """
    best = F.struct(
        F.coalesce("f1", F.lit(0.0)).alias("f1"), F.coalesce("precision", F.lit(0.0)).alias("precision"), (-F.col(order)).alias("ix")
    )
    row = F.struct(*[F.col(c) for c in trials.columns])
    return trials.where(F.col("recall") >= recall_floor).agg(F.max_by(row, best).alias("r")).where("r is not null").select("r.*")


def select_threshold(trials: DataFrame, keep_recall: float = 0.95) -> DataFrame:
    """Highest precision among thresholds keeping `keep_recall` of the threshold-0 recall."""
    base = trials.where("threshold = 0").select(F.coalesce("recall", F.lit(0.0))).scalar()
    row = F.struct(*[F.col(c) for c in trials.columns])
    best = F.struct(F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0)), -F.col("threshold"))
    return (
        trials.where("threshold > 0").where(F.coalesce(F.col("recall"), F.lit(0.0)) >= base * keep_recall)
        .agg(F.max_by(row, best).alias("r")).where("r is not null").select("r.*")
    )


def feature_quantiles(rows: DataFrame, features: Sequence[str], probabilities: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact percentiles of every feature per outcome category: (category, feature, p, value)."""
    from trackframe.functions.ranks import exact_percentiles

    long = rows.select(
        "category", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("s")
    ).select("category", "s.feature", F.col("s.v").alias("v"))
    return exact_percentiles(long, "v", probabilities, ["category", "feature"])


def outcome_features(found: DataFrame, missed: DataFrame, pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Aperture features of detections by category (tp, fp) and of missed truth points (fn).

    found(sequence_id, frame_index, candidate_id, category, x, y, box); missed(sequence_id,
    frame_index, candidate_id, x, y) are measured in a box one pixel around them, cut at
    the frame's edge. Labels only decide what is measured, never a detection.
    """
    wh = frames.select("sequence_id", "frame_index", "width_px", "height_px")
    edge = F.struct(
        F.greatest(F.lit(0.0), F.col("x") - 1).alias("x0"), F.greatest(F.lit(0.0), F.col("y") - 1).alias("y0"),
        F.least(F.col("width_px").cast("double"), F.col("x") + 2).alias("x1"), F.least(F.col("height_px").cast("double"), F.col("y") + 2).alias("y1"),
    )
    cols = [*FRAME, "candidate_id", "category", "x", "y", "box"]
    double_box = F.struct(*[F.col(f"box.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    lost = missed.join(wh, FRAME).withColumns({"box": edge, "category": F.lit("fn")}).select(*cols)
    every = cut_lineage(found.withColumn("box", double_box).select(*cols).unionByName(lost))
    return aperture_features(every, pixels).join(every.select(*FRAME, "candidate_id", "category"), [*FRAME, "candidate_id"])
