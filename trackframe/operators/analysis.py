"""From detections to trajectories for whole collections of sequences at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.lineage import cut_lineage
from trackframe.functions.stepper import TrackerConfig
from trackframe.operators import geometry, rules, tracking, trajectory


def analyze(
    frames: DataFrame, detections: DataFrame, transforms: DataFrame, suitability: DataFrame, config: TrackerConfig = TrackerConfig(),
    time_basis: str = "frame", horizon: int = 2, **options,
) -> dict[str, DataFrame]:
    """Outcome per sequence, and tracks, points, fits and forecasts of those that succeed.

    Checks come first: an invalid, unsuitable or unregistered sequence gets its status
    and no results, never an empty success. Tracking and fits run in reference
    coordinates; suitability(sequence_id, status, detail).
    """
    invalid = rules.check_sequences(frames)
    registration = geometry.registration_status(transforms).select(
        "sequence_id", "status", F.array_join("failed_frames", ", ").alias("detail")
    )
    outcomes = rules.sequence_outcome(frames.select("sequence_id").distinct(), invalid, suitability, registration)
    good = rules.succeeded_only(detections, outcomes)
    declared = rules.succeeded_only(frames, outcomes)
    placed = geometry.to_reference(good, transforms)
    # Fits read the points five times and tracking must run once.
    steps = cut_lineage(tracking.track_sequences(placed, declared, (config,), "reference", **options))
    size = declared.select("sequence_id", "frame_index", "width_px", "height_px")
    points = tracking.points_of(steps).drop("out_of_field").join(size, ["sequence_id", "frame_index"])
    points = cut_lineage(points.withColumn("out_of_field", trajectory.out_of_field("x_reference_px", "y_reference_px", "width_px", "height_px")))
    fits = trajectory.fit_velocity(points, time_basis)
    ahead = trajectory.extrapolate(fits, horizon, declared if time_basis == "second" else None)
    return {
        "outcomes": outcomes, "tracks": tracking.tracks_of(steps), "points": points.drop("width_px", "height_px"), "fits": fits, "predictions": ahead,
    }
