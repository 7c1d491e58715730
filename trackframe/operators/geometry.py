"""Coordinate spaces, frame transforms and registration tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackframe.functions.columns import dist, ratio, reason_array

FRAME = ["sequence_id", "frame_index"]

# The acceptance limits of a registered frame.
REGISTRATION = {
    "min_inliers": 12,
    "inlier_radius_px": 1.25,
    "min_inlier_ratio": 0.6,
    "max_validation_rmse_px": 0.8,
    "max_shift_px": 250.0,
    "min_axis_coverage": 0.2,
    "min_overlap": 0.45,
}


def to_reference(points: DataFrame, transforms: DataFrame, inverse: bool = False) -> DataFrame:
    """Map raw to reference coordinates, or back with inverse=True.

    A sequence with any failed frame is left out as a whole (`unregistered` lists it);
    there is no identity fallback. Points that already carry reference coordinates are
    refused by name, so nothing is registered twice. A plain equi join: Spark
    broadcasts the transforms only when their size allows it.
    """
    if not inverse and {"x_reference_px", "y_reference_px"} & set(points.columns):
        raise ValueError("points already carry reference coordinates")
    bad = transforms.where("status = 'failed' or tx is null or ty is null").select("sequence_id").distinct()
    t = transforms.join(bad, "sequence_id", "left_anti").select(*FRAME, "tx", "ty")
    joined = points.join(t, FRAME)
    if inverse:
        new = {"x_raw_px": F.col("x_reference_px") - F.col("tx"), "y_raw_px": F.col("y_reference_px") - F.col("ty")}
    else:
        new = {"x_reference_px": F.col("x_raw_px") + F.col("tx"), "y_reference_px": F.col("y_raw_px") + F.col("ty")}
    return joined.withColumns(new).drop("tx", "ty")


def registration_status(transforms: DataFrame) -> DataFrame:
    """One status per sequence: failed if any frame failed, else estimated."""
    return transforms.groupBy("sequence_id").agg(
        F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("estimated").alias("status"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "failed", F.col("frame_index")))).alias("failed_frames"),
    )


def anchor_frame(transforms: DataFrame) -> DataFrame:
    """For every frame the nearest earlier accepted frame and its shift, or NULL.

    Frame 0 is the reference itself and never an anchor.
    """
    w = W.partitionBy("sequence_id").orderBy("frame_index").rowsBetween(W.unboundedPreceding, -1)
    ok = (F.col("status") == "estimated") & (F.col("frame_index") > 0)
    mark = F.when(ok, F.struct(F.col("frame_index").alias("frame"), "tx", "ty"))
    return transforms.withColumn("anchor", F.last(mark, ignorenulls=True).over(w))


def compose_shift(anchored: DataFrame, pair_shifts: DataFrame, max_shift_px: float = 250.0) -> DataFrame:
    """Anchor shift plus the shift measured against the anchor.

    pair_shifts(sequence_id, frame_index, dx, dy). Rejected when too long.
    """
    j = anchored.where("anchor is not null").join(pair_shifts, FRAME)
    x, y = F.col("anchor.tx") + F.col("dx"), F.col("anchor.ty") + F.col("dy")
    s = j.select(*FRAME, F.col("anchor.frame").alias("anchor_frame"), x.alias("sx"), y.alias("sy"))
    fits = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2) <= max_shift_px
    return s.select(
        *FRAME, "anchor_frame", F.when(fits, F.col("sx")).alias("tx"), F.when(fits, F.col("sy")).alias("ty"),
        F.when(fits, "seeded").otherwise("shift_exceeds_limit").alias("status"),
    )


def apply_homography(points: DataFrame, x: str = "x", y: str = "y", matrix: str = "matrix") -> DataFrame:
    """Projective map by a 3x3 array column; NULL where |w| < 1e-10 or not finite."""
    m = lambda r, c: F.col(matrix)[r][c]
    row = lambda r: m(r, 0) * F.col(x) + m(r, 1) * F.col(y) + m(r, 2)
    w = row(2)
    ok = (F.abs(w) >= 1e-10) & ~F.isnan(w)
    return points.withColumns({"x_mapped": F.when(ok, row(0) / w), "y_mapped": F.when(ok, row(1) / w)})


def coordinate_choice(points: DataFrame, space: str = "prefer_reference") -> DataFrame:
    """Columns x, y taken from the space the caller names.

    'prefer_reference' takes reference coordinates when both are present, else raw;
    mixing spaces silently is a hazard, so matching code should name one.
    """
    if space in ("raw", "reference"):
        return points.withColumns({"x": F.col(f"x_{space}_px"), "y": F.col(f"y_{space}_px")})
    if space != "prefer_reference":
        raise ValueError("space must be 'raw', 'reference' or 'prefer_reference'")
    both = F.col("x_reference_px").isNotNull() & F.col("y_reference_px").isNotNull()
    pick = lambda a: F.when(both, F.col(f"{a}_reference_px")).otherwise(F.col(f"{a}_raw_px"))
    return points.withColumns({"x": pick("x"), "y": pick("y")})


def transform_error(transforms: DataFrame, truth_shifts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-frame distance between the estimate and the authored camera shift (dx, dy),
    and max / RMSE per sequence. A perfect estimate is the negative camera shift."""
    per = transforms.where("status <> 'failed'").join(truth_shifts, FRAME).select(
        *FRAME, F.sqrt((F.col("tx") + F.col("dx")) ** 2 + (F.col("ty") + F.col("dy")) ** 2).alias("shift_error_px")
    )
    return per, per.groupBy("sequence_id").agg(
        F.max("shift_error_px").alias("max_shift_error_px"), F.sqrt(F.avg(F.col("shift_error_px") ** 2)).alias("shift_rmse_px")
    )


def orient_point(x, y, width, height, orientation) -> tuple[Column, Column]:
    """Raw pixel position in an image shown with one of the 8 orientations."""
    x, y, o = (F.col(c) if isinstance(c, str) else c for c in (x, y, orientation))
    w = (F.col(width) if isinstance(width, str) else width) - 1
    h = (F.col(height) if isinstance(height, str) else height) - 1
    new_x = F.when(o.isin(2, 3), w - x).when(o.isin(5, 8), y).when(o.isin(6, 7), h - y).otherwise(x)
    new_y = F.when(o.isin(3, 4), h - y).when(o.isin(5, 6), x).when(o.isin(7, 8), w - x).otherwise(y)
    return new_x, new_y


def translation_consensus(correspondences: DataFrame, radius: float = 1.25) -> tuple[DataFrame, DataFrame]:
    """(tx, ty) of every frame with an inlier flag per correspondence, and frames that cannot be fitted.

    Each correspondence proposes the shift ref - raw. Most support within `radius`
    wins, then the smallest median residual, then feature order; three rounds of
    median refinement follow. Equal shifts of a frame are counted first; proposals meet
    shifts on grid cells of one radius, and residuals are looked at for tied proposals
    only. Any number of correspondences is fitted. A frame with a missing or infinite
    coordinate comes out in the second table with its error.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    coordinates = [F.col(c).cast("double") for c in ("ref_x", "ref_y", "raw_x", "raw_y")]
    broken = reduce(lambda a, c: a | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), coordinates, F.lit(False))
    refused = correspondences.where(broken).select(*FRAME).distinct().withColumn("error", F.lit("invalid_correspondences"))
    rows = correspondences.join(refused, FRAME, "left_anti").select(
        "sequence_id", F.col("frame_index").cast("int").alias("frame_index"), F.col("feature_ix").cast("long").alias("feature_ix"),
        (F.col("ref_x") - F.col("raw_x")).alias("sx"), (F.col("ref_y") - F.col("raw_y")).alias("sy"),
    )
    shifts = rows.groupBy(*FRAME, "sx", "sy").agg(F.count("*").alias("n"), F.min("feature_ix").alias("first_ix"))
    residual = dist("px", "py", "sx", "sy")
    near = _meetings(shifts.select(*FRAME, F.col("sx").alias("px"), F.col("sy").alias("py"), "first_ix"), shifts, radius).where(residual <= radius)
    support = near.groupBy(*FRAME, "px", "py", "first_ix").agg(F.sum("n").alias("support"))
    tied = support.withColumn("most", F.max("support").over(W.partitionBy(*FRAME))).where("support = most").drop("support", "most")
    middle = F.expr("percentile(residual, 0.5, n)")
    spread = _meetings(tied, shifts, radius).withColumn("residual", residual).where(F.col("residual") <= radius).groupBy(*FRAME, "px", "py", "first_ix").agg(middle.alias("spread"))
    shift = spread.groupBy(*FRAME).agg(F.min(F.struct("spread", "first_ix", "px", "py")).alias("best")).select(*FRAME, F.col("best.px").alias("tx"), F.col("best.py").alias("ty"))
    for _ in range(3):
        kept = shifts.join(shift, FRAME).where(dist("sx", "sy", "tx", "ty") <= radius)
        shift = kept.groupBy(*FRAME).agg(F.expr("percentile(sx, 0.5, n)").alias("tx"), F.expr("percentile(sy, 0.5, n)").alias("ty"))
    fitted = rows.join(shift, FRAME).withColumn("inlier", dist("sx", "sy", "tx", "ty") <= radius)
    return fitted.select(*FRAME, "feature_ix", "tx", "ty", "inlier"), refused


def _meetings(proposals: DataFrame, shifts: DataFrame, radius: float) -> DataFrame:
    """Proposals (px, py) beside the shifts of their frame in the same or a neighbouring cell."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.struct((cell("px") + i).alias("cx"), (cell("py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = proposals.withColumn("cell", F.explode(around)).withColumns({"cx": F.col("cell.cx"), "cy": F.col("cell.cy")}).drop("cell")
    return left.join(shifts.select(*FRAME, "sx", "sy", "n", cell("sx").alias("cx"), cell("sy").alias("cy")), [*FRAME, "cx", "cy"]).drop("cx", "cy")


def registration_gates(
    correspondences: DataFrame, frames: DataFrame, limits: dict = REGISTRATION, min_validation: int = 4
) -> DataFrame:
    """Acceptance of a frame's translation: one diagnostic row per frame.

    Every fifth original feature is reserved and never enters the fit. Reasons are
    listed in order (broken coordinates are a reason of their own); a frame without reasons is 'estimated', else 'failed' with a NULL
    transform. frames(sequence_id, frame_index, width_px, height_px).
    """
    c = correspondences.withColumn("reserved", F.pmod(F.col("feature_ix"), F.lit(5)) == 0)
    counts = c.groupBy(*FRAME).agg(
        F.count("*").alias("matched_features"), F.count_if("reserved").alias("validation_matches"), F.count_if(~F.col("reserved")).alias("fit_matches")
    )
    enough = (F.col("fit_matches") >= limits["min_inliers"]) & (F.col("validation_matches") >= min_validation)
    fitted, refused = translation_consensus(c.where("not reserved").join(counts.where(enough).select(*FRAME), FRAME, "left_semi"), limits["inlier_radius_px"])
    shift = fitted.groupBy(*FRAME).agg(F.first("tx").alias("tx"), F.first("ty").alias("ty"))
    residual = dist(F.col("raw_x") + F.col("tx"), F.col("raw_y") + F.col("ty"), "ref_x", "ref_y")
    r = c.join(shift, FRAME).withColumn("residual", residual).withColumn("inlier", F.col("residual") <= limits["inlier_radius_px"])
    fit, val = F.col("inlier") & ~F.col("reserved"), F.col("inlier") & F.col("reserved")
    rms = lambda cond: F.sqrt(F.avg(F.when(cond, F.col("residual") ** 2)))
    span = lambda a: F.max(F.when(fit, F.col(a))) - F.min(F.when(fit, F.col(a)))
    before = (F.col("raw_x") - F.col("ref_x")) ** 2 + (F.col("raw_y") - F.col("ref_y")) ** 2
    stats = r.groupBy(*FRAME).agg(
        F.count_if(fit).alias("fit_inliers"), F.count_if(val).alias("validation_inliers"), rms(fit).alias("fit_rmse_px"), rms(val).alias("validation_rmse_px"),
        F.sqrt(F.avg(F.when(F.col("inlier"), before))).alias("before_rmse_px"), span("ref_x").alias("span_x"), span("ref_y").alias("span_y"),
        F.first("tx").alias("tx"), F.first("ty").alias("ty"),
    )
    g = frames.select(*FRAME, "width_px", "height_px").join(counts, FRAME, "left").join(stats, FRAME, "left").join(refused, FRAME, "left").na.fill(0, ["matched_features", "validation_matches", "fit_matches"])
    g = g.withColumns(
        {
            "fit_inlier_ratio": ratio("fit_inliers", "fit_matches"), "validation_inlier_ratio": ratio("validation_inliers", "validation_matches"),
            "coverage_x": F.coalesce(F.col("span_x") / F.col("width_px"), F.when(F.col("tx").isNotNull(), F.lit(0.0))),
            "coverage_y": F.coalesce(F.col("span_y") / F.col("height_px"), F.when(F.col("tx").isNotNull(), F.lit(0.0))),
            "overlap": F.greatest(F.lit(0.0), F.col("width_px") - F.abs("tx")) * F.greatest(F.lit(0.0), F.col("height_px") - F.abs("ty"))
            / (F.col("width_px") * F.col("height_px")),
        }
    )
    tried = F.col("tx").isNotNull()
    reasons = reason_array(
        [
            (F.col("error").isNotNull(), "invalid_correspondences"),
            (~tried & F.col("error").isNull(), "insufficient_verified_matches"),
            (tried & ((F.col("fit_inliers") < limits["min_inliers"]) | (F.col("fit_inlier_ratio") < limits["min_inlier_ratio"])), "weak_translation_consensus"),
            (
                tried
                & (
                    (F.col("validation_inliers") < min_validation) | (F.col("validation_inlier_ratio") < limits["min_inlier_ratio"])
                    | F.col("validation_rmse_px").isNull() | (F.col("validation_rmse_px") > limits["max_validation_rmse_px"])
                ),
                "validation_residual_or_support_failed",
            ),
            (tried & (F.least("coverage_x", "coverage_y") < limits["min_axis_coverage"]), "features_not_spatially_distributed"),
            (
                tried & ((F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2) > limits["max_shift_px"]) | (F.col("overlap") < limits["min_overlap"])),
                "shift_or_overlap_exceeds_limit",
            ),
        ]
    )
    g = g.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "estimated").otherwise("failed"))
    ok = F.col("status") == "estimated"
    return g.withColumns({"tx": F.when(ok, F.col("tx")), "ty": F.when(ok, F.col("ty"))}).drop("span_x", "span_y", "error")
