"""Constant-velocity fits, forecasts and path views, all in SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackframe.functions.columns import snap_zero

TRACK = ["sequence_id", "track_id"]

# The eight compass names, clockwise from +x with y pointing down.
DIRECTIONS = ["right", "lower right", "down", "lower left", "left", "upper left", "up", "upper right"]


def fit_velocity(points: DataFrame, time_basis: str = "frame", keys: list[str] = TRACK) -> DataFrame:
    """Least-squares x(t), y(t) per track over observed points with >= 3 distinct times.

    Two aggregates with one join between them: the first gives slopes and means, the
    second the residuals against the fitted line, which keeps a perfect fit at exactly
    zero. Both aggregate before the shuffle, so a very long track is no bottleneck.
    With time_basis='second' a track whose timestamps are missing or do not increase
    gets status 'bad_timestamps' and no fit.
    """
    if time_basis not in ("frame", "second"):
        raise ValueError("time_basis must be 'frame' or 'second'")
    t = F.col("frame_index") if time_basis == "frame" else F.col("timestamp_s")
    obs = points.where("point_type = 'observed'").select(
        *keys, "frame_index", t.cast("double").alias("t"), F.col("x_reference_px").alias("x"), F.col("y_reference_px").alias("y")
    )
    aggs = [
        F.count("*").alias("n"), F.count_distinct("t").alias("times"), F.count("t").alias("timed"),
        F.avg("t").alias("tm"), F.avg("x").alias("xm"), F.avg("y").alias("ym"),
        F.regr_slope("x", "t").alias("vx"), F.regr_slope("y", "t").alias("vy"),
        F.min_by("t", "frame_index").alias("t0"), F.max_by("t", "frame_index").alias("t_last"),
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"),
    ]
    fits = obs.groupBy(*keys).agg(*aggs)
    if time_basis == "second":
        order = W.partitionBy(*keys).orderBy("frame_index")
        bad = (
            obs.withColumn("step", F.col("t") - F.lag("t").over(order))
            .groupBy(*keys).agg(F.bool_or(F.col("t").isNull() | F.coalesce(F.col("step") <= 0, F.lit(False))).alias("bad"))
        )
        fits = fits.join(bad, keys)
    else:
        fits = fits.withColumn("bad", F.lit(False))
    usable = ~F.col("bad") & (F.col("n") >= 3) & (F.col("times") >= 3)
    fits = fits.withColumn(
        "status",
        F.when(F.col("n") < 3, "too_few_observations").when(F.col("bad"), "bad_timestamps")
        .when(F.col("times") < 3, "too_few_times").otherwise("fitted"),
    )
    good = fits.where(usable).select(
        *keys, "vx", "vy",
        (F.col("xm") + F.col("vx") * (F.col("t0") - F.col("tm"))).alias("x0"),
        (F.col("ym") + F.col("vy") * (F.col("t0") - F.col("tm"))).alias("y0"), "t0",
    )
    dx = F.col("x") - (F.col("x0") + F.col("vx") * (F.col("t") - F.col("t0")))
    dy = F.col("y") - (F.col("y0") + F.col("vy") * (F.col("t") - F.col("t0")))
    rmse = obs.join(good, keys).groupBy(*keys).agg(
        snap_zero(F.sqrt(F.avg(dx * dx + dy * dy))).alias("fit_rmse_px"),
        F.first("x0").alias("x_at_epoch_px"), F.first("y0").alias("y_at_epoch_px"),
    )
    shown = lambda c: F.when(F.col("status") == "fitted", F.col(c)).alias(c)
    return fits.join(rmse, keys, "left").select(
        *keys, "status", F.lit(time_basis).alias("time_basis"), shown("vx"), shown("vy"),
        F.when(F.col("status") == "fitted", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).alias("speed"),
        F.lit("px/frame" if time_basis == "frame" else "px/s").alias("speed_unit"), "fit_rmse_px",
        F.col("n").alias("observations_used"), F.col("t0").alias("reference_epoch"), "x_at_epoch_px", "y_at_epoch_px",
        "t_last", "first_frame", "last_frame",
    )


def extrapolate(
    fits: DataFrame, horizon: int = 2, frames: DataFrame | None = None, width: float | None = None, height: float | None = None,
    keys: list[str] = TRACK,
) -> DataFrame:
    """`horizon` future frames per fitted track.

    Seconds come from the declared frame times when `frames` knows them, else from the
    track's mean cadence. out_of_field is NULL while the image size is unknown.
    """
    f = fits.where("status = 'fitted'").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    f = f.withColumn("frame_index", F.col("last_frame") + F.col("step"))
    span = F.col("last_frame") - F.col("first_frame")
    per_frame = (F.col("t_last") - F.col("reference_epoch")) / F.when(span > 0, span).otherwise(F.col("observations_used") - 1)
    guess = F.col("t_last") + F.col("step") * per_frame
    if frames is not None:
        times = frames.select("sequence_id", "frame_index", F.col("timestamp_s").alias("known_s"))
        f = f.join(times, ["sequence_id", "frame_index"], "left")
    else:
        f = f.withColumn("known_s", F.lit(None).cast("double"))
    seconds = F.when(F.col("time_basis") == "second", F.coalesce("known_s", guess))
    at = F.coalesce(seconds, F.col("frame_index").cast("double")) - F.col("reference_epoch")
    x = F.col("x_at_epoch_px") + F.col("vx") * at
    y = F.col("y_at_epoch_px") + F.col("vy") * at
    size = (F.lit(width).cast("double"), F.lit(height).cast("double"))
    return f.select(
        *keys, "step", "frame_index", seconds.alias("timestamp_s"), x.alias("x_reference_px"), y.alias("y_reference_px")
    ).withColumn("point_type", F.lit("extrapolated")).withColumn(
        "out_of_field", out_of_field("x_reference_px", "y_reference_px", *size)
    )


def out_of_field(x: str, y: str, width, height):
    """True outside 0 <= x < w, 0 <= y < h; NULL when the size is unknown."""
    w = F.col(width) if isinstance(width, str) else width
    h = F.col(height) if isinstance(height, str) else height
    inside = (F.col(x) >= 0) & (F.col(x) < w) & (F.col(y) >= 0) & (F.col(y) < h)
    return F.when(w.isNotNull() & h.isNotNull(), ~inside)


def attach_trajectories(tracks: DataFrame, fits: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Tracks with their fit beside them, NULL for tracks without one."""
    cols = ["vx", "vy", "speed", "speed_unit", "fit_rmse_px", "observations_used", "reference_epoch", "x_at_epoch_px", "y_at_epoch_px"]
    return tracks.join(fits.where("status = 'fitted'").select(*keys, *cols), keys, "left")


def zero_order_forecast(points: DataFrame, horizon: int = 2, keys: list[str] = TRACK) -> DataFrame:
    """Hold the last observed position for `horizon` frames."""
    last = points.where("point_type = 'observed'").groupBy(*keys).agg(
        F.max_by(F.struct("frame_index", "x_reference_px", "y_reference_px"), "frame_index").alias("s")
    )
    return last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "s").select(
        *keys, "step", (F.col("s.frame_index") + F.col("step")).alias("frame_index"),
        F.col("s.x_reference_px").alias("x_reference_px"), F.col("s.y_reference_px").alias("y_reference_px"),
    )


def forecast_error(fitted: DataFrame, held: DataFrame, actual: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """RMSE per horizon for both models over the same forecasts, and the % reduction."""
    err = lambda m: (F.col(f"{m}.x_reference_px") - F.col("a.x_reference_px")) ** 2 + (
        F.col(f"{m}.y_reference_px") - F.col("a.y_reference_px")
    ) ** 2
    on = [*keys, "frame_index"]
    pack = lambda df, n: df.select(*on, *(["step"] if n == "v" else []), F.struct("x_reference_px", "y_reference_px").alias(n))
    both = pack(fitted, "v").join(pack(held, "h"), on).join(pack(actual, "a"), on)
    per = both.groupBy("step").agg(
        F.count("*").alias("forecasts"), F.sqrt(F.avg(err("v"))).alias("velocity_rmse_px"), F.sqrt(F.avg(err("h"))).alias("hold_rmse_px")
    )
    cut = (F.col("hold_rmse_px") - F.col("velocity_rmse_px")) / F.col("hold_rmse_px") * 100.0
    return per.withColumn("reduction_percent", F.when(F.col("hold_rmse_px") != 0, cut))


def displacement_direction(points: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Net displacement and its compass name (y down); NULL with one observation."""
    spot = F.struct(F.col("x_reference_px").alias("x"), F.col("y_reference_px").alias("y"))
    ends = points.where("point_type = 'observed'").groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by(spot, "frame_index").alias("a"), F.max_by(spot, "frame_index").alias("b")
    )
    moved = ends.select(
        *keys, F.when(F.col("n") > 1, F.col("b.x") - F.col("a.x")).alias("dx_px"),
        F.when(F.col("n") > 1, F.col("b.y") - F.col("a.y")).alias("dy_px"),
    )
    eighth = (F.floor(F.atan2("dy_px", "dx_px") / (F.lit(3.141592653589793) / 4) + 0.5) + 8) % 8
    names = F.array(*[F.lit(n) for n in DIRECTIONS])
    length = F.sqrt(F.col("dx_px") ** 2 + F.col("dy_px") ** 2)
    return moved.withColumn(
        "direction",
        F.when(F.col("dx_px").isNull(), "Insufficient observations").when(length < 1e-6, "No net displacement")
        .otherwise(F.element_at(names, (eighth + 1).cast("int"))),
    )


def quality_band(quality: str = "quality_score"):
    q = F.col(quality)
    return F.when(q < 0.4, "low").when(q < 0.7, "medium").otherwise("high")


def missing_frames(points: DataFrame, frames: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Declared frames in which a track has no observation."""
    seen = points.where("point_type = 'observed'")
    grid = seen.select(*keys).distinct().join(frames.select("sequence_id", "frame_index"), "sequence_id")
    return grid.join(seen.select(*keys, "frame_index"), [*keys, "frame_index"], "left_anti")


def visible_as_of(points: DataFrame, predictions: DataFrame, as_of: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """What a viewer at as_of(sequence_id, as_of_frame) may see.

    Observations up to that frame; forecasts only once the track's last observation
    has been reached, so nothing fitted to the future shows in the past.
    """
    obs = points.where("point_type = 'observed'")
    last = obs.groupBy(*keys).agg(F.max("frame_index").alias("last_frame"))
    cols = [*keys, "frame_index", "point_type", "x_reference_px", "y_reference_px"]
    past = obs.join(as_of, "sequence_id").where("frame_index <= as_of_frame").select("as_of_frame", *cols)
    ahead = (
        predictions.join(last, keys).join(as_of, "sequence_id")
        .where("as_of_frame >= last_frame and frame_index > last_frame").select("as_of_frame", *cols)
    )
    return past.unionByName(ahead)


def path_segments(points: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Consecutive pairs of a track's observations."""
    w = W.partitionBy(*keys).orderBy("frame_index")
    was = lambda c: F.lag(c).over(w)
    return (
        points.where("point_type = 'observed'")
        .select(
            *keys, was("frame_index").alias("from_frame"), F.col("frame_index").alias("to_frame"),
            was("x_reference_px").alias("x0"), was("y_reference_px").alias("y0"),
            F.col("x_reference_px").alias("x1"), F.col("y_reference_px").alias("y1"),
        )
        .where("from_frame is not null")
    )


def supported_motion(points: DataFrame, tracks: DataFrame, fits: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Tracks with a boolean `supported`: >= 3 observations, box diagonal >= 2 px,
    quality >= .5, a fit, and a residual that is unknown or <= 3 px."""
    span = points.where("point_type = 'observed'").groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sqrt(
            (F.max("x_reference_px") - F.min("x_reference_px")) ** 2 + (F.max("y_reference_px") - F.min("y_reference_px")) ** 2
        ).alias("span_px"),
    )
    fit = fits.where("status = 'fitted'").select(*keys, F.lit(True).alias("has_fit"), "fit_rmse_px")
    ok = (
        (F.coalesce("n", F.lit(0)) >= 3) & (F.coalesce("span_px", F.lit(0.0)) >= 2) & (F.col("quality_score") >= 0.5)
        & F.col("has_fit").isNotNull() & (F.col("fit_rmse_px").isNull() | (F.col("fit_rmse_px") <= 3))
    )
    return tracks.join(span, keys, "left").join(fit, keys, "left").select(*tracks.columns, "span_px", F.coalesce(ok, F.lit(False)).alias("supported"))
