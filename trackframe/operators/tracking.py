"""Multi-object tracking over frame sequences, batch form."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from trackframe.functions.columns import all_of
from trackframe.functions.groups import spread
from trackframe.functions.lineage import cut_lineage
from trackframe.functions.ranks import global_rank
from trackframe.functions.stepper import ActiveTrack, SequenceStepper, TrackerConfig
from trackframe.operators.matching import match_points

# Rows of one sequence that one task steps through; a declared sequence stays far below.
SEQUENCE_ROWS = 200_000

STATES = ("tentative", "confirmed", "ended")

POINT_SCHEMA = T.StructType(
    [
        T.StructField("config_id", T.StringType()),
        T.StructField("sequence_id", T.StringType()),
        T.StructField("track_no", T.LongType()),
        T.StructField("obs_no", T.IntegerType()),
        T.StructField("frame_index", T.IntegerType()),
        T.StructField("timestamp_s", T.DoubleType()),
        T.StructField("x_reference_px", T.DoubleType()),
        T.StructField("y_reference_px", T.DoubleType()),
        T.StructField("x_raw_px", T.DoubleType()),
        T.StructField("y_raw_px", T.DoubleType()),
        T.StructField("detection_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("observed_count", T.IntegerType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("misses", T.IntegerType()),
    ]
)

TRACE_SCHEMA = T.StructType(
    [
        T.StructField("config_id", T.StringType()),
        T.StructField("sequence_id", T.StringType()),
        T.StructField("frame_index", T.IntegerType()),
        T.StructField("event", T.StringType()),
        T.StructField("track_no", T.LongType()),
        T.StructField("detection_id", T.StringType()),
        T.StructField("x_predicted", T.DoubleType()),
        T.StructField("y_predicted", T.DoubleType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("within_gate", T.BooleanType()),
        T.StructField("selected", T.BooleanType()),
        T.StructField("rejected_pairs", T.LongType()),
    ]
)


def track_id(number: Column) -> Column:
    """track-0001 style text id; sort by track_no, the text stops sorting after 9999."""
    text = number.cast("string")
    return F.concat(F.lit("track-"), F.when(number < 10_000, F.lpad(text, 4, "0")).otherwise(text))


def predicted_position(points: DataFrame, motion_aware: bool = True) -> DataFrame:
    """For every observation, where the track's two earlier ones put it.

    Diagnostic SQL form of the tracker's motion model: velocity per frame gap from the
    last two observations, else hold the last position.
    """
    w = W.partitionBy("sequence_id", "track_id").orderBy("frame_index")
    lag = lambda c, n: F.lag(c, n).over(w)
    p = points.where("point_type = 'observed'").select(
        "sequence_id", "track_id", "frame_index", "x_reference_px", "y_reference_px",
        lag("frame_index", 1).alias("f1"), lag("frame_index", 2).alias("f2"),
        lag("x_reference_px", 1).alias("x1"), lag("x_reference_px", 2).alias("x2"),
        lag("y_reference_px", 1).alias("y1"), lag("y_reference_px", 2).alias("y2"),
    )
    moving = F.lit(motion_aware) & F.col("f2").isNotNull()

    def ahead(a, b):
        step = (F.col(a) - F.col(b)) / (F.col("f1") - F.col("f2"))
        return F.when(moving, F.col(a) + step * (F.col("frame_index") - F.col("f1"))).otherwise(F.col(a))

    return p.where("f1 is not null").select(
        "sequence_id", "track_id", "frame_index",
        ahead("x1", "x2").alias("x_predicted"), ahead("y1", "y2").alias("y_predicted"),
        "x_reference_px", "y_reference_px",
    )


def tracking_input(detections: DataFrame, frames: DataFrame | None, space: str) -> DataFrame:
    """Detection rows plus one marker row per declared frame, markers first."""
    if space not in ("raw", "reference"):
        raise ValueError("space must be 'raw' or 'reference'")
    x, y = f"x_{space}_px", f"y_{space}_px"
    null = lambda t: F.lit(None).cast(t)
    stamp = F.col("timestamp_s").cast("double") if "timestamp_s" in detections.columns and frames is None else null("double")
    dets = detections.select(
        "sequence_id", F.col("frame_index").cast("int").alias("frame_index"), F.lit(1).alias("is_det"),
        F.col("detection_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        F.col("x_raw_px").cast("double").alias("x_raw"), F.col("y_raw_px").cast("double").alias("y_raw"),
        F.col("quality_score").cast("double").alias("quality"), stamp.alias("timestamp_s"),
    )
    if frames is None:
        return dets
    stamp = F.col("timestamp_s").cast("double") if "timestamp_s" in frames.columns else null("double")
    marks = frames.select(
        "sequence_id", F.col("frame_index").cast("int").alias("frame_index"), F.lit(0).alias("is_det"),
        null("string").alias("detection_id"), null("double").alias("x"), null("double").alias("y"),
        null("double").alias("x_raw"), null("double").alias("y_raw"), null("double").alias("quality"),
        stamp.alias("timestamp_s"),
    )
    return dets.unionByName(marks)


def track_sequences(
    detections: DataFrame,
    frames: DataFrame | None = None,
    configs: Sequence[TrackerConfig] = (TrackerConfig(),),
    space: str = "raw",
    sequences_are_small: bool | None = None,
    sequence_rows: int = SEQUENCE_ROWS,
) -> DataFrame:
    """Track every sequence under every configuration in one job.

    Steps through each declared frame, empty ones included; without `frames` the
    range from a sequence's first to its last detected frame is used. Returns one row
    per observation with its track's final state beside it (see `tracks_of`).

    One shuffle by sequence serves all configurations: rows arrive sorted by frame
    and detection id, and a task keeps only the active tracks. Sequences with more
    than `sequence_rows` detections are moved to `track_by_rounds`, which spreads each
    frame over the cluster. sequences_are_small=None counts rows per sequence first;
    pass True when the producer bounds them.
    """
    configs = tuple(configs)
    small, crowded = detections, None
    if sequences_are_small is None:
        busy = detections.groupBy("sequence_id").count().where(F.col("count") > sequence_rows).select("sequence_id")
        if not busy.isEmpty():
            small = detections.join(busy, "sequence_id", "left_anti")
            crowded = detections.join(busy, "sequence_id", "left_semi")
            crowded_frames = frames.join(busy, "sequence_id", "left_semi") if frames is not None else None
            frames = frames.join(busy, "sequence_id", "left_anti") if frames is not None else None
    out = _run_steps(tracking_input(small, frames, space), configs, frames is not None, False)
    if crowded is not None:
        for config in configs:
            out = out.unionByName(track_by_rounds(crowded, crowded_frames, config, space))
    return out


def track_by_rounds(
    detections: DataFrame, frames: DataFrame | None = None, config: TrackerConfig = TrackerConfig(), space: str = "raw"
) -> DataFrame:
    """The same tracks with the cluster working on one frame of every sequence at a time.

    For sequences too crowded for one task. A round joins predictions and detections
    by distance cell, matches them exactly and updates a table of active tracks; the
    number of rounds is the number of frames, not of rows. State is cut into the
    checkpoint folder every round.
    """
    rows = tracking_input(detections, None, space)
    if frames is None:
        span = rows.groupBy("sequence_id").agg(F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"))
        frames = span.select("sequence_id", F.explode(F.sequence("lo", "hi")).alias("frame_index"))
        stamps = rows.select("detection_id", "sequence_id", "timestamp_s")
    else:
        stamps = None
    has_stamp = "timestamp_s" in frames.columns
    steps = cut_lineage(
        frames.select(
            "sequence_id", F.col("frame_index").cast("int").alias("frame_index"),
            (F.col("timestamp_s") if has_stamp else F.lit(None)).cast("double").alias("frame_s"),
            F.row_number().over(W.partitionBy("sequence_id").orderBy("frame_index")).alias("step"),
        )
    )
    rounds = steps.agg(F.max("step")).first()[0] or 0
    rows = cut_lineage(rows.join(steps, ["sequence_id", "frame_index"]))
    spark = detections.sparkSession
    state = spark.createDataFrame(
        [], "sequence_id string, track_no long, f1 int, x1 double, y1 double, f0 int, x0 double, y0 double, misses int"
    )
    born = spark.createDataFrame([], "sequence_id string, born long")
    done = []
    for k in range(1, rounds + 1):
        now = steps.where(F.col("step") == k).select("sequence_id", "frame_index")
        dets = rows.where(F.col("step") == k)
        ahead = (F.col("frame_index") - F.col("f1")) / (F.col("f1") - F.col("f0"))
        moving = F.lit(config.motion_aware) & F.col("f0").isNotNull()
        spots = state.join(now, "sequence_id").select(
            "sequence_id", "frame_index", "track_no",
            F.when(moving, F.col("x1") + (F.col("x1") - F.col("x0")) * ahead).otherwise(F.col("x1")).alias("x"),
            F.when(moving, F.col("y1") + (F.col("y1") - F.col("y0")) * ahead).otherwise(F.col("y1")).alias("y"),
        )
        pairs = match_points(
            spots, dets, config.gate_distance_px, "track_no", "detection_id", frames_are_small=False
        ).pairs.select("sequence_id", "frame_index", "track_no", "detection_id")
        pairs = cut_lineage(pairs)
        fresh = dets.join(pairs, ["sequence_id", "frame_index", "detection_id"], "left_anti")
        fresh = global_rank(fresh.select("sequence_id", "frame_index", "detection_id"), ["sequence_id"], ["detection_id"])
        fresh = fresh.join(born, "sequence_id", "left").select(
            "sequence_id", "frame_index", (F.coalesce("born", F.lit(0)) + F.col("rank")).alias("track_no"), "detection_id"
        )
        owned = cut_lineage(
            pairs.unionByName(fresh).join(dets, ["sequence_id", "frame_index", "detection_id"])
        )
        done.append(owned)
        seen = owned.select("sequence_id", "track_no", F.col("frame_index").alias("f"), F.col("x").alias("nx"), F.col("y").alias("ny"))
        hit = F.col("f").isNotNull()
        state = (
            state.join(now.select("sequence_id", F.lit(True).alias("stepped")), "sequence_id", "left")
            .join(seen, ["sequence_id", "track_no"], "full_outer")
            .select(
                "sequence_id", "track_no",
                F.coalesce("f", "f1").alias("f1"), F.coalesce("nx", "x1").alias("x1"), F.coalesce("ny", "y1").alias("y1"),
                *[F.when(hit, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("f1", "f0"), ("x1", "x0"), ("y1", "y0"))],
                F.when(hit, F.lit(0)).when(F.col("stepped"), F.col("misses") + 1).otherwise(F.col("misses")).cast("int").alias("misses"),
            )
            .where(F.col("misses") <= config.max_consecutive_misses)
        )
        state = cut_lineage(state)
        born = cut_lineage(
            born.unionByName(owned.groupBy("sequence_id").agg(F.max("track_no").alias("born")))
            .groupBy("sequence_id").agg(F.max("born").alias("born"))
        )
    if not done:
        return spark.createDataFrame([], POINT_SCHEMA)
    points = reduce(DataFrame.unionByName, done)
    key = ["sequence_id", "track_no"]
    last = steps.groupBy("sequence_id").agg(F.max("step").alias("last_step"))
    tracks = points.groupBy(*key).agg(
        F.count("*").cast("int").alias("observed_count"),
        F.least(F.greatest(F.avg("quality"), F.lit(0.0)), F.lit(1.0)).alias("quality_score"), F.max("step").alias("seen_step"),
    ).join(last, "sequence_id")
    unseen = F.col("last_step") - F.col("seen_step")
    over = unseen > config.max_consecutive_misses
    tracks = tracks.select(
        *key, "observed_count", "quality_score",
        F.when(over, "ended").when(F.col("observed_count") >= config.confirmation_observations, "confirmed")
        .otherwise("tentative").alias("status"),
        F.least(unseen, F.lit(config.max_consecutive_misses + 1)).cast("int").alias("misses"),
    )
    stamp = F.col("timestamp_s") if stamps is not None else F.col("frame_s")
    return points.join(tracks, key).select(
        F.lit(config.config_id).alias("config_id"), "sequence_id", "track_no",
        F.row_number().over(W.partitionBy(*key).orderBy("frame_index")).alias("obs_no"), "frame_index",
        stamp.alias("timestamp_s"), F.col("x").alias("x_reference_px"), F.col("y").alias("y_reference_px"),
        F.col("x_raw").alias("x_raw_px"), F.col("y_raw").alias("y_raw_px"), "detection_id",
        "status", "observed_count", "quality_score", "misses",
    )


def association_trace(
    detections: DataFrame, frames: DataFrame | None = None, config: TrackerConfig = TrackerConfig(), space: str = "raw"
) -> DataFrame:
    """Every gated (prediction, detection) pair with its distance and whether it won,
    plus births and missed tracks, per frame. Pairs outside the gate cannot win; each
    frame carries one 'frame' row with their number instead of the pairs themselves."""
    return _run_steps(tracking_input(detections, frames, space), (config,), frames is not None, True)


def _run_steps(rows: DataFrame, configs: tuple[TrackerConfig, ...], declared: bool, trace: bool) -> DataFrame:
    ordered = spread(rows, ["sequence_id"]).sortWithinPartitions(
        "sequence_id", "frame_index", "is_det", "detection_id"
    )
    schema = TRACE_SCHEMA if trace else POINT_SCHEMA
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = frame = None
        open_frame = False
        stamp = None
        dets: list = []
        steppers: list[SequenceStepper] = []
        out: list = []

        def close_frame():
            if frame is None or not (open_frame or not declared):
                return
            for s in steppers:
                log = [] if trace else None
                if not declared and s.last_frame is not None:
                    for empty in range(s.last_frame + 1, frame):
                        if not s.active:
                            break
                        finish(s, s.step(empty, [], log), True)
                finish(s, s.step(frame, dets, log), True)
                if trace:
                    out.extend((s.config.config_id, seq, *row) for row in log)

        def finish(s: SequenceStepper, tracks: list[ActiveTrack], over: bool):
            if trace:
                return
            c = s.config
            for t in tracks:
                status = "ended" if over else t.status(c.confirmation_observations)
                q = t.quality()
                for n, point in enumerate(t.points, 1):
                    out.append((c.config_id, seq, t.track_no, n, *point, status, t.count, q, t.misses))

        def close_sequence():
            close_frame()
            for s in steppers:
                finish(s, s.active, False)

        def flush():
            nonlocal out
            block, out = pd.DataFrame(out, columns=names), []
            for c in ("frame_index", "obs_no", "observed_count", "misses"):
                if c in block:
                    block[c] = block[c].astype("int32")
            for c in ("track_no", "rejected_pairs"):
                if trace:
                    block[c] = block[c].astype("Int64")
            return block

        for batch in batches:
            for row in zip(*[batch[c].tolist() for c in (
                "sequence_id", "frame_index", "is_det", "detection_id", "x", "y", "x_raw", "y_raw", "quality", "timestamp_s"
            )]):
                sid, fi, is_det, did, x, y, xr, yr, q, ts = row
                if sid != seq:
                    close_sequence()
                    seq, frame, dets, open_frame = sid, None, [], False
                    steppers = [SequenceStepper(c) for c in configs]
                if fi != frame:
                    close_frame()
                    frame, dets, open_frame, stamp = fi, [], False, None
                if not is_det:
                    open_frame, stamp = True, (None if ts != ts else ts)
                else:
                    seen = stamp if declared else (None if ts is None or ts != ts else ts)
                    dets.append((did, x, y, q, (fi, seen, x, y, xr, yr, did)))
            if len(out) >= 10_000:
                yield flush()
        close_sequence()
        if out:
            yield flush()

    return ordered.mapInPandas(run, schema)


def tracks_of(points: DataFrame) -> DataFrame:
    """One row per track, read off the first observation: no shuffle."""
    return points.where("obs_no = 1").select(
        "config_id", "sequence_id", "track_no", track_id(F.col("track_no")).alias("track_id"),
        "status", "observed_count", "quality_score", F.col("frame_index").alias("first_frame"),
        F.when(
            F.col("status") == "ended",
            F.array(F.format_string("Track ended after %d consecutive missed frames.", F.col("misses"))),
        ).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def points_of(points: DataFrame) -> DataFrame:
    """The track_points table of the data model."""
    return points.select(
        "config_id", "sequence_id", "track_no", track_id(F.col("track_no")).alias("track_id"), "frame_index",
        "timestamp_s", "x_reference_px", "y_reference_px", "x_raw_px", "y_raw_px",
        F.lit("observed").alias("point_type"), "detection_id", F.lit(False).alias("out_of_field"),
    )


def fold_configs(steps: DataFrame, configs: Sequence[TrackerConfig]) -> DataFrame:
    """One row per detection with its steps under all configurations as one number each.

    A sequence is stepped through under all of them by one task, so its rows meet before they
    are shuffled. A number holds the configuration's place in `configs`, whether the step is the
    first of its track, and the track's number, final status and count (as far as its
    confirmation asks).
    """
    of = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    ix = of([(c.config_id, n) for n, c in enumerate(configs)])[F.col("config_id")]
    state = of([(s, n) for n, s in enumerate(STATES)])[F.col("status")]
    count = F.least(F.col("observed_count"), of([(c.config_id, c.confirmation_observations) for c in configs])[F.col("config_id")])
    number = F.col("track_no")
    for size, digit in zip(_sizes(configs), (count, ix, state, (F.col("obs_no") == 1).cast("int"))):
        number = number * size + digit
    spot = ["sequence_id", "frame_index", "detection_id", F.col("x_reference_px").alias("x"), F.col("y_reference_px").alias("y")]
    return steps.groupBy(*spot).agg(F.collect_list(number).alias("steps"))


def _sizes(configs: Sequence[TrackerConfig]) -> list[int]:
    return [max(c.confirmation_observations for c in configs) + 1, len(configs), len(STATES), 2]


def _digits(number: Column, configs: Sequence[TrackerConfig]) -> list[Column]:
    """track_no, count, place of the configuration, status and whether it is the first, of a number of `fold_configs`."""
    out = []
    for size in reversed(_sizes(configs)):
        out.append((number % size).cast("int"))
        number = F.call_function("div", number, F.lit(size))
    return [number, *reversed(out)]


def unfold_configs(folded: DataFrame, configs: Sequence[TrackerConfig]) -> DataFrame:
    """The rows behind `fold_configs`, other columns kept: config_id, track_no, status, observed_count and whether a row is its track's first."""
    rest = [c for c in folded.columns if c != "steps"]
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)
    no, count, ix, state, first = _digits(F.col("s"), configs)
    return folded.select(*rest, F.explode("steps").alias("s")).select(
        pick([c.config_id for c in configs], ix).alias("config_id"), *rest, no.alias("track_no"), pick(STATES, state).alias("status"),
        count.alias("observed_count"), (first == 1).alias("first"), F.lit("observed").alias("point_type"),
    )


def fold_accepted(folded: DataFrame, configs: Sequence[TrackerConfig]) -> DataFrame:
    """Only the steps of tracks that `accepted_observations` would accept, and rows that have any."""
    limits = F.array(*[F.lit(c.confirmation_observations) for c in configs])

    def good(number):
        _, count, ix, state, _ = _digits(number, configs)
        return (state == STATES.index("confirmed")) | ((state == STATES.index("ended")) & (count >= F.element_at(limits, ix + 1)))

    return folded.withColumn("steps", F.filter("steps", good)).where(F.size("steps") > 0)


def tracks_with_status(tracks: DataFrame, status: str | None = None) -> DataFrame:
    """Snapshot of tracks, optionally of one status, ordered by id."""
    chosen = tracks if status is None else tracks.where(F.col("status") == status)
    return chosen.orderBy("sequence_id", "track_id")


def track_summary(points: DataFrame, track_keys: list[str] = ["sequence_id", "track_id"]) -> DataFrame:
    """observed_count, mean quality clipped to [0, 1] (.5 if none), first and last frame."""
    seen = F.col("point_type") == "observed"
    mean = F.avg(F.when(seen, F.col("quality_score")))
    return points.groupBy(*track_keys).agg(
        F.count_if(seen).alias("observed_count"),
        F.coalesce(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)).alias("quality_score"),
        F.min(F.when(seen, F.col("frame_index"))).alias("first_frame"),
        F.max(F.when(seen, F.col("frame_index"))).alias("last_frame"),
    )


def lifecycle(
    points: DataFrame,
    last_frames: DataFrame,
    confirmation_observations: int = 3,
    max_consecutive_misses: int = 2,
    track_keys: list[str] = ["sequence_id", "track_id"],
) -> DataFrame:
    """Track states implied by observations and each sequence's last declared frame."""
    s = track_summary(points, track_keys).join(last_frames, "sequence_id")
    misses = F.least(F.col("sequence_last_frame") - F.col("last_frame"), F.lit(max_consecutive_misses + 1))
    over = F.col("sequence_last_frame") - F.col("last_frame") > max_consecutive_misses
    return s.select(
        *track_keys, "observed_count", "quality_score", "first_frame", "last_frame",
        F.when(over, "ended").when(F.col("observed_count") >= confirmation_observations, "confirmed")
        .otherwise("tentative").alias("status"),
        F.when(over, F.array(F.format_string("Track ended after %d consecutive missed frames.", misses.cast("int"))))
        .otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def confirmed_in_lifecycle(tracks: DataFrame, min_observations: int | str = 3) -> DataFrame:
    """Tracks that are confirmed, or ended after enough observations."""
    k = F.col(min_observations) if isinstance(min_observations, str) else F.lit(min_observations)
    return tracks.where(
        (F.col("status") == "confirmed") | ((F.col("status") == "ended") & (F.col("observed_count") >= k))
    )


def accepted_observations(points: DataFrame, tracks: DataFrame | None, keys: list[str], min_observations: int | str = 3) -> DataFrame:
    """Observed points of the tracks accepted by `confirmed_in_lifecycle`.

    Without `tracks`, points have the final state of their track beside them and nothing is joined.
    Tracks that come out of Python have no size estimate of worth, so they are never broadcast.
    """
    if tracks is None:
        known = all_of([F.col(k).isNotNull() for k in keys])
        return confirmed_in_lifecycle(points.where("point_type = 'observed'").where(known), min_observations)
    good = confirmed_in_lifecycle(tracks, min_observations).select(*keys)
    return points.where("point_type = 'observed'").join(good.hint("merge"), keys, "left_semi")


def track_snapshots(points: DataFrame, frames: DataFrame, confirmation_observations: int = 3, max_consecutive_misses: int = 2) -> DataFrame:
    """State of every track after every frame since its birth (`process_frame` view).

    Running counts over one track's declared frames; a track's rows are bounded by
    the frames of its sequence.
    """
    key = ["sequence_id", "track_id"]
    seen = points.where("point_type = 'observed'").select(*key, "frame_index", F.lit(1).alias("seen"))
    born = seen.groupBy(*key).agg(F.min("frame_index").alias("born"))
    grid = born.join(frames.select("sequence_id", "frame_index"), "sequence_id").where("frame_index >= born")
    w = W.partitionBy(*key).orderBy("frame_index")
    s = grid.join(seen, [*key, "frame_index"], "left").select(
        *key, "frame_index", F.coalesce("seen", F.lit(0)).alias("seen"),
        F.sum(F.coalesce("seen", F.lit(0))).over(w).alias("observed_count"), F.row_number().over(w).alias("step"),
    )
    s = s.withColumn("last_step", F.max(F.when(F.col("seen") == 1, F.col("step"))).over(w))
    misses = F.col("step") - F.col("last_step")
    return s.select(
        *key, "frame_index", "observed_count",
        F.when(misses > max_consecutive_misses, "ended")
        .when(F.col("observed_count") >= confirmation_observations, "confirmed").otherwise("tentative").alias("status"),
    )
