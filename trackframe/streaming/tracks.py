"""The tracker and its monitors on a stream, keyed by buckets of sequences or frames."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackframe.functions.assignment import solve
from trackframe.functions.columns import dist
from trackframe.functions.lineage import ensure_checkpoint_dir
from trackframe.functions.stepper import ActiveTrack, SequenceStepper, TrackerConfig
from trackframe.operators.matching import gate_cells

OUTPUT = T.StructType(
    [
        T.StructField("sequence_id", T.StringType()),
        T.StructField("frame_index", T.IntegerType()),
        T.StructField("event", T.StringType()),
        T.StructField("track_no", T.LongType()),
        T.StructField("detection_id", T.StringType()),
        T.StructField("x_reference_px", T.DoubleType()),
        T.StructField("y_reference_px", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("observed_count", T.IntegerType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("misses", T.IntegerType()),
    ]
)
ARROW_OUTPUT = to_arrow_schema(OUTPUT)
# Keyed list state needs the state store that ships with Spark for it; a commit writes down
# what changed, and a partition of a join has one store and not four.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}
# Partitions of state a core has, at most: each one costs a stored state and a Python worker's start in every batch.
CORE_STATES = 2

# Sequences or frames share a key by their hash, so that state is read and written by block and not by row.
BUCKETS = 512
# Rows of one block of state, and of one table of output.
BLOCK = 10_000
# Rows that a task deals over the buckets at a time.
PACK = 200_000

ARRAYS = lambda columns: ", ".join(f"{n} array<{t}>" for n, t in (c.split() for c in columns.split(", ")))
TRACK_STATE = ARRAYS("sequence string, track_no long, misses int, count int, quality double, f1 int, x1 double, y1 double, f0 int, x0 double, y0 double")
BUFFER_STATE = "rows binary"
META_STATE = ARRAYS("sequence string, next_no long, last_frame int, closed int")
WAKE_STATE = "at_ms long"

ROWS = pa.schema([("sequence_id", pa.string()), ("frame_index", pa.int32()), ("detection_id", pa.string()), *((c, pa.float64()) for c in ("x", "y", "quality_score")), ("closes", pa.int32()), ("ends", pa.bool_()), ("at_ms", pa.int64())])


class Bucket(StatefulProcessor):
    """List states of blocks of rows, and one timer at the time stored in `wake`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wake = handle.getValueState("wake", WAKE_STATE)

    def _wakes(self) -> int | None:
        return _whole(self.wake.get()[0]) if self.wake.exists() else None

    def _wake_at(self, before: int | None, at: int | None, mark: int) -> None:
        """Move the timer; one that has expired is about to fire and stays."""
        if at == before:
            return
        if before is not None and before > mark:
            self.handle.deleteTimer(before)
        if at is None:
            self.wake.clear()
        else:
            self.handle.registerTimer(at)
            self.wake.update((at,))

    def close(self) -> None:
        pass


class FrameTracker(Bucket):
    """Buffers detections until their frame is closed, then steps frame by frame.

    A frame is closed by a marker (`closes`) or, with event times, once the watermark has
    passed the LATEST row of it and of every earlier open frame of its sequence. State per
    bucket of sequences: their active tracks (ended ones are emitted and forgotten), the rows
    of open frames, to which a batch that closes nothing only appends, and three numbers per
    sequence; an end marker drops all of a sequence. The bucket's timer stands at or before the
    next time at which a frame of it can close. Rows for a frame that is already processed go
    out as 'late' and never enter a track.
    """

    def __init__(self, config: TrackerConfig, timed: bool = False):
        self.config, self.timed = config, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tracks = handle.getListState("tracks", TRACK_STATE)
        self.buffer = handle.getListState("buffer", BUFFER_STATE)
        self.meta = handle.getListState("meta", META_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        meta = self._numbers()
        given = pa.concat_tables([ROWS.empty_table(), *map(self._given, rows)])
        touched = pc.unique(given["sequence_id"]).to_pylist()
        for seq in touched:
            meta.setdefault(seq, [1, None, None])
        over = set(pc.unique(given.filter(given["ends"])["sequence_id"]).to_pylist())
        marks = given.filter(pc.is_valid(given["closes"]))
        for seq, closes in zip(marks["sequence_id"].to_pylist(), marks["closes"].to_pylist()):
            meta[seq][2] = closes if meta[seq][2] is None else max(meta[seq][2], closes)
        fresh = given.filter(pc.is_valid(given["detection_id"]))
        if fresh["frame_index"].null_count:
            raise ValueError("a row with a detection_id needs a frame_index")
        if any(meta[s][1] is not None for s in touched):
            last = pa.array([meta[s][1] for s in fresh["sequence_id"].to_pylist()], pa.int64())
            late = pc.fill_null(pc.less_equal(fresh["frame_index"], last), False)
            yield from _tables((seq, fi, "late", None, did, x, y, None, None, q, None) for seq, fi, did, x, y, q, _ in _listed(fresh.filter(late)))
            fresh = fresh.filter(pc.invert(late))
        mark, before = (timerValues.getCurrentWatermarkInMs(), self._wakes()) if self.timed else (None, None)
        wake = min((t for t in (before, pc.min(fresh["at_ms"]).as_py()) if t is not None), default=None) if self.timed else None
        closing = any(meta[s][2] is not None and (meta[s][1] is None or meta[s][2] > meta[s][1]) for s in touched)
        if over or closing or wake is not None and wake <= mark:
            yield from _tables(self._advance(meta, fresh, over, mark, before))
            return
        for block in _packed(fresh):
            self.buffer.appendValue(block)
        if self.timed:
            self._wake_at(before, wake, mark)
        _keep(self.meta, [(s, *n) for s, n in meta.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, before = timerValues.getCurrentWatermarkInMs(), self._wakes()
        if before is not None and before <= mark:  # else the batch's rows have moved it already
            yield from _tables(self._advance(self._numbers(), ROWS.empty_table(), set(), mark, before))

    def _given(self, block: pd.DataFrame) -> pa.Table:
        """The rows of one input table; without event times they come in blocks."""
        if self.timed:
            return pa.Table.from_pandas(block[ROWS.names], ROWS, preserve_index=False)
        return pa.concat_tables(_unpacked(b) for b in block["rows"])

    def _numbers(self) -> dict[str, list]:
        """next_no, last and closed of every sequence."""
        return {s: [int(n), _whole(last), _whole(closed)] for s, n, last, closed in _held(self.meta)}

    def _advance(self, meta: dict[str, list], fresh: pa.Table, over: set, mark: int | None, before: int | None) -> Iterator[tuple]:
        """Step every sequence through its closed frames, row by row, and put the state back."""
        opened = pa.concat_tables([*(_unpacked(b) for (b,) in self.buffer.get()), fresh])
        open_frames: dict = {}
        for row in _listed(opened):
            open_frames.setdefault(row[0], {}).setdefault(row[1], []).append(row)
        active: dict = {}
        for row in _held(self.tracks):
            active.setdefault(row[0], []).append(row[1:])
        tracks, rest, wakes = [], [], []
        for seq, numbers in meta.items():
            frames = open_frames.get(seq, {})
            times = {fi: max((r[6] for r in rows if r[6] is not None), default=None) if self.timed else None for fi, rows in frames.items()}
            if self.timed:
                numbers[2] = _passed(times, numbers[2], mark)
            if seq in over and times:
                numbers[2] = max([*times, *([numbers[2]] if numbers[2] is not None else [])])
            next_no, last, closed = numbers
            held = active.get(seq, [])
            if closed is not None and (last is None or closed > last):
                stepper = SequenceStepper(self.config, next_no)
                for no, misses, count, quality, f1, x1, y1, f0, x0, y0 in held:
                    earlier = None if f0 is None or f0 != f0 else (int(f0), x0, y0)
                    stepper.active.append(ActiveTrack(int(no), int(misses), int(count), quality, (int(f1), x1, y1), earlier))
                done = sorted(fi for fi in times if fi <= closed)
                start = last + 1 if last is not None else (done[0] if done else closed + 1)
                for fi in range(start, closed + 1):
                    rows = sorted(r[2:6] for r in frames.pop(fi, []))
                    if stepper.active or rows:
                        yield from self._frame(seq, stepper, fi, [(did, x, y, q, did) for did, x, y, q in rows])
                for fi in done:
                    frames.pop(fi, None)
                numbers[0] = stepper.next_no
                if done or last is not None:
                    numbers[1] = closed
                held = [(t.track_no, t.misses, t.count, t.quality_sum, *t.last, *(t.before or (None, None, None))) for t in stepper.active]
            if seq not in over:
                tracks += [(seq, *t) for t in held]
                rest += [(seq, fi) for fi in frames]
                first = min((fi for fi in frames if times[fi] is not None), default=None)
                wakes += [] if first is None else [times[first]]
        _keep(self.tracks, tracks)
        self._keep_open(opened, rest)
        _keep(self.meta, [(s, *n) for s, n in meta.items() if s not in over])
        if self.timed:
            self._wake_at(before, min(wakes, default=None), mark)

    def _keep_open(self, opened: pa.Table, frames: list) -> None:
        """Replace the buffer by the rows of these frames."""
        kept = set(frames)
        stays = [k in kept for k in zip(opened["sequence_id"].to_pylist(), opened["frame_index"].to_pylist())] if kept else []
        if any(stays):
            self.buffer.put(_packed(opened.filter(pa.array(stays))))
        else:
            self.buffer.clear()

    def _frame(self, seq, stepper: SequenceStepper, frame: int, dets: list) -> list:
        """Snapshot rows of every active track after this frame, plus ended ones."""
        confirm = self.config.confirmation_observations
        ended = stepper.step(frame, dets)
        rows = []
        for t in stepper.active:
            at, x, y = t.last
            if at == frame:
                rows.append((seq, frame, "observed", t.track_no, t.points[-1], x, y, t.status(confirm), t.count, t.quality(), t.misses))
                del t.points[:-1]
            else:
                rows.append((seq, frame, "missed", t.track_no, None, None, None, t.status(confirm), t.count, t.quality(), t.misses))
        rows += [(seq, frame, "ended", t.track_no, None, None, None, "ended", t.count, t.quality(), t.misses) for t in ended]
        return rows


def _whole(v) -> int | None:
    return None if v is None or v != v else int(v)


def _passed(times: dict[int, int | None], closed: int | None, mark: int) -> int | None:
    """The last open frame up to which every row seen lies behind the watermark; rows without a time wait for it, but hold nothing up."""
    for fi in sorted(times):
        if times[fi] is not None:
            if times[fi] > mark:
                break
            closed = fi if closed is None else max(closed, fi)
    return closed


def _rows(rows: list) -> pd.DataFrame:
    columns = [pa.array(c, t, from_pandas=True) for c, t in zip(zip(*rows), ARROW_OUTPUT.types)]
    return pa.Table.from_arrays(columns, schema=ARROW_OUTPUT).to_pandas(types_mapper=pd.ArrowDtype)


def _tables(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    rows = iter(rows)
    while block := list(islice(rows, BLOCK)):
        yield _rows(block)


def _packed(table: pa.Table) -> list[tuple]:
    """Rows as elements of a list state: an Arrow stream for every BLOCK rows."""
    return [(_bytes(table.slice(k, BLOCK)),) for k in range(0, table.num_rows, BLOCK)]


def _bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _listed(table: pa.Table) -> Iterator[tuple]:
    """sequence, frame, id, x, y, quality (NaN for NULL) and time of every row."""
    number = lambda c: table[c].to_numpy().tolist()
    whole = lambda c: table[c].to_pylist()
    return zip(whole("sequence_id"), whole("frame_index"), whole("detection_id"), number("x"), number("y"), number("quality_score"), whole("at_ms"))


def _dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their bucket as one block per bucket for every PACK rows or so."""
    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACK:
            yield _by_bucket(held)
            held = []
    if held:
        yield _by_bucket(held)


def _by_bucket(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    table = table.take(pa.array(np.argsort(table["bucket"].to_numpy(), kind="stable")))
    buckets, starts = np.unique(table["bucket"].to_numpy(), return_index=True)
    rows = table.select(ROWS.names).cast(ROWS)
    ends = [*starts[1:].tolist(), rows.num_rows]
    blocks = [_bytes(rows.slice(a, b - a)) for a, b in zip(starts.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "rows"])


def _blocks(rows: list) -> list[tuple]:
    """Rows as elements of a list state: one array per column for every BLOCK rows."""
    return [tuple(list(c) for c in zip(*rows[k : k + BLOCK])) for k in range(0, len(rows), BLOCK)]


def _held(state) -> list[tuple]:
    return [row for block in state.get() for row in zip(*block)]


def _keep(state, rows: list) -> None:
    """Replace a list state; an empty one is cleared, the store refuses empty lists."""
    if rows:
        state.put(_blocks(rows))
    else:
        state.clear()


def track_stream(rows: DataFrame, config: TrackerConfig = TrackerConfig(), time: str | None = None, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Snapshot of all tracks after each closed frame, as an append stream.

    rows(sequence_id, frame_index, detection_id, x, y, quality_score, and optionally closes,
    ends, and the event time named by `time`). `closes` says that frames up to this number
    are complete for the sequence; `ends` that nothing more comes, which closes the last
    frame and drops the sequence's state; a row with a NULL detection_id is only such a
    marker, so that empty frames advance misses too. With `time`, a frame is also closed
    once the watermark (`delay` behind the latest event) has passed its latest row; `delay`
    must not be shorter than a frame lasts. The same rows give
    the same tracks however they are split into files and micro-batches, as long as no row
    comes after its frame was closed. Sequences are dealt over `buckets` keys of state; a task
    holds the open rows of one bucket at a time, so their number should grow with the stream.
    The session needs the state store named in ROCKSDB (`run_available` sees to it).
    """
    given = lambda c, t: F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c)
    at = F.unix_millis(F.col(time)) if time else F.lit(None).cast("long")
    rows = rows.withWatermark(time, delay) if time else rows
    cols = ["sequence_id", "frame_index", "detection_id", "x", "y", "quality_score", given("closes", "int"), given("ends", "boolean"), at.alias("at_ms")]
    bucket = F.pmod(F.xxhash64("sequence_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select(*cols, *([time] if time else []), bucket)
    if not time:  # with it, Spark looks at every row's time
        rows = rows.mapInArrow(_dealt, "bucket int, rows binary")
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=FrameTracker(config, bool(time)), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime" if time else "None"
    )


FRAME_RESULT = "sequence_id string, frame_index int, tp long, fp long, fn long, squared_error double"


PAIR_STATE = ARRAYS("sequence string, frame int, left string, right string, distance double")
SIDE_STATE = ARRAYS("sequence string, frame int, detections long, truths long, latest_ms long")


class FrameMatcher(Bucket):
    """Matches every frame when the watermark has passed its latest row.

    State per bucket of frames: the gated pairs of the open ones, and the numbers of their two
    sides with their latest time, both appended by batch; all of a frame goes with its result.
    The bucket's timer stands at or before the first time at which a frame of it is complete.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pairs = handle.getListState("pairs", PAIR_STATE)
        self.sides = handle.getListState("sides", SIDE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sides, pairs = [], []
        for block in rows:
            for seq, frame, left, right, distance, at in zip(*[block[c].tolist() for c in ("sequence_id", "frame_index", "left_id", "right_id", "distance", "at_ms")]):
                if left is not None and right is not None:
                    pairs.append((seq, int(frame), left, right, distance))
                else:
                    sides.append((seq, int(frame), int(left is not None), int(right is not None), int(at)))
        for block in _blocks(pairs):
            self.pairs.appendValue(block)
        for block in _blocks(_summed(sides)):
            self.sides.appendValue(block)
        if sides:
            before = self._wakes()
            wake = min(r[4] for r in sides)
            self._wake_at(before, wake if before is None else min(before, wake), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        sides = _summed(_held(self.sides))
        done = {r[:2]: r[2:4] for r in sides if r[4] < mark or r[4] <= fired}
        costs: dict = {k: {} for k in done}
        rest = []
        for row in _held(self.pairs):
            if row[:2] in costs:
                costs[row[:2]][row[2], row[3]] = row[4]
            else:
                rest.append(row)
        out = []
        for (seq, frame), (detections, truths) in done.items():
            cost = costs[seq, frame]
            found = solve([(a, b, d) for (a, b), d in cost.items()]) if cost else []
            out.append((seq, frame, len(found), detections - len(found), truths - len(found), float(sum(cost[p] ** 2 for p in found))))
        sides = [r for r in sides if r[:2] not in done]
        _keep(self.pairs, rest)
        _keep(self.sides, sides)
        self._wake_at(self._wakes(), min((r[4] for r in sides), default=None), mark)
        for k in range(0, len(out), BLOCK):
            yield pd.DataFrame(out[k : k + BLOCK], columns=[c.split()[0] for c in FRAME_RESULT.split(", ")])


def _summed(sides: Iterable[tuple]) -> list[tuple]:
    """One row per frame: detections, truths and the latest time."""
    sums: dict = {}
    for seq, frame, detections, truths, latest in sides:
        d, t, at = sums.get((seq, frame), (0, 0, latest))
        sums[seq, frame] = (d + detections, t + truths, max(at, latest))
    return [(*k, *v) for k, v in sums.items()]


def frame_metrics_stream(detections: DataFrame, truth: DataFrame, gate: float = 5.0, time: str = "event_time", delay: str = "1 hour", lasts: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """tp, fp, fn and summed squared distance of every frame, once, as an append stream.

    detections(sequence_id, frame_index, detection_id, x, y, time), truth(sequence_id,
    frame_index, truth_id, x, y, time; what is visible). A stream-stream join on sequence,
    frame and grid cell finds the pairs inside the gate; its state is bounded by the
    watermarks of both sides, as rows of one frame are at most `lasts` apart. A frame is
    matched exactly when the watermark has passed its latest row; frames are dealt over
    `buckets` keys of state, as in `track_stream`. Rows come without regard to order or
    side; `delay` must not be shorter than `lasts`. A frame without any row has no result
    row, and rows without an id or a time are dropped.
    """
    side = lambda df, ident: df.where(F.col(ident).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    left, right = side(detections, "detection_id"), side(truth, "truth_id")
    a, b = gate_cells(left, right, gate, keep=[time])
    b = b.withColumnRenamed(time, "right_time")
    near = F.expr(f"right_time between {time} - interval {lasts} and {time} + interval {lasts}")
    same = [a[c] == b[c] for c in ("sequence_id", "frame_index", "cx", "cy")]
    distance = dist("lx", "ly", "rx", "ry")
    pairs = a.join(b, [*same, near]).where(distance <= float(gate)).select(a["sequence_id"], a["frame_index"], "left_id", "right_id", distance.alias("distance"), time)
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    rows = left.select("sequence_id", "frame_index", F.col("detection_id").cast("string").alias("left_id"), none("string", "right_id"), none("double", "distance"), time)
    rows = rows.unionByName(right.select("sequence_id", "frame_index", none("string", "left_id"), F.col("truth_id").cast("string").alias("right_id"), none("double", "distance"), time)).unionByName(pairs)
    bucket = F.pmod(F.xxhash64("sequence_id", "frame_index"), F.lit(buckets)).cast("int")
    return rows.withColumns({"at_ms": F.unix_millis(time), "bucket": bucket}).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=FrameMatcher(), outputStructType=FRAME_RESULT, outputMode="Append", timeMode="EventTime"
    )


def frame_counts_stream(rows: DataFrame, time: str = "event_time", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Detections per sequence and time window, for monitoring a running stream."""
    return (
        rows.withWatermark(time, delay).groupBy("sequence_id", F.window(time, width))
        .agg(F.count("*").alias("detections"), F.avg("quality_score").alias("mean_quality"))
        .select("sequence_id", F.col("window.start").alias("window_start"), "detections", "mean_quality")
    )


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its rows as a table.

    Rows and the stream's own checkpoint go below `folder`, by default a new one in the
    shared checkpoint folder. 'complete' keeps the last result, 'append' all batches. State
    has as many partitions as `spark.sql.shuffle.partitions` says, but no more than
    CORE_STATES for each core the cluster has when the stream first starts. The session's
    settings are put back once the stream has ended.
    """
    spark = stream.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    states = min(int(spark.conf.get("spark.sql.shuffle.partitions")), CORE_STATES * spark.sparkContext.defaultParallelism)
    settings = {**ROCKSDB, "spark.sql.shuffle.partitions": str(states)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        if mode == "append":
            q = writer.format("parquet").option("path", f"{folder}/rows").start()
        else:
            q = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows")).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
