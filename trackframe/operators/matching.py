"""Distance joins and exact one-to-one matching inside frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackframe.functions.assignment import solve
from trackframe.functions.columns import dist
from trackframe.functions.groups import map_key_groups
from trackframe.functions.lineage import cut_lineage
from trackframe.operators.components import connected_components

FRAME = ["sequence_id", "frame_index"]

# Edges of one conflict group that one task may hold (about 200 MB of Python objects).
GROUP_EDGES = 500_000


@dataclass(frozen=True)
class Matching:
    """Pairs plus the rows of either side left without a partner."""

    pairs: DataFrame
    unmatched_left: DataFrame
    unmatched_right: DataFrame


def gate_cells(
    left: DataFrame,
    right: DataFrame,
    gate: float,
    left_id: str = "detection_id",
    right_id: str = "truth_id",
    left_xy: tuple[str, str] = ("x", "y"),
    right_xy: tuple[str, str] = ("x", "y"),
    keys: list[str] = FRAME,
    cell_gates: float = 4.0,
    keep: list[str] = [],
) -> tuple[DataFrame, DataFrame]:
    """Both sides with their grid cells (cx, cy), the right one copied to all cells its gate touches; `keep` names more columns."""
    cell = float(gate) * cell_gates
    if gate <= 0:
        raise ValueError("gate must be positive")

    def cells(c, slack):
        lo, hi = F.floor((c - slack) / cell), F.floor((c + slack) / cell)
        return F.sequence(lo, hi)

    lx, ly = left_xy
    rx, ry = right_xy
    a = left.select(
        *keys, *keep, F.col(left_id).alias("left_id"), F.col(lx).alias("lx"), F.col(ly).alias("ly"),
        F.floor(F.col(lx) / cell).alias("cx"), F.floor(F.col(ly) / cell).alias("cy"),
    )
    # A hair more than the gate keeps rounding at a cell edge from losing a pair.
    slack = float(gate) * (1 + 1e-9) + 1e-9
    b = (
        right.select(*keys, *keep, F.col(right_id).alias("right_id"), F.col(rx).alias("rx"), F.col(ry).alias("ry"))
        .withColumn("cx", F.explode(cells(F.col("rx"), slack)))
        .withColumn("cy", F.explode(cells(F.col("ry"), slack)))
    )
    return a, b


def gated_pairs(
    left: DataFrame,
    right: DataFrame,
    gate: float,
    left_id: str = "detection_id",
    right_id: str = "truth_id",
    left_xy: tuple[str, str] = ("x", "y"),
    right_xy: tuple[str, str] = ("x", "y"),
    keys: list[str] = FRAME,
    cell_gates: float = 4.0,
) -> DataFrame:
    """All (left, right) pairs of one frame at Euclidean distance <= gate.

    An equi join on square cells of `cell_gates` gates: every right point is copied
    to each cell its gate box touches (2.25 on average), every left point stays in
    its own, so a pair meets exactly once and a crowded frame spreads over its cells.
    Size estimates leave out what an explode multiplies, so the copies are never broadcast.
    """
    a, b = gate_cells(left, right, gate, left_id, right_id, left_xy, right_xy, keys, cell_gates)
    return (
        a.join(b.hint("merge"), [*keys, "cx", "cy"])
        .withColumn("distance", dist("lx", "ly", "rx", "ry"))
        .where(F.col("distance") <= float(gate))
        .drop("cx", "cy")
    )


def one_to_one(
    edges: DataFrame,
    keys: list[str] = FRAME,
    cost: str = "distance",
    frames_are_small: bool = True,
    group_edges: int = GROUP_EDGES,
) -> DataFrame:
    """Exact assignment over an edge list (left_id, right_id, cost) per frame.

    Most pairs first, then least total cost. Right vertices whose partners have no
    other choice are settled by a window over that vertex; what stays contested goes
    through the exact kernel, one frame at a time.

    frames_are_small says that no frame keeps more than `group_edges` contested edges.
    When the caller cannot promise that, pass False: frames above the limit are cut
    into the connected components of their contested graph and solved one component
    at a time. Nothing is dropped or capped.
    """
    edges = edges.select(*keys, "left_id", "right_id", F.col(cost).alias("cost"))
    by_left = W.partitionBy(*keys, "left_id")
    by_right = W.partitionBy(*keys, "right_id")
    known = (
        edges.withColumn("choices", F.count("*").over(by_left))
        .withColumn("busiest", F.max("choices").over(by_right))
        .withColumn("rank", F.row_number().over(by_right.orderBy("cost", "left_id")))
    )
    settled = known.where("busiest = 1 and rank = 1").select(*keys, "left_id", "right_id", "cost")
    contested = known.where("busiest > 1").select(*keys, "left_id", "right_id", "cost")
    if frames_are_small:
        return settled.unionByName(_solve_groups(contested, keys, keys))

    contested = cut_lineage(contested)
    sizes = contested.groupBy(*keys).count()
    crowded = cut_lineage(sizes.where(F.col("count") > group_edges).select(*keys))
    if crowded.isEmpty():
        return settled.unionByName(_solve_groups(contested, keys, keys))
    calm = contested.join(crowded, keys, "left_anti")
    dense = contested.join(crowded, keys, "left_semi")
    out = settled.unionByName(_solve_groups(calm, keys, keys))

    def vertex(side):
        ident = F.col("left_id" if side == 0 else "right_id").cast("string")
        return F.struct(F.lit(side).alias("side"), ident.alias("id"))

    links = dense.select(*keys, vertex(0).alias("src"), vertex(1).alias("dst"))
    nodes = links.select(*keys, F.col("src").alias("node")).union(links.select(*keys, F.col("dst").alias("node"))).distinct()
    parts = connected_components(nodes, links, keys).where("node.side = 0")
    dense = cut_lineage(
        dense.join(
            parts.select(*keys, F.col("node.id").alias("left_text"), F.to_json("component").alias("component")),
            [dense[k] == parts[k] for k in keys] + [F.col("left_id").cast("string") == F.col("left_text")],
        ).select(*[dense[k] for k in keys], "component", "left_id", "right_id", "cost")
    )
    return out.unionByName(_solve_groups(dense, [*keys, "component"], keys))


def _solve_groups(contested: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    fields = contested.select(*keys, "left_id", "right_id", "cost").schema
    width = len(keys)

    def fn(key, cols):
        left, right, cost = cols["left_id"].tolist(), cols["right_id"].tolist(), cols["cost"].tolist()
        price = {(a, b): c for a, b, c in zip(left, right, cost)}
        return [(*key[:width], a, b, price[a, b]) for a, b in solve(list(zip(left, right, cost)))]

    return map_key_groups(contested, group, ["left_id", "right_id"], fn, fields)


def frames_fit(left: DataFrame, right: DataFrame, keys: list[str] = FRAME, limit: int = GROUP_EDGES) -> bool:
    """True if no frame can hold more than `limit` edges, from row counts alone."""
    a = left.groupBy(*keys).agg(F.count("*").alias("a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("b"))
    return a.join(b, keys).where(F.col("a") * F.col("b") > limit).isEmpty()


def match_points(
    pred: DataFrame,
    truth: DataFrame,
    gate: float,
    pred_id: str = "detection_id",
    truth_id: str = "truth_id",
    pred_xy: tuple[str, str] = ("x", "y"),
    truth_xy: tuple[str, str] = ("x", "y"),
    keys: list[str] = FRAME,
    frames_are_small: bool | None = None,
    group_edges: int = GROUP_EDGES,
    edges: DataFrame | None = None,
) -> Matching:
    """One-to-one gated matching: most pairs, then least total distance.

    Inclusive gate. Equal-cost optima are decided by the order of the ids.
    frames_are_small=None counts rows per frame first (one small job); pass True when
    the producer already bounds a frame, e.g. a detector with a candidate cap. `edges` are
    the gated pairs of both sides where the caller has them already.
    """
    if frames_are_small is None:
        frames_are_small = frames_fit(pred, truth, keys, group_edges)
    if edges is None:
        edges = gated_pairs(pred, truth, gate, pred_id, truth_id, pred_xy, truth_xy, keys)
    pairs = one_to_one(edges, keys, "distance", frames_are_small, group_edges).select(
        *keys, F.col("left_id").alias(pred_id), F.col("right_id").alias(truth_id), F.col("cost").alias("distance")
    )
    return Matching(
        pairs,
        pred.join(pairs.select(*keys, pred_id), [*keys, pred_id], "left_anti"),
        truth.join(pairs.select(*keys, truth_id), [*keys, truth_id], "left_anti"),
    )


def tag_matches(
    pred: DataFrame,
    truth: DataFrame,
    gate: float,
    pred_id: str = "detection_id",
    truth_id: str = "truth_id",
    keys: list[str] = FRAME,
    **options,
) -> DataFrame:
    """One row per outcome: kind 'tp', 'fp' or 'fn', ids of the ends that exist."""
    m = match_points(pred, truth, gate, pred_id, truth_id, keys=keys, **options)
    none_pred = F.lit(None).cast(pred.schema[pred_id].dataType).alias(pred_id)
    none_truth = F.lit(None).cast(truth.schema[truth_id].dataType).alias(truth_id)
    no_distance = F.lit(None).cast("double").alias("distance")
    tp = m.pairs.select(*keys, pred_id, truth_id, "distance", F.lit("tp").alias("kind"))
    seen = m.pairs.select(*keys, pred_id, truth_id, "distance")
    left = pred.select(*keys, pred_id).join(seen, [*keys, pred_id], "left_anti")
    right = truth.select(*keys, truth_id).join(seen, [*keys, truth_id], "left_anti")
    return tp.unionByName(
        left.select(*keys, pred_id, none_truth, no_distance, F.lit("fp").alias("kind"))
    ).unionByName(right.select(*keys, none_pred, truth_id, no_distance, F.lit("fn").alias("kind")))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs with exclusive upper bounds; NULL, so no match, for two boxes without area."""
    f = lambda s, n: F.col(f"{s}.{n}")
    w = F.greatest(F.least(f(a, "x1"), f(b, "x1")) - F.greatest(f(a, "x0"), f(b, "x0")), F.lit(0.0))
    h = F.greatest(F.least(f(a, "y1"), f(b, "y1")) - F.greatest(f(a, "y0"), f(b, "y0")), F.lit(0.0))
    area = lambda s: (f(s, "x1") - f(s, "x0")) * (f(s, "y1") - f(s, "y0"))
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def overlapping_boxes(
    pred: DataFrame, truth: DataFrame, iou_gate: float, keys: list[str] = FRAME, cell: float = 64.0
) -> DataFrame:
    """Box pairs of one frame with IoU >= gate, found through shared grid cells.

    Both boxes are copied to the cells they touch; a pair is kept only in the cell
    that holds the upper left corner of the intersection, so it comes out once.
    """

    def spread(df, name, ident):
        out = df.select(*keys, F.col(ident).alias(f"{name}_id"), F.col("box").alias(name))
        for axis in ("x", "y"):
            out = out.withColumn(
                f"c{axis}",
                F.explode(F.sequence(F.floor(F.col(f"{name}.{axis}0") / cell), F.floor(F.col(f"{name}.{axis}1") / cell))),
            )
        return out

    home = lambda axis: F.floor(F.greatest(F.col(f"left.{axis}0"), F.col(f"right.{axis}0")) / cell)
    joined = spread(pred, "left", "detection_id").join(spread(truth, "right", "truth_id").hint("merge"), [*keys, "cx", "cy"])
    return (
        joined.where((F.col("cx") == home("x")) & (F.col("cy") == home("y")))
        .withColumn("iou", iou("left", "right"))
        .where(F.col("iou") >= iou_gate)
        .select(*keys, "left_id", "right_id", "iou")
    )


def match_boxes(
    pred: DataFrame, truth: DataFrame, iou_gate: float = 0.5, keys: list[str] = FRAME, frames_are_small: bool | None = None
) -> Matching:
    """One-to-one box matching: most pairs, then most summed IoU."""
    if frames_are_small is None:
        frames_are_small = frames_fit(pred, truth, keys, GROUP_EDGES)
    edges = overlapping_boxes(pred, truth, iou_gate, keys).withColumn("cost", 1 - F.col("iou"))
    pairs = one_to_one(edges, keys, "cost", frames_are_small).select(
        *keys, F.col("left_id").alias("detection_id"), F.col("right_id").alias("truth_id"), (1 - F.col("cost")).alias("iou")
    )
    return Matching(
        pairs,
        pred.join(pairs.select(*keys, "detection_id"), [*keys, "detection_id"], "left_anti"),
        truth.join(pairs.select(*keys, "truth_id"), [*keys, "truth_id"], "left_anti"),
    )


def nearest_within(
    points: DataFrame,
    targets: DataFrame,
    gate: float,
    point_id: str = "truth_id",
    target_id: str = "detection_id",
    point_xy: tuple[str, str] = ("x", "y"),
    target_xy: tuple[str, str] = ("x", "y"),
    keys: list[str] = FRAME,
) -> DataFrame:
    """Every point with its nearest target inside the gate, or NULL."""
    pairs = gated_pairs(points, targets, gate, point_id, target_id, point_xy, target_xy, keys)
    best = pairs.groupBy(*keys, F.col("left_id").alias(point_id)).agg(
        F.min(F.struct("distance", "right_id")).alias("best")
    )
    return points.join(best, [*keys, point_id], "left").select(
        *points.columns, F.col("best.right_id").alias(target_id), F.col("best.distance").alias("distance")
    )


def ambiguous_truth(truth: DataFrame, radius: float = 1.0, keys: list[str] = FRAME) -> DataFrame:
    """Truth rows with another truth of the same frame at distance <= radius.

    Exact copies of a position are found by counting, never by pairing them up; only
    distinct positions enter the distance join.
    """
    spots = truth.groupBy(*keys, "x", "y").agg(F.count("*").alias("copies"))
    spots = spots.withColumn("spot", F.struct("x", "y"))
    near = (
        gated_pairs(spots, spots, radius, "spot", "spot", keys=keys)
        .where("left_id <> right_id")
        .select(*keys, F.col("left_id.x").alias("x"), F.col("left_id.y").alias("y"))
    )
    crowd = spots.where("copies > 1").select(*keys, "x", "y").unionByName(near).distinct()
    return truth.join(crowd, [*keys, "x", "y"], "left_semi").select(*truth.columns)


def attach_owner(detections: DataFrame, points: DataFrame) -> DataFrame:
    """Detection rows with the track that observed them, NULL when there is none."""
    owners = points.where("point_type = 'observed'").select("sequence_id", "detection_id", "track_id")
    return detections.join(owners, ["sequence_id", "detection_id"], "left")


def compare_matches(run_a: DataFrame, run_b: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Matched truths of two runs: retained, recovered (only b) or lost (only a)."""
    a = run_a.select(*keys, "truth_id").distinct().withColumn("in_a", F.lit(True))
    b = run_b.select(*keys, "truth_id").distinct().withColumn("in_b", F.lit(True))
    both = a.join(b, [*keys, "truth_id"], "full_outer")
    return both.select(
        *keys, "truth_id",
        F.when(F.col("in_a") & F.col("in_b"), "retained").when(F.col("in_b"), "recovered").otherwise("lost").alias("change"),
    )


def join_scores(detections: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach scores only where a sequence's whole assessment is sound.

    Sound: every score row names an existing detection, agrees on the frame, lies in
    [0, 1] and is not repeated. One bad row makes the sequence's scores unavailable.
    """
    s = scores.groupBy("sequence_id", "detection_id").agg(
        F.count("*").alias("copies"), F.first("frame_index").alias("score_frame"), F.first("score").alias("score")
    )
    checked = s.join(
        detections.select("sequence_id", "detection_id", "frame_index"), ["sequence_id", "detection_id"], "left"
    ).withColumn(
        "sound",
        F.coalesce(
            (F.col("copies") == 1) & (F.col("score_frame") == F.col("frame_index")) & F.col("score").between(0.0, 1.0)
            & ~F.isnan("score"),
            F.lit(False),
        ),
    )
    verdict = checked.groupBy("sequence_id").agg(F.bool_and("sound").alias("available"))
    usable = checked.join(verdict.where("available"), "sequence_id", "left_semi").select("sequence_id", "detection_id", "score")
    return (
        detections.join(usable, ["sequence_id", "detection_id"], "left")
        .join(verdict, "sequence_id", "left")
        .withColumn("assessment", F.when(F.col("available"), "experimental").otherwise("unavailable"))
        .withColumn("category", score_band("score"))
        .drop("available")
    )


def score_band(score: str) -> Column:
    c = F.col(score)
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium").when(c.isNotNull(), "low")


def join_labels(predictions: DataFrame, labels: DataFrame, frames_per_sequence: int = 5) -> tuple[DataFrame, DataFrame]:
    """Inner join of frame rows by (split, sequence_id, frame_index) plus error rows.

    A sequence with a repeated or missing frame on either side is an error as a whole.
    """
    key = ["split", "sequence_id"]

    def shape(df, side):
        return (
            df.groupBy(*key, "frame_index").count()
            .groupBy(*key).agg(F.count("*").alias(f"{side}_frames"), F.max("count").alias(f"{side}_copies"))
        )

    p, t = shape(predictions, "predicted"), shape(labels, "labelled")
    n = F.lit(frames_per_sequence)
    state = p.join(t, key, "left").select(
        *key,
        F.when(F.col("predicted_copies") > 1, "duplicate_prediction_frame")
        .when(F.col("predicted_frames") != n, "incomplete_prediction_sequence")
        .when(F.col("labelled_frames").isNull(), "missing_labels")
        .when(F.col("labelled_copies") > 1, "duplicate_label_frame")
        .when(F.col("labelled_frames") != n, "incomplete_label_sequence").alias("error"),
    )
    good = state.where("error is null").select(*key)
    joined = predictions.join(good, key, "left_semi").join(labels, [*key, "frame_index"])
    return joined, state.where("error is not null")


def as_of_gap_estimate(
    points: DataFrame, transforms: DataFrame, width: float, height: float
) -> DataFrame:
    """Display estimate for frames a track missed between two observations.

    The latest earlier observation is carried forward and mapped back to raw pixels
    of the missing frame; frames without a usable transform and positions outside
    the image are dropped.
    """
    track = ["sequence_id", "track_id"]
    seen = points.where("point_type = 'observed'").select(
        *track, "frame_index", F.struct("x_reference_px", "y_reference_px").alias("spot")
    )
    order = W.partitionBy(*track).orderBy("frame_index")
    gaps = (
        seen.withColumn("next_frame", F.lead("frame_index").over(order))
        .where("next_frame > frame_index + 1")
        .select(*track, "spot", F.explode(F.expr("sequence(frame_index + 1, next_frame - 1)")).alias("frame_index"))
    )
    usable = transforms.where("status <> 'failed' and tx is not null").select("sequence_id", "frame_index", "tx", "ty")
    placed = gaps.join(usable, ["sequence_id", "frame_index"]).select(
        *track, "frame_index",
        (F.col("spot.x_reference_px") - F.col("tx")).alias("x_raw_px"),
        (F.col("spot.y_reference_px") - F.col("ty")).alias("y_raw_px"),
    )
    return placed.where(
        (F.col("x_raw_px") >= -0.5) & (F.col("x_raw_px") < width - 0.5)
        & (F.col("y_raw_px") >= -0.5) & (F.col("y_raw_px") < height - 0.5)
    )
