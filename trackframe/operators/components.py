"""Connected components over any edge list, by label propagation with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.lineage import cut_lineage


def connected_components(
    nodes: DataFrame,
    edges: DataFrame,
    keys: list[str],
    node: str = "node",
    src: str = "src",
    dst: str = "dst",
    max_rounds: int = 200,
) -> DataFrame:
    """Label every node of `nodes` with the smallest node id it is connected to.

    Each round takes the smallest label among a node's neighbours (a combinable
    aggregate, so a hub costs no more than its partial sums) and then jumps to the
    label of that label, which makes the number of rounds grow with the logarithm of
    the longest path. Labels are cut into the checkpoint folder every round; the loop
    ends when no label changes and raises if it does not end.
    """
    both = edges.select(*keys, F.col(src).alias("a"), F.col(dst).alias("b"))
    both = both.unionByName(edges.select(*keys, F.col(dst).alias("a"), F.col(src).alias("b")))
    both = cut_lineage(both.where("a <> b").distinct())
    labels = cut_lineage(nodes.select(*keys, F.col(node).alias("a"), F.col(node).alias("label")))
    for _ in range(max_rounds):
        lowest = (
            both.join(labels.select(*keys, F.col("a").alias("b"), F.col("label").alias("near")), [*keys, "b"])
            .groupBy(*keys, "a")
            .agg(F.min("near").alias("near"))
        )
        step = labels.join(lowest, [*keys, "a"], "left").select(
            *keys, "a", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        target = step.select(*keys, F.col("a").alias("label"), F.col("label").alias("jump"))
        step = step.join(target, [*keys, "label"]).select(*keys, "a", "was", F.col("jump").alias("label"))
        step = cut_lineage(step)
        labels = step.drop("was")
        if step.where("label <> was").isEmpty():
            return labels.select(*keys, F.col("a").alias(node), F.col("label").alias("component"))
    raise RuntimeError(f"labels still changing after {max_rounds} rounds")
