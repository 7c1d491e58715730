"""Mixing sources to target weights with Pareto order sampling.

Targets are filled like water: every source gets its share by weight but never more than
`most` times its words; what is over is shared among the others by weight. Inside a source the
same rule hands the target to size classes, whose expected copies a document grow with the
square root of size (TILT). A document's expected copies split into whole copies, which are
certain, and a rest p, its inclusion probability. Documents are ranked by the odds of a
random number over the odds of p, and the source takes them in that order until its fixed
number of words is reached; the last document gives only the words that are missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.frames import cut_lineage, salted_join

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
TILT = 0.5
#: cells of the rank scale, refined once: a task orders a millionth of a source at a time
CELLS = 1024

WORD = r"[^\x20\x09-\x0D]+"


def fill(rows: DataFrame, within: list[str], total: Column, weight: Column, cap: Column, order: list[str], name: str) -> DataFrame:
    """rows with `name`: total shared by weight inside each `within`, none above its cap.

    Rows in order of cap / weight: the first k are at their caps when the level that the
    others would reach, (total - caps so far) / (weights left), is not below the next cap.
    One row a source or size class: a short list.
    """
    ranked = Window.partitionBy(*within).orderBy("_ratio", *order)
    group = Window.partitionBy(*within)
    rows = rows.withColumn("_w", weight.cast("double")).withColumn("_cap", cap.cast("double")).withColumn("_total", total.cast("double"))
    rows = rows.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(F.lit(0.0)))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_left", F.sum("_w").over(ranked.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_level", F.when(F.col("_left") > 0, (F.col("_total") - F.col("_caps")) / F.col("_left")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("_first", F.row_number().over(ranked))
    rows = rows.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_first", "_level"))).over(group))
    level = F.coalesce(F.col("_at")["_level"], F.lit(float("inf")))
    return rows.withColumn(name, F.when(F.col("_ratio") <= level, F.col("_cap")).otherwise(level * F.col("_w"))).drop("_w", "_cap", "_total", "_ratio", "_caps", "_left", "_level", "_first", "_at")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest: the same in every run and engine."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_key, source_size, target of each source, from sizes(source_key, size). Keys sort by code point, null last."""
    sources = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_key")) - 1
    sources = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))).withColumn("all_size", F.sum("source_size").over(everything))
    return fill(sources.withColumn("one", F.lit(0)), ["one"], F.col("all_size") * share, F.col("weight"), F.col("source_size") * most, ["source_key"], "target").select("source_key", "source_size", "target")


def within_cell(rows: DataFrame, cell: list[str], room: Column) -> DataFrame:
    """Per (source, cell...) the words in earlier cells, for the one cell in which the room runs out."""
    hist = rows.groupBy(*cell).agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    upto = Window.partitionBy(*cell[:-1]).orderBy(cell[-1])
    hist = hist.withColumn("_upto", F.sum("words").over(upto))
    return hist.withColumn("_before", F.col("_upto") - F.col("words"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, tilt: float = TILT, seed: str = "mix") -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, expected, whole, p, taken.

    taken counts words with repeats: whole * size, plus size if the document is drawn, plus
    the missing words if it is the last one drawn. Null and empty texts have size 0 and take
    0. Rows with equal id and size share their random number; equal ranks are ordered by id
    and then drawn together. An empty table gives no rows.
    """
    source_key = F.coalesce(F.concat(F.lit("a"), F.col(source).cast("string")), F.lit("b"))
    sizes = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), source_key.alias("source_key"), word_count(F.col(text)).alias("size"))
    sizes = cut_lineage(sizes.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) + 1e-9).cast("int")).otherwise(-1)).withColumn("u", uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)))
    targets = source_targets(sizes, weights, share, most)
    classes = sizes.groupBy("source_key", "class").agg(F.sum("size").alias("class_size"))
    classes = classes.join(targets, "source_key")
    classes = fill(classes, ["source_key"], F.col("target"), F.col("class_size") * F.pow(F.lit(2.0), F.col("class") * tilt), F.col("class_size") * most, ["class"], "class_target")
    expected = F.when(F.col("class_size") > 0, F.least(F.col("class_target") / F.col("class_size"), F.lit(float(most)))).otherwise(0.0)
    classes = classes.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole"))
    certain = F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("source_key"))
    classes = cut_lineage(classes.withColumn("room", F.floor(F.col("target") + 1e-6).cast("long") - certain).drop("class_target", "class_size"))

    rows = salted_join(sizes.withColumn("group", F.concat_ws(":", "source_key", "class")), classes.withColumn("group", F.concat_ws(":", "source_key", "class")).drop("source_key", "class"), "group", F.col("doc_id")).drop("group")
    rank = F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + F.col("p") * (1 - F.col("u")))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, rank).otherwise(F.lit(1.0)))
    rows = cut_lineage(rows.withColumn("cell", F.least(F.floor(F.col("rank") * CELLS), F.lit(CELLS - 1)).cast("int")).withColumn("fine", F.least(F.floor((F.col("rank") * CELLS - F.col("cell")) * CELLS), F.lit(CELLS - 1)).cast("int")))

    coarse = within_cell(rows, ["source_key", "cell"], F.col("room"))
    last = cut_lineage(coarse.where((F.col("_before") < F.col("room")) & (F.col("_upto") >= F.col("room"))).select("source_key", F.col("cell").alias("last_cell"), F.col("_before").alias("before_cell")))
    placed = salted_join(rows, last, "source_key", F.col("doc_id"))
    edge = placed.where(F.col("cell") == F.col("last_cell"))
    fine = within_cell(edge.withColumn("room", F.col("room") - F.col("before_cell")), ["source_key", "fine"], F.col("room"))
    last_fine = cut_lineage(fine.where((F.col("_before") < F.col("room")) & (F.col("_upto") >= F.col("room"))).select("source_key", F.col("fine").alias("last_fine"), F.col("_before").alias("before_fine")))
    placed = salted_join(placed, last_fine, "source_key", F.col("doc_id"))

    inside = F.col("cell") * CELLS + F.col("fine")
    final = F.col("last_cell") * CELLS + F.col("last_fine")
    upto = Window.partitionBy("source_key").orderBy("rank", "doc_id")
    at_edge = placed.where(inside == final).withColumn("left", F.col("room") - F.col("before_cell") - F.col("before_fine") - (F.sum("size").over(upto) - F.sum("size").over(Window.partitionBy("source_key", "rank", "doc_id"))))
    same = F.count("*").over(Window.partitionBy("source_key", "rank", "doc_id"))
    drawn = F.when(F.col("left") > 0, F.least(F.col("size"), F.floor(F.col("left") / same).cast("long"))).otherwise(0)
    at_edge = at_edge.withColumn("drawn", drawn).drop("left")
    others = placed.where(final.isNull() | (inside != final)).withColumn("drawn", F.when(inside < final, F.col("size")).otherwise(0))
    return at_edge.unionByName(others).select("doc_id", "source", "size", "source_size", "target", "expected", "whole", "p", (F.col("whole") * F.col("size") + F.col("drawn")).cast("long").alias("taken"))
