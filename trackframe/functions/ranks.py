"""Ranks and exact percentiles by cells, so that a task sees the few cells that matter of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackframe.functions.lineage import cut_lineage


def global_rank(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add `rank` = 1, 2, … inside `by` ordered by `order` (unique within `by`).

    Range partitions are written down first so that their numbers stay true; then a
    rank is the size of the earlier partitions plus the place inside one's own.
    """
    parts = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    return bucket_rank(parts, by, "_part", order).drop("_part")


def bucket_rank(df: DataFrame, by: list[str], bucket: str, order: Sequence[str | Column]) -> DataFrame:
    """Add `rank` inside `by`; `bucket` must grow with `order` and split a group well."""
    sizes = df.groupBy(*by, bucket).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy(*by, bucket).orderBy(*order))
    return (
        df.withColumn("_place", place).join(offsets, [*by, bucket])
        .withColumn("rank", F.col("_before") + F.col("_place")).drop("_before", "_place")
    )


#: mantissa bits (52 in all) that one round of `exact_percentiles` looks at; sign and exponent go with the first
DIGITS = (15, 18, 19)


def exact_percentiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), digits: tuple[int, ...] = DIGITS, weight: str | None = None) -> DataFrame:
    """Linearly interpolated percentiles for groups of any size: (by…, p, value).

    Radix selection: a combinable histogram over the leading digits of the values (sign,
    exponent, some bits of the mantissa) says which cell holds each wanted rank. A rank is
    found if it is the first or last of its cell, or the cell holds one distinct value; only
    values of the other cells are counted, written down and taken apart by their next digits.
    All groups and ranks go together. `df` is read once, or twice if a cell stays open; no task
    holds the values of a group, a histogram has at most 2**19 cells after the first round.
    NULLs are left out, NaN is the largest value. `weight` names a column that says how often
    a row counts.
    """
    keys = list(by) or ["_all"]
    src = df.where(F.col(value).isNotNull()).select(*(by or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    rows = src
    wanted, path, found = None, [], None
    for level in range(len(digits)):
        cell = f"c{level}"
        sizes = rows.groupBy(*keys, *path, _digit("v", level, digits).alias(cell)).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        sizes = cut_lineage(sizes.withColumn("upto", F.sum("n").over(W.partitionBy(*keys, *path).orderBy(cell).rowsBetween(W.unboundedPreceding, 0))))
        if wanted is None:
            at = sizes.groupBy(*keys).agg(F.max("upto").alias("total")).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
            at = at.withColumn("at", (F.col("total") - 1) * F.col("p"))
            wanted = at.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).withColumn("base", F.lit(0).cast("long"))
        inside = (F.col("rank") >= F.col("base") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("base") + F.col("upto"))
        hit = sizes.join(wanted, [*keys, *path]).where(inside).withColumn("base", F.col("base") + F.col("upto") - F.col("n"))
        path.append(cell)
        v = F.when((F.col("rank") == F.col("base")) | F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).when(F.col("rank") == F.col("base") + F.col("n") - 1, F.col("hi"))
        hit = hit.select(*keys, *path, "p", "at", "rank", "base", v.alias("v"))
        done = hit.where("v is not null").select(*keys, "p", "at", "rank", "v")
        found = done if found is None else found.unionByName(done)
        wanted = hit.where("v is null").drop("v")
        if wanted.isEmpty():
            break
        wanted = cut_lineage(wanted)
        near = rows.withColumn(cell, _digit("v", level, digits)).join(wanted.select(*keys, *path).distinct(), [*keys, *path], "left_semi")
        rows = cut_lineage(near.groupBy(*keys, *path, "v").agg(F.sum("n").alias("n"))) if level == 0 else near
    out = found.groupBy(*keys, "p").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"), F.first("at").alias("at"))
    return out.select(*by, "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"))


#: distinct values of a group that one task may sort; groups with more go through `exact_percentiles`
GROUP_VALUES = 1 << 16


def part_crowded(counts: DataFrame, by: Sequence[str], crowded: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(counts of the other groups, counts of the groups in `crowded`, or None if there are none). Rows without a key are left out."""
    counts = counts.where(F.concat(*[F.col(k).cast("string") for k in by]).isNotNull())
    crowded = cut_lineage(crowded.select(*by))
    if crowded.isEmpty():
        return counts, None
    return counts.join(crowded, list(by), "left_anti"), counts.join(crowded, list(by), "left_semi")


def ranked_values(p: float, value: str, upto: str, total: str) -> tuple[Column, Column, Column]:
    """The values around rank (total - 1) * p as aggregates (to be used over a window too), and that rank; `upto` counts the rows up to and with a value."""
    at = (F.col(total) - 1) * F.lit(float(p))
    return F.min(F.when(F.col(upto) > F.floor(at), F.col(value))), F.min(F.when(F.col(upto) > F.ceil(at), F.col(value))), at


def between(a: Column, b: Column, at: Column) -> Column:
    return a + (b - a) * (at - F.floor(at))


def counted_percentiles(counts: DataFrame, value: str, weight: str, names: dict[str, float], by: Sequence[str], crowded: DataFrame, digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """(by…, one column a name): the percentiles of `exact_percentiles` from distinct values of a group with their counts.

    One shuffle by group and one sort; `crowded` names the groups with more than GROUP_VALUES
    values, which are taken apart by their digits instead. Groups without a value or key are left out.
    """
    few, many = part_crowded(counts.where(F.col(value).isNotNull()), by, crowded)
    own = W.partitionBy(*by)
    few = few.withColumns({"_upto": F.sum(weight).over(own.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "_total": F.sum(weight).over(own)})
    parts = {n: ranked_values(p, value, "_upto", "_total") for n, p in names.items()}
    ends = [c.alias(f"_{n}{k}") for n, (a, b, _) in parts.items() for k, c in enumerate((a, b))]
    out = few.groupBy(*by, "_total").agg(*ends).select(*by, *[between(F.col(f"_{n}0"), F.col(f"_{n}1"), parts[n][2]).alias(n) for n in names])
    if many is None:
        return out
    long = exact_percentiles(many, value, list(names.values()), by, digits, weight)
    return out.unionByName(long.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in names.items()]))


def _digit(value: str, level: int, digits: tuple[int, ...]) -> Column:
    """Number `level` of the digits by which doubles are ordered; equal values agree in all, and others do not.

    The mantissa is taken apart by products and differences that a double holds exactly. A
    logarithm rounded the wrong way at a power of two leads to the same first digit: one less
    in the exponent is one power of two more in the fraction.
    """
    size = F.abs(value)
    power = F.floor(F.log2(size))
    # In two steps, so that the smallest doubles are not lost in the power itself.
    half = F.floor(power / 2)
    rest = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), power - half) - 1
    digit, first = None, 1 << digits[0]
    for k in range(level + 1):
        rest = rest * (1 << digits[k])
        digit = F.floor(rest)
        rest = rest - digit
    if level == 0:
        digit = (power + 1100) * first + digit + 1
    signed = F.signum(value) * digit
    return F.when(F.col(value) == 0, 0).when(F.isnan(value) | (size == float("inf")), F.when(F.col(value) < 0, -1).otherwise(F.when(F.isnan(value), 2).otherwise(1)) * (5000 * first)).otherwise(signed).cast("long")
