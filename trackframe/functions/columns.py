"""Column expressions shared by every operator. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def dist(ax, ay, bx, by) -> Column:
    """Euclidean distance written so that other SQL engines give the same bits."""
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return F.sqrt(dx * dx + dy * dy)


def finite(c) -> Column:
    """True only for a non-null, non-NaN, non-infinite number."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def ratio(num, den) -> Column:
    """num / den, NULL when the denominator is zero."""
    num, den = col(num), col(den)
    return F.when(den != 0, num.cast("double") / den)


def f1_counts(tp, fp, fn) -> Column:
    """2tp / (2tp + fp + fn), NULL when undefined."""
    return ratio(2 * col(tp), 2 * col(tp) + col(fp) + col(fn))


def f1_ratios(precision, recall) -> Column:
    """Harmonic mean; 0 when both are 0, NULL when either is NULL."""
    p, r = col(precision), col(recall)
    return F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).when(
        p + r <= 0, F.lit(0.0)
    ).otherwise(2.0 * p * r / (p + r))


def snap_zero(c, floor: float = 1e-12) -> Column:
    c = col(c)
    return F.when(c < floor, F.lit(0.0)).otherwise(c)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def reason_array(pairs) -> Column:
    """Ordered array of the codes whose condition holds; pairs = [(cond, code)]."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]))


def reason_map(pairs) -> Column:
    """Map of name -> message for the conditions that hold; empty map when none."""
    flat = []
    for cond, name, message in pairs:
        flat += [F.lit(name), F.when(cond, F.lit(message))]
    return F.map_filter(F.create_map(*flat), lambda _k, v: v.isNotNull())


def id_token(*parts) -> Column:
    """First 16 hex digits of sha256 over the parts joined by '/'."""
    return F.substring(F.sha2(F.concat_ws("/", *[col(p) for p in parts]), 256), 1, 16)


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value evaluated once a row, also where fn uses it inside a lambda over many elements."""
    return F.transform(F.array(value), fn)[0]
