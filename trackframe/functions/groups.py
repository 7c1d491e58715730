"""Run a Python function over key-sorted partitions, one call per key group.

One shuffle on the key and one Arrow stream per partition: far cheaper than one
grouped-map call per key when there are many small groups. A group that spans Arrow
batches is carried over, so callers must bound the size of a group beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash partitions by key, as many as the session's shuffle setting says.

    A fixed number keeps adaptive execution from merging them by size: rows are small
    here, the Python work behind them is not.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def map_key_batches(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema) -> DataFrame:
    """fn(batch, starts) -> DataFrame, over batches of whole key groups.

    `starts` are the row numbers at which groups begin, so that fn can work on many
    small groups at once with vectorised code.
    """
    ordered = spread(df, keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, starts in whole_groups(batches, keys):
            yield fn(whole, starts)

    return ordered.mapInPandas(run, schema)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Key-sorted batches cut anew so that no group spans two of them, with the row numbers at which groups begin."""
    held: list[pd.DataFrame] = []  # the pieces of a group that may go on; each row is joined once
    for batch in batches:
        if not len(batch):
            continue
        starts = group_starts(batch, keys)
        goes_on = bool(held) and all(_same(held[-1][k].iloc[-1], batch[k].iloc[0]) for k in keys)
        if len(starts) == 1 and (goes_on or not held):
            held.append(batch)
            continue
        cut = int(starts[-1])
        whole = pd.concat([*held, batch.iloc[:cut]], ignore_index=True) if held else batch.iloc[:cut]
        held = [batch.iloc[cut:]]
        yield whole, group_starts(whole, keys)
    if held:
        yield pd.concat(held, ignore_index=True), np.array([0])


def map_key_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: T.StructType) -> DataFrame:
    """fn(key_tuple, columns: dict[str, np.ndarray]) -> list of output tuples, per group."""
    names = schema.names

    def each(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        cols = {c: batch[c].to_numpy() for c in batch.columns}
        ends = np.append(starts[1:], len(batch))
        rows = []
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            key = tuple(cols[k][lo] for k in keys)
            rows.extend(fn(key, {c: v[lo:hi] for c, v in cols.items()}))
        return pd.DataFrame(rows, columns=names)

    return map_key_batches(df, keys, order, each, schema)


def _same(a, b) -> bool:
    return a == b or a is None and b is None


def group_starts(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins in a key-sorted batch."""
    change = np.zeros(len(batch), dtype=bool)
    change[0] = True
    for k in keys:
        v = batch[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)
