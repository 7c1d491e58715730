"""DataFrame helpers of this subpackage: tables, held-out rows, skew-proof joins, bitmaps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions.lineage import cut_lineage, ensure_checkpoint_dir

SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 5, is 0; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def salted_join(rows: DataFrame, facts: DataFrame, key: str, by: Column, how: str = "left") -> DataFrame:
    """rows joined with facts (one row a key) with every key's rows spread over SALTS places.

    The small side is copied SALTS times, so that a key with a third of all rows becomes
    SALTS even groups. `by` gives the row-dependent number that the salt comes from.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def sample_share(rows: DataFrame, bound: int, key: Column) -> DataFrame:
    """All rows if they are at most `bound`, else a hash sample of about `bound` rows. Reruns agree."""
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * bound / n))


BITS = 26
#: words of a bitmap travel to the driver in pages of 2**PAGE
PAGE = 10


def bitmap(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A membership filter of fixed size: 2**bits bits whatever the number of values.

    Values set the bit of their lowest `bits` bits. The words are combined in Spark and only
    the finished filter, never a value, comes to the driver (8 MB at 26 bits). With more
    values it lets more others through; it never loses one, so it may only save work.
    """
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        values.select(F.shiftrightunsigned(at, 6).cast("int").alias("word"), F.pow(F.lit(2.0), at.bitwiseAND(F.lit(31))).cast("long").alias("low"), (at.bitwiseAND(F.lit(63)) >= 32).alias("high"))
        .groupBy("word").agg(F.bit_or(F.when(~F.col("high"), F.col("low")).otherwise(0)).alias("low"), F.bit_or(F.when(F.col("high"), F.col("low")).otherwise(0)).alias("high"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            word, low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            value = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
            for page in np.unique(word >> PAGE).tolist():
                own = word >> PAGE == page
                pages.setdefault(page, np.zeros(1 << PAGE, np.uint64))[word[own] & ((1 << PAGE) - 1)] = value[own]
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([p.tobytes() for p in pages.values()], pa.binary())], ["page", "bits"])

    packed = words.repartition(16, F.shiftright("word", PAGE)).mapInArrow(pack, "page int, bits binary")
    out = np.zeros(max(1 << (bits - 6), 1 << PAGE), np.uint64)
    for row in packed.collect():
        out[row["page"] << PAGE : (row["page"] + 1) << PAGE] = np.frombuffer(row["bits"], np.uint64)
    return out[: 1 << (bits - 6)]


def in_bitmap(filter_words: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(np.uint64) & np.uint64(len(filter_words) * 64 - 1)
    return (filter_words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet below the shared checkpoint folder and read back: lineage is cut, columns are packed.

    For tables of many small rows, which a checkpoint would write row by row.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shared:
    """A broadcast that carries the code of what it holds, as shipped functions do. Only for things of bounded size."""

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self) -> Any:
        return cloudpickle.loads(self.bytes.value)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


__all__ = ["BITS", "SALTS", "Shared", "bitmap", "cut_lineage", "held_out", "in_bitmap", "salted_join", "sample_share", "signed", "stored", "table"]
