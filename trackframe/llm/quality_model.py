"""Quality score of documents: boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm import boosting
from trackframe.llm.frames import Shared, cut_lineage, held_out, sample_share
from trackframe.llm.textbytes import Powers, distinct_by_row, gram_hashes, per_row, slices, texts, utf8, word_hashes

#: at most about so many labelled rows are used to fit the trees
LABELLED = 20_000
THRESHOLD = 0.3

NAMES = (
    "log_words", "word_bytes", "symbols", "punctuation", "upper", "digits", "distinct", "top_word", "repeated_grams", "repeated_next",
    "repeated_lines", "line_words", "exclaim", "beyond_ascii", "short_words", "longest_word", "bars", "marked_words",
)


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


SYMBOL, MARK, UPPER, LOWERCASE, DIGIT = _class(b"#*$%&|<>"), _class(b".,;:!?\"'()-"), _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789")
EXCLAIM, BAR, BEYOND = _class(b"!"), _class(b"|"), _class(bytes(range(128, 256)))


def statistics(column: pa.Array, powers: Powers) -> np.ndarray:
    """One row of NAMES a text; all shares of an empty text are 0."""
    data, offsets = utf8(column)
    n = len(column)

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    starts, ends, row, words = word_hashes(data, offsets, powers)
    n_words = per_row(row, n).astype(float)
    of_words = np.maximum(n_words, 1)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    length = (ends - starts).astype(float)
    seen, _, times = distinct_by_row(row, words)
    top = np.zeros(n)
    np.maximum.at(top, seen, times)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    grams, gram_row = gram_hashes(words, row, 3)
    g_row, _, g_times = distinct_by_row(gram_row, grams)
    same_next = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    s2, e2, line_row, lines = word_hashes(data, offsets, powers, data != 10)
    l_row, _, l_times = distinct_by_row(line_row, lines)
    n_lines = np.maximum(per_row(line_row, n), 1)
    letters = count(UPPER) + count(LOWERCASE)
    last = data[ends - 1] if len(ends) else data
    return np.stack([
        np.log1p(n_words), per_row(row, n, length) / of_words, count(SYMBOL) / of_words, count(MARK) / of_words, count(UPPER) / np.maximum(letters, 1), count(DIGIT) / size,
        per_row(seen, n) / of_words, top / of_words, per_row(g_row, n, (g_times - 1).astype(float)) / of_words, per_row(row[1:][same_next], n) / of_words,
        per_row(l_row, n, (l_times - 1).astype(float)) / n_lines, n_words / n_lines, count(EXCLAIM) / of_words, count(BEYOND) / size, per_row(row[length <= 3], n) / of_words, longest,
        count(BAR) / of_words, per_row(row[SYMBOL[last] | EXCLAIM[last]], n) / of_words if len(row) else np.zeros(n),
    ], axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the list x of statistics for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            column = texts(batch)
            parts = [statistics(column.slice(lo, hi - lo), powers) for lo, hi in slices(column)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def train(stats: DataFrame, labels: DataFrame, label: str, bound: int = LABELLED) -> boosting.Forest:
    """Fit on about `bound` labelled rows that are not held out; null labels teach nothing, several of one id count as their mean."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = sample_share(known, bound, F.col("doc_id")).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    got = stats.join(known, "doc_id").toPandas()
    got = got.sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return boosting.fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Statistics are taken in one pass over the texts and stored (some 150 bytes a document);
    fitting and scoring read those. Null and empty texts are scored by their zeros. Without
    labels every score is 0.5.
    """
    stats = cut_lineage(document_statistics(docs))
    shared = Shared(docs.sparkSession, train(stats, labels, label, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.get()
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x), pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
