"""Language identification by rank-order n-gram profiles.

A profile is the list of a text's most frequent character n-grams (1 to 3 letters, words
padded with a blank), most frequent first. A document gets the language whose profile has
the smallest out-of-place distance: the sum, over the document's n-grams, of how many
ranks each is off, with PROFILE for an n-gram that the language's profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.frames import held_out
from trackframe.llm.textbytes import slices, texts

PROFILE = 400
UNKNOWN = "und"
#: training texts are a hash sample of about so many rows for each language
SAMPLE = 3000
SPREAD = 16
#: languages are a small closed set; profiles of more are refused, not cut
MAX_LANGUAGES = 2000


class Letters:
    """Code point to itself for letters, 0 for all others."""

    def __init__(self) -> None:
        self.table = np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


def gram_codes(text: str, letters: Letters) -> np.ndarray:
    """The packed n-grams (21 bits a letter) of a text, with repeats; empty without letters."""
    codes = letters.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.int64)
    codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]
    two = (codes[:-1] << 21) | codes[1:]
    three = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return np.concatenate([codes[codes != 0], two, three[codes[1:-1] != 0]])


def ranked(grams: np.ndarray, limit: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    value, count = np.unique(grams, return_counts=True)
    return value[np.argsort(-count, kind="stable")[:limit]]


def learn_profiles(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from docs(doc_id, text, lang); rows without text or lang teach nothing.

    Texts are sampled by hash to about `sample` rows a language. Counts are summed in Spark;
    the driver gets at most SPREAD * profile n-grams a language.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(share) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not share:
        return {}
    limits = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * 1_000_000))])
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1_000_000)) < limits[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by.setdefault(lang, []).append(gram_codes(text, letters))
            for lang, parts in by.items():
                value, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counts = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "spread").orderBy(F.desc("n"), "gram")
    top = (
        counts.withColumn("spread", F.pmod(F.xxhash64("gram"), F.lit(SPREAD)))
        .withColumn("r", F.row_number().over(first)).where(F.col("r") <= profile)
        .select("lang", "gram", "n").toPandas().sort_values(["lang", "n", "gram"], ascending=[True, False, True])
    )
    return {lang: g["gram"].to_numpy(np.int64)[:profile] for lang, g in top.groupby("lang", sort=True)}


class Profiles:
    """Ranks of all profile n-grams, one row a language, for lookups by binary search."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.grams)), -1, np.int32)
        for i, n in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.grams, profiles[n])] = np.arange(len(profiles[n]))

    def distances(self, doc: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, doc), len(self.grams) - 1)
        known = self.grams[at] == doc
        ranks = self.ranks[:, at]
        off = np.abs(ranks - np.arange(len(doc)))
        return np.where(known & (ranks >= 0), np.minimum(off, self.size), self.size).sum(axis=1)


def predict(column: pa.Array, letters: Letters, known: Profiles, size: int = PROFILE) -> tuple[list[str], list[float], list[float]]:
    """(language, score, margin) of each text of an Arrow column."""
    pred, score, margin = [], [], []
    for lo, hi in slices(column):
        for text in column.slice(lo, hi - lo).to_pylist():
            doc = ranked(gram_codes(text, letters), size)
            if not len(doc) or not known.names:
                pred.append(UNKNOWN)
                score.append(0.0)
                margin.append(0.0)
                continue
            share = known.distances(doc) / (len(doc) * size)
            best = np.sort(share)[:2]
            pred.append(known.names[int(np.argmin(share))])
            score.append(float(1 - best[0]))
            margin.append(float(best[-1] - best[0]) if len(best) > 1 else float(1 - best[0]))
    return pred, score, margin


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score, margin; one row for each row.

    score is 1 minus the distance over the largest possible one. Ties go to the name that
    sorts first. `und`, 0 and 0 for a null text, a text without letters, or no profiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = Letters(), Profiles(profiles, size)
        for batch in batches:
            pred, score, margin = predict(texts(batch), letters, known, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """The rows of docs whose text gets a language, all columns; a null `lang` becomes the predicted one. Nothing is shuffled.

    Rejected: null texts, texts without a letter, and texts that no profile is nearer to than
    another, such as those in a script that no profile knows (margin 0).
    """
    fills = "lang" in docs.columns and docs.schema["lang"].dataType.simpleString() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = Letters(), Profiles(profiles, size)
        for batch in batches:
            pred, _, margin = predict(texts(batch), letters, known, size)
            if fills:
                i = batch.schema.get_field_index("lang")
                lang = pc.fill_null(batch.column(i), pa.array(pred, batch.column(i).type))
                batch = pa.RecordBatch.from_arrays([lang if k == i else c for k, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch.filter(pa.array([m > 0 for m in margin], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_of(docs: DataFrame) -> DataFrame:
    """Learn on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score, margin."""
    profiles = learn_profiles(docs.where(~held_out()))
    return identify(docs, profiles).withColumn("held_out", held_out())


def accuracy(predicted: DataFrame, docs: DataFrame) -> float | None:
    """Share of right languages among held-out rows with a language; None without any."""
    both = predicted.where("held_out").join(docs.where(F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id")
    return both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]


__all__ = ["Letters", "Profiles", "accuracy", "gram_codes", "identify", "language_of", "learn_profiles", "ranked"]
