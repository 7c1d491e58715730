"""Toxicity: a lexicon matched with one edit of tolerance, weighed by the words around each hit.

The lexicon has fixed terms and terms learned from labelled documents: words, and beginnings
of words, that occur with many different left neighbours in toxic documents and hardly ever
in others. Each hit gets a score from its context window: less inside quotation marks or
after a verb of speech, more beside other hits or a word of address. A logistic model over the hits of
a document gives the score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm import automaton
from trackframe.llm.frames import Shared, cut_lineage, held_out, sample_share
from trackframe.llm.language import Letters
from trackframe.llm.textbytes import slices, texts

#: at most about so many labelled documents teach terms and weights
LABELLED = 12_000
THRESHOLD = 0.5
WINDOW = 6

# Terms of abuse, words of address, verbs of speech, quotation marks.
TERMS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting", "imbecile", "vermin", "dumbass", "bastard", "asshole")
ADDRESS = ("you", "your", "youre", "u", "du", "dich", "ihr", "tu", "toi", "vous", "tú", "ustedes")
SPEECH = ("said", "says", "wrote", "called", "calls", "quoted", "reported", "term", "word", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")
QUOTES = "\"“”„«»‘"

LEAST_TERM, LEAST_STEM, STEM_SIZES, LEAST_LETTERS = 4, 8, (4, 5, 6, 7, 8), 5
FEATURES = ("hits", "total", "most", "exact", "near", "stem", "quoted", "share")


@dataclass
class Words:
    """Words of a slice of texts as places in one array of code points."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray  # first word of each row, one entry more than rows
    text: str

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


def words_of(values: list[str], letters: np.ndarray) -> Words:
    """Lower-cased maximal runs of letters, digits and @."""
    lower = [v.lower() for v in values]
    text = "\n".join(lower) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letters[codes]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum([len(v) + 1 for v in lower])])
    row = np.searchsorted(offsets, starts, "right") - 1
    return Words(codes, starts, ends, row, np.searchsorted(row, np.arange(len(values) + 1), "left"), text)


def word_letters() -> np.ndarray:
    table = Letters().table != 0
    table[[*range(ord("0"), ord("9") + 1), ord("@")]] = True
    return table


def learn_terms(docs: DataFrame, toxic: dict[int, int]) -> tuple[list[str], list[str]]:
    """(terms, stems) from the documents whose id is in `toxic` (id -> 0 or 1), counted in Spark.

    A term needs LEAST_TERM toxic documents and left neighbours and at most a tenth as many
    other documents; copies of one document count as one neighbour. A stem needs more, and two words.
    """
    if not toxic or not any(toxic.values()):
        return [], []
    shared = Shared(docs.sparkSession, toxic)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = word_letters(), shared.get()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            pick = [i for i, d in enumerate(ids) if d in known]
            column = texts(batch)
            sums: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for i in pick:
                w = words_of([column[i].as_py()], letters)
                bad = known[ids[i]]
                left: dict[str, int] = defaultdict(int)
                before = ""
                for k in range(len(w.starts)):
                    word = w.word(k)
                    if bad:
                        left[word] |= 1 << (_small_hash(before) & 62)
                    else:
                        left[word] = 0
                    before = word
                entries: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
                for word, seen in left.items():
                    if len(word) <= 40:
                        entries[word, False][0] |= seen
                        for n in STEM_SIZES:
                            if len(word) >= n:
                                entries[word[:n], True][0] |= seen
                                entries[word[:n], True][1] |= 1 << (_small_hash(word) & 62)
                for key, (seen, forms) in entries.items():
                    s = sums[key]
                    s[0] += bad
                    s[1] += 1 - bad
                    s[2] |= seen
                    s[3] |= forms
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array([sums[k][j] for k in keys], pa.int64()) for j in range(4))], ["entry", "stem", "bad", "good", "contexts", "forms"])

    counts = docs.mapInArrow(count, "entry string, stem boolean, bad long, good long, contexts long, forms long")
    sums = counts.groupBy("entry", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.bit_count(F.bit_or("contexts")).alias("contexts"), F.bit_count(F.bit_or("forms")).alias("forms"))
    terms = ~F.col("stem") & (F.length("entry") >= LEAST_LETTERS) & (F.col("bad") >= LEAST_TERM) & (F.col("contexts") >= LEAST_TERM) & (10 * F.col("good") <= F.col("bad"))
    stems = F.col("stem") & (F.col("bad") >= LEAST_STEM) & (F.col("contexts") >= LEAST_STEM) & (F.col("forms") >= 2) & (20 * F.col("good") <= F.col("bad"))
    found = sums.where(terms | stems).select("entry", "stem").collect()
    stem = sorted((r["entry"] for r in found if r["stem"]), key=lambda s: (len(s), s))
    short: list[str] = []
    for s in stem:
        if not any(s.startswith(x) for x in short):
            short.append(s)
    return sorted(r["entry"] for r in found if not r["stem"] and not any(r["entry"].startswith(x) for x in short)), short


def _small_hash(word: str) -> int:
    h = 0
    for ch in word[:8]:
        h = (h * 31 + ord(ch)) % 1_000_003
    return h


def lexicon(terms: list[str], stems: list[str]) -> automaton.Automaton:
    """Fixed terms of five letters and learned ones of seven or more may be one edit off; others must match."""
    near = {w for w in TERMS if len(w) >= 5} | {w for w in terms if len(w) >= 7}
    return automaton.build(sorted(near), sorted({*TERMS, *terms} - near), stems)


def quoted_ranges(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Stretches between quotation marks that open and close on one line."""
    out, open_at = [], -1
    for i in range(lo, hi):
        ch = text[i]
        if ch == "\n":
            open_at = -1
        elif ch in QUOTES:
            if open_at >= 0:
                out.append((open_at, i))
                open_at = -1
            else:
                open_at = i
    return out


def weigh(w: Words, kinds: np.ndarray) -> np.ndarray:
    """FEATURES of each row from its hits and the WINDOW words to either side."""
    n = len(w.first) - 1
    x = np.zeros((n, len(FEATURES)))
    at = np.flatnonzero(kinds)
    for r in np.unique(w.row[at]):
        hits = at[w.row[at] == r]
        lo, hi = int(w.first[r]), int(w.first[r + 1])
        quotes = quoted_ranges(w.text, int(w.starts[lo]), min(len(w.text), int(w.ends[hi - 1]) + 2)) if any(q in w.text[max(0, int(w.starts[lo]) - 1) : int(w.ends[hi - 1]) + 1] for q in QUOTES) else []
        total = most = quoted = 0.0
        for k in hits:
            k = int(k)
            around = [w.word(j) for j in range(max(lo, k - WINDOW), min(hi, k + WINDOW + 1)) if j != k]
            s = {automaton.EXACT: 1.0, automaton.NEAR: 0.6, automaton.STEM: 0.9}[int(kinds[k])]
            s += 0.2 * int(np.count_nonzero((hits >= k - WINDOW) & (hits <= k + WINDOW)) - 1) + 0.3 * any(a in ADDRESS for a in around)
            if any(a < w.starts[k] and w.ends[k] <= b for a, b in quotes) or any(a in SPEECH for a in around[:WINDOW]):
                s *= 0.4
                quoted += 1
            total += s
            most = max(most, s)
        of = [np.count_nonzero(kinds[hits] == k) for k in (automaton.EXACT, automaton.NEAR, automaton.STEM)]
        x[r] = [np.log1p(len(hits)), np.log1p(total), most, *map(np.log1p, of), quoted / len(hits), len(hits) / (hi - lo)]
    return x


def document_hits(docs: DataFrame, lexicon_table: automaton.Automaton) -> DataFrame:
    """doc_id and the list x of FEATURES for each row of docs; nothing is shuffled."""
    shared = Shared(docs.sparkSession, lexicon_table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table = word_letters(), shared.get()
        lexicon_codes = table.letter_codes()
        for batch in batches:
            column = texts(batch)
            parts = [np.zeros((0, len(FEATURES)))]
            for lo, hi in slices(column):
                w = words_of(column.slice(lo, hi - lo).to_pylist(), letters)
                parts.append(weigh(w, table.kinds(lexicon_codes[w.codes], w.starts, w.ends)))
            x = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights, the constant last, by Newton steps; hits count as evidence by default if a label is missing."""
    if not len(y) or y.min() == y.max():
        return np.array([1.0, 1.0, 2.0, 0, 0, 0, -1.0, 0, -2.5])
    z = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    pull = np.full(len(b), ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * b)
    return b


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, hits, score, predicted.

    Labels of a hash sample of about `bound` rows that are not held out are used: most of
    them for terms, three in ten for weights. Null labels teach nothing; several labels of one id
    count as their mean. Null and empty texts have no hits. Without labels the fixed terms
    and default weights decide.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = cut_lineage(sample_share(known, bound, F.col("doc_id")).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(10)) < 7
    teach = {r["doc_id"]: r["y"] for r in known.where(half).collect()}
    terms, stems = learn_terms(docs, teach)
    hits = cut_lineage(document_hits(docs, lexicon(terms, stems)))
    got = hits.join(known.where(~half), "doc_id").toPandas().sort_values("doc_id")
    weights = fit_logistic(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["y"].to_numpy(float))
    z = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in weights[:-1]]), lambda a, b: a * b), F.lit(float(weights[-1])), lambda a, b: a + b)
    scored = hits.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("hits", F.round(F.expm1(F.get("x", F.lit(0)))).cast("int"))
    return scored.select("doc_id", held_out().alias("held_out"), "hits", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
