"""Ranked lexical search by scanning documents with an automaton of the queries' terms.

No index of the documents exists. The terms of a block of benchmark items go into one
Aho-Corasick automaton, each between two guard blanks, so that a hit is a whole term; one
pass over the texts counts term frequencies and term totals. Document frequencies follow
from the stored counts, and a second pass over the counts, not the texts, maps automaton
outputs to the items that hold the term and keeps each item's best documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.llm.frames import Shared, stored
from trackframe.llm.textbytes import LOWER, nested, texts

TOP = 20
#: item text behind one automaton; a larger benchmark is searched in several passes
BLOCK_BYTES = 4_000_000
#: cells of the (documents x items) score table of one step
CELLS = 2_000_000
#: an item's local winners meet in so many groups before the last one
GROUPS = 16
NO_ID = np.iinfo(np.int64).max

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: bytes of terms in lower case, a blank for every other byte
GUARDED = bytes(LOWER[b] if TERM.match(bytes([b])) else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, with repeats; only A-Z are lower-cased."""
    return text.encode().translate(GUARDED).split()


class Queries:
    """Terms of some items: their automaton, and for each term the items that hold it."""

    def __init__(self, texts_: list[str]) -> None:
        counts = [Counter(terms(t)) for t in texts_]
        self.items = len(counts)
        self.terms = sorted({t for c in counts for t in c})
        number = {t: k for k, t in enumerate(self.terms)}
        held = sorted((number[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
        self.item = np.array([i for _, i, _ in held], np.int64)
        self.times = np.array([n for _, _, n in held], np.int64)
        self.start = np.searchsorted(np.array([t for t, _, _ in held], np.int64), np.arange(len(self.terms) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            a.add_word(f" {t.decode()} ", k)
        a.make_automaton()
        return a


HITS = "doc_id long, n long, terms array<int>, tf array<long>"


def count_terms(docs: DataFrame, queries: Shared) -> DataFrame:
    """doc_id, n (terms with repeats) and the query terms of each row with their frequencies."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.get()
        find = known.automaton().iter if known.terms else lambda text: ()
        for batch in batches:
            sizes, number, hits, times = [], [], [], []
            for text in texts(batch).to_pylist():
                data = text.encode().translate(GUARDED)
                sizes.append(len(data.split()))
                seen = Counter(k for _, k in find(f" {data.decode()} "))
                number.append(len(seen))
                hits.extend(seen.keys())
                times.extend(seen.values())
            row = np.repeat(np.arange(len(number)), number)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), nested(np.array(hits, np.int32), row, len(number), pa.int32()), nested(np.array(times, np.int64), row, len(number), pa.int64())],
                ["doc_id", "n", "terms", "tf"],
            )

    return docs.mapInArrow(scan, HITS)


class Best:
    """The `top` highest (score, then smallest id) pairs of every item, of any number of blocks of documents."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.floor = top, np.ones(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        """score[document, item] of documents `doc`."""
        r, i = np.nonzero(score >= self.floor)
        self.item, self.score, self.doc = np.concatenate([self.item, i]), np.concatenate([self.score, score[r, i]]), np.concatenate([self.doc, doc[r]])
        order = np.lexsort((self.doc, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, "left")
        order = order[place < self.top]
        self.item, self.score, self.doc = self.item[order], self.score[order], self.doc[order]
        last = place[place < self.top] == self.top - 1
        self.floor[self.item[last]] = self.score[last]


def block_scores(known: Queries, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Sums over items' terms: score[document, item] from (document, term, value) entries."""
    n = known.start[term + 1] - known.start[term]
    own = np.repeat(np.arange(len(term)), n)
    at = known.start[term][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(docs * known.items, np.int64)
    np.add.at(out, doc[own] * known.items + known.item[at], value[own] * known.times[at])
    return out.reshape(docs, known.items)


def local_best(hits: DataFrame, queries: Shared, weights: Shared, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item (number), doc_id, score: every task's best documents of every item."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = queries.get(), weights.get()
        best, step = Best(known.items, top), max(1, CELLS // max(known.items, 1))
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            size = batch.column(1).to_numpy(zero_copy_only=False)
            m = 75 + (25 * size * n_docs) // n_terms
            lists, tfs = batch.column(2), batch.column(3)
            edge = lists.offsets.to_numpy().astype(np.int64)
            term, tf = lists.values.to_numpy(zero_copy_only=False), tfs.values.to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), step):
                hi = min(lo + step, len(ids))
                t, f = term[edge[lo] : edge[hi]], tf[edge[lo] : edge[hi]]
                row = np.repeat(np.arange(hi - lo), np.diff(edge[lo : hi + 1]))
                value = weight[t] * ((1_000_000_000 * f) // (1000 * f + 12 * m[lo:hi][row]))
                best.add(block_scores(known, row, t, value, hi - lo), ids[lo:hi])
        ids = pa.array(best.doc, pa.int64(), mask=best.doc == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), ids, pa.array(best.score)], ["item", "doc_id", "score"])

    return hits.mapInArrow(rank, "item int, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> item_id, rank, doc_id, score.

    Each item's `top` documents with a score above 0, highest first, equal scores by doc_id
    (rows without an id last). Scores are the integer sums of the search contract. Repeated
    rows of docs are documents of their own; rows of benchmark that are equal count once, and
    rows of one item_id with different texts make one item with all their terms; a null id
    is an id like others. Null and empty texts have no terms, and a side without terms gives
    no rows. Documents are never shuffled: items are broadcast in blocks of about
    `block_bytes` of text (an item that is longer is a block of its own), and a task hands on
    at most `top` rows an item.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    items = items.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id").collect()
        known = Queries([r["text"] for r in rows])
        queries = Shared(spark, known)
        hits = stored(count_terms(docs, queries))
        sums = hits.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        n_docs, n_terms = sums["docs"], max(sums["terms"], 1)
        weight = np.zeros(max(len(known.terms), 1), np.int64)
        df = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        for r in df.select("term", w.alias("w")).collect():  # at most one row a term of the block
            weight[r["term"]] = r["w"]
        found = local_best(hits, queries, Shared(spark, weight), n_docs, n_terms, top)
        group = F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))
        for keys in (["item", "group"], ["item"]):
            order = W.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            found = found.withColumn("group", group).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], "item int, item_id long")
        part = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
