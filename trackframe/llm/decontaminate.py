"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a window of tokens; positions marked 0 may differ. Windows of
benchmark items and of documents are hashed under every mask, equal hashes give a diagonal
(document position minus item position), and along each diagonal the longest stretch with at
least MATCH of its tokens equal is measured. A document is contaminated by an item if that
stretch has LEAST tokens, or all of a shorter item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.frames import Shared, in_bitmap
from trackframe.llm.textbytes import BASE, Powers, mix, slices, texts, utf8, word_hashes

MASKS = ("111111", "1110010101", "1101001011", "1010111001")
LEAST = 13
MATCH = Fraction(4, 5)
#: benchmark text of one broadcast; a larger benchmark is searched in several passes
BLOCK_BYTES = 2_000_000
STEP = 1 << 20

#: ASCII letters and digits and all bytes of other characters make words
TOKEN = np.zeros(256, dtype=bool)
TOKEN[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True


def tokens(column: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the lower-cased words of all texts, punctuation left out."""
    data, offsets = utf8(pc.utf8_lower(column))
    inside = TOKEN[data]
    if len(data) > 2:  # general punctuation and Latin-1 signs
        lead = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        inside[np.concatenate([lead, lead + 1, lead + 2])] = False
        lead = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0))
        inside[np.concatenate([lead, lead + 1])] = False
    _, _, row, h = word_hashes(data, offsets, powers, inside)
    return h, row


def seed_hashes(words: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the windows that stay within one text."""
    k = len(words) - len(mask) + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(k, len(mask), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h *= np.uint64(BASE)
            h += words[i : i + k]
    at = np.flatnonzero(row[:k] == row[len(mask) - 1 :])
    return mix(h[at]), at


class Seeds:
    """All seed hashes of some benchmark items, sorted, with the places they come from."""

    def __init__(self, ids: list[int], column: pa.Array, masks: tuple[str, ...] = MASKS) -> None:
        powers = Powers()
        self.words, row = tokens(column, powers)
        n = len(ids)
        self.ids = ids
        self.length = np.bincount(row, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        # items too short for a mask are found by all their words at once
        short = sorted({int(x) for x in self.length if 0 < x < max(map(len, masks))})
        self.masks = [*masks, *("1" * x for x in short if "1" * x not in masks)]
        self.tables = []
        for mask in self.masks:
            h, at = seed_hashes(self.words, row, mask)
            if mask not in masks:
                whole = self.length[row[at]] == len(mask)
                h, at = h[whole], at[whole]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            words = np.zeros(1 << 14, np.uint64)
            low = (h & np.uint64(len(words) * 64 - 1)).astype(np.int64)
            np.bitwise_or.at(words, low >> 6, np.uint64(1) << (low & 63).astype(np.uint64))
            self.tables.append((h, row[at], at - self.start[row[at]], words))

    def hits(self, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct (item, diagonal) pairs by mask, in steps of bounded size; a diagonal is a place in `words`."""
        for mask, (table, item, place, filter_words) in zip(self.masks, self.tables):
            if not len(table):
                continue
            h, at = seed_hashes(words, row, mask)
            near = in_bitmap(filter_words, h)
            h, at = h[near], at[near]
            lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            found = hi > lo
            lo, hi, at = lo[found], hi[found], at[found]
            ends = np.cumsum(hi - lo)
            first = 0
            while first < len(at):
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + STEP, "right")))
                n = (hi - lo)[first:last]
                own = np.repeat(np.arange(first, last), n)
                k = lo[own] + np.arange(len(own)) - np.repeat(ends[first:last] - n - base, n)
                pair = np.unique(np.stack([item[k], at[own] - place[k], row[at[own]]]), axis=1)
                yield pair[0], pair[1], pair[2]
                first = last


def longest_stretch(equal: np.ndarray, match: Fraction = MATCH) -> tuple[int, int]:
    """(start, end) of the longest stretch with a share of at least `match` equal tokens; the first of several."""
    level = np.concatenate([[0], np.cumsum(np.where(equal, match.denominator - match.numerator, -match.numerator))])
    low = np.minimum.accumulate(level)
    start = np.searchsorted(-low, -level, "left")
    end = int(np.argmax(np.arange(len(level)) - start))
    return int(start[end]), end


SCHEMA = "doc_id long, item_id long, overlap int, matched int, item_tokens int, doc_start int"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, match: Fraction = MATCH, masks: tuple[str, ...] = MASKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> a row for each row of docs and item that contaminates it.

    doc_id, item_id, overlap (tokens of the best stretch), matched (equal ones in it),
    item_tokens, doc_start (token at which the stretch starts). Null and empty texts have no
    tokens and match nothing; an empty side gives no rows; repeated rows are each reported.
    Documents are not shuffled: benchmark items are broadcast in blocks of about `block_bytes`.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        seeds = Shared(spark, Seeds([r["item_id"] for r in rows], pa.array([r["text"] for r in rows], pa.large_string()), masks))

        def search(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            known, powers = seeds.get(), Powers()
            for batch in batches:
                column, ids = texts(batch), batch.column(0).to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                for lo, hi in slices(column):
                    words, row = tokens(column.slice(lo, hi - lo), powers)
                    edge = np.searchsorted(row, np.arange(hi - lo + 1), "left")
                    for item, diagonal, doc in known.hits(words, row):
                        for i, d, r in zip(item.tolist(), diagonal.tolist(), doc.tolist()):
                            n, start = int(known.length[i]), int(known.start[i])
                            a, z = max(d, int(edge[r])), min(d + n, int(edge[r + 1]))
                            equal = words[a:z] == known.words[start + a - d : start + z - d]
                            s, e = longest_stretch(equal, match)
                            if e - s >= min(least, n):
                                got = (e - s, int(equal[s:e].sum()), n, a + s - int(edge[r]))
                                old = best.get((lo + r, i))
                                if old is None or (got[0], got[1], -got[3]) > (old[0], old[1], -old[3]):
                                    best[lo + r, i] = got
                keys = sorted(best)
                cols = [pa.array([ids[r] for r, _ in keys], pa.int64()), pa.array([known.ids[i] for _, i in keys], pa.int64())]
                cols += [pa.array([best[k][j] for k in keys], pa.int32()) for j in range(4)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "overlap", "matched", "item_tokens", "doc_start"])

        part = docs.mapInArrow(search, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out
