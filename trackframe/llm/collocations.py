"""Phrase collocations by the stripes pattern.

A stripe belongs to a prefix of one to three words and counts the words that follow it; the
entry "" counts the places where none that matters does. Tasks combine stripes of their own
text, Spark merges them elementwise, and the merged stripes hold all that is asked for: an
entry is the frequency of a longer phrase and the total of its own stripe, the sum of a
word's stripe that of the word, the largest entry what a candidate loses to on the right. Hashes of words, then of pairs, then
of longer phrases are counted first, because a phrase can only be frequent if its parts
are; filters made from them keep rare phrases out of the stripes and lose none that is
frequent. What a filter lets through by chance counts as it is and is dropped by its sum.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.llm.frames import Shared, bitmap, in_bitmap, stored
from trackframe.llm.textbytes import BASE, LOWER, Powers, mix, slices, texts, utf8, word_hashes

LEAST = 30
LONGEST = 4
SUBSUMED = 80
TOP = 2000
UNKNOWN = "und"
#: words of text that a task combines before it hands its stripes on
CHUNK_WORDS = 2_000_000
#: a phrase with more than one in HOT_SHARE of all words is hot; its stripe is dealt out in BUCKETS parts
HOT_SHARE = 1000
BUCKETS = 64
#: phrases are thinned by hashes of so many bits: 12 that deal them out, 32 in an entry
HASH = (1 << 44) - 1
#: bits of a filter for each value in it, and the bounds of its size
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 16, 28

#: piece borders become a dot of their own, other white space a blank, A-Z lower case
_PIECES = bytearray(LOWER.tobytes())
for _c in b".,;:!?\n\x0b\x0c\r":
    _PIECES[_c] = 0x2E
_PIECES[0x09] = 0x20
PIECES = bytes(_PIECES)
PIECE_BYTES = np.frombuffer(PIECES, np.uint8)


class Chunk:
    """Word numbers of some texts of one language in order; 0 stands for a border."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(lambda: len(self.ids))
        self.ids[b"."]
        self.seq: list[int] = []

    def add(self, text: str) -> None:
        words = text.encode().translate(PIECES).replace(b".", b" . ").split()
        self.seq.extend(map(self.ids.__getitem__, words))
        self.seq.append(0)


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words by number, numbers in order) of about `limit` words each, or one text."""
    held: dict[str, Chunk] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch).to_pylist()):
            own = held.setdefault(lang, Chunk())
            before = len(own.seq)
            own.add(text)
            size += len(own.seq) - before
            if size >= limit:
                yield from ((la, list(c.ids), np.array(c.seq, np.int64)) for la, c in held.items())
                held, size = {}, 0
    yield from ((la, list(c.ids), np.array(c.seq, np.int64)) for la, c in held.items())


def seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def text_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(languages of some rows, and of all their words in order: row, hash by language, number of the piece)."""
    powers = Powers()
    for batch in batches:
        langs, column = batch.column(0).to_pylist(), texts(batch)
        seeds = {lang: seed(lang) for lang in set(langs)}
        for lo, hi in slices(column):
            data, offsets = utf8(column.slice(lo, hi - lo))
            data = PIECE_BYTES[data]
            border = data == 0x2E
            starts, _, row, h = word_hashes(data, offsets, powers, ~border & (data != 0x20))
            own = np.array([seeds[lang] for lang in langs[lo:hi]], np.uint64)
            yield langs[lo:hi], row, mix(h ^ own[row]), np.cumsum(border)[starts] + row


def grams(h: np.ndarray, piece: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether they lie in one piece) of the `size` words from each place on."""
    n = max(len(h) - size + 1, 0)
    code, inside = np.full(len(h), size, np.uint64), np.zeros(len(h), dtype=bool)
    for i in range(size):
        code[:n] = mix(code[:n] * np.uint64(BASE) + h[i : n + i])
    inside[:n] = piece[:n] == piece[size - 1 : n + size - 1]
    return code & np.uint64(HASH), inside


class Filters:
    """What may be frequent, by number of words: bitmaps of hashes; and the hashes of what is hot."""

    def __init__(self) -> None:
        self.bits: dict[int, np.ndarray] = {}
        self.hot = np.zeros(0, np.uint64)

    def add(self, sizes: tuple[int, ...], bits: np.ndarray, hot: list[int]) -> None:
        self.bits.update(dict.fromkeys(sizes, bits))
        self.hot = np.union1d(self.hot, np.array(hot, np.uint64))

    def passing(self, size: int, code: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return in_bitmap(self.bits[size], code) & inside


def every(good: np.ndarray, n: int) -> np.ndarray:
    """Whether `n` places from each on are good; beyond the end none is."""
    good = np.concatenate([good, np.zeros(n, dtype=bool)])
    return np.logical_and.reduce([good[i : len(good) - n + i] for i in range(n)])


def packed(codes: list[np.ndarray], totals: Counter) -> pa.RecordBatch:
    """Counts of equal hashes, a row for each bucket (their upper bits), and a row with its words for each language."""
    value, n = np.unique(np.concatenate(codes), return_counts=True)
    bucket = (value >> np.uint64(32)).astype(np.int32)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(value) else np.zeros(0, np.int64)
    langs = sorted(totals)
    edge = [*start.tolist(), *range(len(value), len(value) + len(langs) + 1)]
    low = np.append(value.astype(np.uint32).view(np.int32), np.zeros(len(langs), np.int32))
    n = np.append(n, np.array([totals[la] for la in langs], np.int64)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x)) for x in (low, n)]
    buckets = [*bucket[start].tolist(), *[-1 - len(value) % BUCKETS] * len(langs)]
    return pa.RecordBatch.from_arrays([pa.array([None] * len(start) + langs, pa.string()), pa.array(buckets, pa.int32()), *lists], ["lang", "bucket", "low", "n"])


def hash_counts(docs: DataFrame, shared: Shared, sizes: tuple[int, ...], chunk_words: int) -> DataFrame:
    """Counts of the hashes of phrases whose parts pass, combined by chunk: four bytes an entry."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.get()
        held, size, totals = [np.zeros(0, np.uint64)], 0, Counter()
        for langs, row, h, piece in text_words(batches):
            for k in sizes:
                code, inside = grams(h, piece, k)
                if k > 1:  # its words, or its pairs, must all pass
                    part = min(k - 1, 2)
                    inside &= every(known.passing(part, *grams(h, piece, part)), k - part + 1)
                else:
                    for lang, n in zip(langs, np.bincount(row, minlength=len(langs)).tolist()):
                        totals[lang] += n
                held.append(code[inside])
                size += len(held[-1])
            if size >= chunk_words:
                yield packed(held, totals)
                held, size, totals = [np.zeros(0, np.uint64)], 0, Counter()
        yield packed(held, totals)

    return docs.mapInArrow(collect, "lang string, bucket int, low array<int>, n array<int>")


def frequent(docs: DataFrame, filters: Filters, sizes: tuple[int, ...], least: int, chunk_words: int, hot_at: int = 0) -> tuple[DataFrame, int]:
    """Take the hashes of phrases with `least` occurrences into the filters: (lang, n) if words were counted, and n of all.

    `hot_at` is the count from which on a phrase is hot (0: not known before the words are counted).
    """
    parts = hash_counts(docs, Shared(docs.sparkSession, filters), sizes, chunk_words).repartition("bucket")
    each = parts.select("lang", "bucket", F.explode(F.arrays_zip("low", "n")).alias("e"))
    counts = each.groupBy("lang", "bucket", F.col("e.low").alias("low")).agg(F.sum("e.n").alias("f")).where((F.col("f") >= least) | F.col("lang").isNotNull())
    h = F.shiftleft(F.col("bucket").cast("long"), 32).bitwiseOR(F.col("low").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = stored(counts.withColumn("h", h))
    totals = counts.where("lang is not null").groupBy("lang").agg(F.sum("f").alias("n"))
    hashes = counts.where("lang is null")
    words = totals.agg(F.sum("n")).first()[0] or 0
    hot_at = hot_at or max(words // HOT_SHARE, 1)
    filters.add(sizes, filter_of(hashes, "h"), [r["h"] for r in hashes.where(F.col("f") > hot_at).select("h").collect()])  # fewer than HOT_SHARE rows a size
    return totals, hot_at


def filter_of(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap that widens with the number of values, from 8 KB to 32 MB; beyond that it lets more through and still loses none."""
    n = max(values.count(), 1)
    return bitmap(values, column, min(max(math.ceil(math.log2(n * BITS_EACH)), LEAST_BITS), MOST_BITS))


STRIPES = "lang string, prefix string, bucket int, next array<string>, f array<long>"


def emit(lang: str, words: pa.Array, prefix: list[np.ndarray], follower: np.ndarray, h: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes of the prefixes (word numbers by place) with their followers (0: none that matters)."""
    if not len(follower):
        return
    # Numbers of distinct prefixes, then of distinct (prefix, bucket, follower).
    code = prefix[0]
    for p in prefix[1:]:
        _, code = np.unique(code, return_inverse=True)
        code = (code << 32) | p
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    value, n = np.unique((code << 32) | follower, return_counts=True)
    code, follower = value >> 32, value & 0xFFFFFFFF
    bucket = np.where(hot[first][code], (h[follower] % np.uint64(BUCKETS)).astype(np.int64), 0)
    order = np.argsort(code * BUCKETS + bucket, kind="stable")
    key, follower, n = (code * BUCKETS + bucket)[order], follower[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    at = first[key[start] // BUCKETS]
    text = words.take(pa.array(prefix[0][at]))
    for p in prefix[1:]:
        text = pc.binary_join_element_wise(text, words.take(pa.array(p[at])), " ")
    offsets = pa.array(np.append(start, len(key)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, words.take(pa.array(follower))), pa.ListArray.from_arrays(offsets, pa.array(n))]
    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), text, pa.array((key[start] % BUCKETS).astype(np.int32)), *lists], ["lang", "prefix", "bucket", "next", "f"])


def stripes(docs: DataFrame, shared: Shared, chunk_words: int) -> DataFrame:
    """Stripes of all prefixes of one to three words, combined by chunk, before they are merged.

    A follower has an entry if prefix and follower together pass. Every place of a single
    word counts, so that its stripe sums to the word; longer prefixes have their total as an
    entry of the shorter prefix's stripe.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers = shared.get(), Powers()
        for lang, words, seq in chunks(batches, chunk_words):
            column = pa.array(["", *[w.decode() for w in words[1:]]], pa.string())
            data, offsets = utf8(column.cast(pa.large_string()))
            own = np.zeros(len(words), np.uint64)
            own[1:] = mix(word_hashes(data, offsets[1:], powers, np.ones(len(data), dtype=bool))[3] ^ np.uint64(seed(lang)))
            piece, ids = np.cumsum(seq == 0)[seq > 0], seq[seq > 0]
            h = own[ids]
            code = grams(h, piece, 1)
            passing = known.passing(1, *code)
            ids = np.append(ids, 0)
            for size in range(1, LONGEST):
                longer = grams(h, piece, size + 1)
                follows = known.passing(size + 1, *longer)
                prefix = np.flatnonzero(passing if size == 1 else follows)
                yield from emit(lang, column, [ids[prefix + i] for i in range(size)], np.where(follows[prefix], ids[np.minimum(prefix + size, len(ids) - 1)], 0), own, np.isin(code[0][prefix], known.hot))
                code = longer

    return docs.mapInArrow(collect, STRIPES)


def merged(parts: DataFrame, least: int) -> DataFrame:
    """lang, prefix, bucket, sum, most, ext: stripes added elementwise; entries below `least` only count in the sum.

    Parts of one stripe and bucket meet in one partition and are added by a combinable
    aggregate that may spill; a hot prefix has BUCKETS groups.
    """
    own = parts.repartition("lang", "prefix", "bucket").select("lang", "prefix", "bucket", F.explode(F.arrays_zip("next", "f")).alias("e"))
    added = own.groupBy("lang", "prefix", "bucket", F.col("e.next").alias("next")).agg(F.sum("e.f").alias("f"))
    long = (F.col("next") != "") & (F.col("f") >= least)
    each = added.groupBy("lang", "prefix", "bucket").agg(
        F.sum("f").alias("sum"), F.max(F.when(long, F.col("f"))).alias("most"), F.collect_list(F.when(long, F.struct("next", "f"))).alias("ext")
    )
    return each.where((F.size("ext") > 0) | ~F.contains("prefix", F.lit(" ")))


def part(first: int, n: Column | None = None) -> Column:
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, first, F.size(words) - (first - 1) if n is None else n), " ")


def collocations(docs: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """docs(text, lang) -> lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Phrases of 2 to 4 words of one piece with a = f(phrase) >= `least`; the cut with the lowest
    floor(2000000 * a / (l + r)) counts, the shortest first part on ties. A phrase inside a
    longer candidate with at least `subsumed` percent of its frequency goes. Rank by score and
    frequency, highest first, then by phrase. Null texts are empty, null languages 'und';
    repeated rows count each; an empty table gives no rows.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    filters = Filters()
    totals, hot_at = frequent(docs, filters, (1,), least, chunk_words)
    frequent(docs, filters, (2,), least, chunk_words, hot_at)
    frequent(docs, filters, (3, 4), least, chunk_words, hot_at)
    striped = stored(merged(stripes(docs, Shared(docs.sparkSession, filters), chunk_words), least))

    phrases = striped.select("lang", "prefix", F.explode("ext").alias("e")).select("lang", F.concat_ws(" ", "prefix", "e.next").alias("phrase"), F.col("e.f").alias("a"))
    words = striped.where(~F.contains("prefix", F.lit(" "))).groupBy("lang", F.col("prefix").alias("part")).agg(F.sum("sum").alias("f")).where(F.col("f") >= least)
    facts = stored(words.unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))))
    hot = [f"{r['lang']}\n{r['part']}" for r in facts.where(F.col("f") > hot_at).select("lang", "part").collect()]  # fewer than HOT_SHARE rows a size
    scored = best_cuts(phrases, facts, hot)

    left = phrases.where(F.size(F.split("phrase", " ")) > 2).groupBy("lang", part(2).alias("phrase")).agg(F.max("a").alias("left"))
    right = striped.where("most is not null").groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("most").alias("top"))
    kept = scored.join(left, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left")
    # Whatever holds a phrase holds it with one neighbour, and that longer phrase is as frequent at least.
    kept = kept.where(~(100 * F.coalesce(F.greatest("left", "top"), F.lit(0)) >= subsumed * F.col("a")))
    return ranked(kept, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best_cuts(phrases: DataFrame, facts: DataFrame, hot: list[str]) -> DataFrame:
    """lang, phrase, a, l, r, score: the lowest-scoring cut of every phrase.

    Frequencies of both parts of every cut are looked up by one join; parts that are hot are
    spread over BUCKETS places, with a copy of their one row in each.
    """
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), part(1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("part")))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    is_hot = F.concat_ws("\n", "lang", "part").isin(hot) if hot else F.lit(False)
    asked = asked.withColumn("place", F.when(is_hot, F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).otherwise(0).cast("int"))
    copies = facts.withColumn("place", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(BUCKETS - 1))).otherwise(F.array(F.lit(0)))))
    got = asked.join(copies, ["lang", "part", "place"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cut = got.groupBy("lang", "phrase", "a", "k").agg(side("l").alias("l"), side("r").alias("r"))
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    low = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return low.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` of every language; candidates are thinned in BUCKETS groups of a language first."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    for keys in (["lang", "group"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return rows.drop("group")
