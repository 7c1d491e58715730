"""Near-duplicate join on word shingles: documents at a Jaccard similarity, by T-occurrence search.

Copies of one shingle set are counted once. A set's rarest tokens go first: of each set
the lowest RARE share of token hashes (at least as many as its prefix) is posted, tokens that
only one set posted are dropped, and what is left of the prefix says with which sets it may
link. Every shared prefix token sends its sets, by bands of size, to the smallest of them,
their home. In blocks of bounded size the sets of a home first meet as parity sketches (a bit
for about each token, turned by every token that falls on it): two sets differ in at least as
many tokens as their sketches in bits, so sets without a partner near enough go no further.
The others are searched pairwise by block with `tsearch.connect`; no pair that could link is
left out, at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.frames import Shared, bitmap, cut_lineage, in_bitmap, salted_join, signed, stored
from trackframe.llm.textbytes import LOWER, Powers, distinct_by_row, gram_hashes, mix, nested, per_row, slices, texts, utf8, word_hashes
from trackframe.llm.tsearch import connect, prefix_size

SHINGLE = 3
SIMILAR = (90, 100)
#: posted share of tokens, in parts of the share that may differ: with more than a prefix, tokens of one set alone use up its prefix
RARE = 1.5
BLOCK = 300
#: bits of the smallest sketch
WORD = 64


def shingle_sets(column: pa.Array, powers: Powers, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the distinct shingles of all texts, tokens ascending; a text with fewer words is one shingle."""
    data, offsets = utf8(column)
    _, _, row, words = word_hashes(LOWER[data], offsets, powers)
    grams, gram_row = gram_hashes(words, row, size)
    count = per_row(row, len(column))
    parts, rows = [grams], [gram_row]
    for k in range(1, size):
        few = count[row] == k
        h, r = gram_hashes(words[few], row[few], k)
        parts.append(h)
        rows.append(r)
    r, token, _ = distinct_by_row(np.concatenate(rows), np.concatenate(parts))
    return r, token


def signatures(docs: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128 bits that name the set), head (its posted tokens), sketch (see `sketches`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        rare = np.uint64(min(int(RARE * (similar[1] - similar[0]) / similar[1] * (1 << 64)), (1 << 64) - 1))
        for batch in batches:
            column = texts(batch)
            for lo, hi in slices(column):
                rows = hi - lo
                row, token = shingle_sets(column.slice(lo, rows), powers, size)
                n = per_row(row, rows).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                sums = np.concatenate([[0], np.cumsum(mix(token))]).astype(np.uint64), np.concatenate([[0], np.cumsum(mix(token ^ np.uint64(0x5851F42D4C957F2D)))]).astype(np.uint64)
                s1, s2 = (signed(s[first[1:]] - s[first[:-1]]) for s in sums)
                keep = np.maximum(per_row(row[token < rare], rows), np.where(n > 0, prefix_size(n, *similar), 0))
                posted = np.arange(len(row)) - first[row] < keep[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(n), pa.array(s1), pa.array(s2), nested(signed(token[posted]), row[posted], rows, pa.int64()), sketches(row, token, n)], ["doc_id", "n", "s1", "s2", "head", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, head array<long>, sketch binary")


def sketches(row: np.ndarray, token: np.ndarray, n: np.ndarray) -> pa.Array:
    """The parity sketch of each set: the next power of two above n bits (none for an empty set), each the parity of the tokens on it.

    Folding a sketch (its halves xor-ed) gives the set's sketch of half the size.
    """
    bits = np.where(n > 0, np.maximum(WORD, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)), 0)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = base[row] + (mix(token ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64) & (bits[row] - 1))
    packed = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((base // 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])


def full_sets(docs: DataFrame, wanted: np.ndarray, size: int) -> DataFrame:
    """doc_id and tokens of documents whose id may be wanted, by the bitmap of id hashes."""
    shared = Shared(docs.sparkSession, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, known = Powers(), shared.get()
        for batch in batches:
            pick = np.flatnonzero(in_bitmap(known, batch.column(2).to_numpy(zero_copy_only=False)))
            batch = batch.take(pa.array(pick))
            column = texts(batch)
            for lo, hi in slices(column):
                row, token = shingle_sets(column.slice(lo, hi - lo), powers, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), nested(signed(token), row, hi - lo, pa.int64())], ["doc_id", "tokens"])

    return docs.withColumn("h", F.xxhash64("doc_id")).select("doc_id", "text", "h").mapInArrow(run, "doc_id long, tokens array<long>")


def prefix_left(similar: tuple[int, int]):
    """How many tokens of a prefix are shared ones: its size less the posted tokens that only one set has."""
    num, den = similar
    prefix = (F.col("n") - F.floor((F.col("n") * num + den - 1) / den) + 1).cast("int")
    return prefix - (F.col("posted") - F.size("head"))


def shared_heads(signed_docs: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """doc_id, n, s1, s2, posted, head: posted tokens that occur twice, of sets whose prefix holds any.

    Tokens are counted in Spark; a bitmap of those counted twice thins the lists where they
    are, so that only a small part of the postings is shuffled by document or joined.
    """
    counts = signed_docs.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= 2)
    shared = Shared(signed_docs.sparkSession, bitmap(counts, "token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.get()
        for batch in batches:
            lists = batch.column(4)
            offsets = np.asarray(lists.offsets)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), np.diff(offsets))
            keep = in_bitmap(known, values)
            head = nested(values[keep], row[keep], len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(offsets).astype(np.int32)), head], ["doc_id", "n", "s1", "s2", "posted", "head"])

    thin = signed_docs.where("n > 0").select("doc_id", "n", "s1", "s2", "head").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, posted int, head array<long>")
    return thin.where(prefix_left(similar) > 0)


def shared_prefixes(heads: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """doc_id, band, token: the tokens of each set's prefix, rarest first, that another set posted too, in both bands of the set's size.

    Sizes of linked sets differ by less than a band, so linked sets have a band in common.
    """
    posted = heads.select("doc_id", F.explode("head").alias("token"))
    counts = cut_lineage(posted.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= 2))
    own = posted.join(counts, "token").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("head"))
    own = own.join(heads.select("doc_id", "n", "posted").distinct(), "doc_id")
    left = prefix_left(similar)
    width = max(math.log(similar[1] / similar[0]) * 1.000001, 1e-9)
    band = F.floor(F.log("n") / width).cast("long")
    items = own.where(left > 0).select("doc_id", F.array(band, band + 1).alias("bands"), F.explode(F.slice("head", F.lit(1), left)).alias("item"))
    return items.select("doc_id", F.explode("bands").alias("band"), F.col("item")["token"].alias("token"))


def homes(prefixes: DataFrame) -> DataFrame:
    """home, doc_id: each shared prefix token brings its sets of one band to the smallest id among them."""
    lists = prefixes.groupBy("token", "band").agg(F.min("doc_id").alias("home"), F.count("*").alias("c")).where(F.col("c") >= 2).select("token", "band", "home")
    return prefixes.join(stored(lists), ["token", "band"]).select("home", "doc_id").distinct()


def placed(members: DataFrame, block: int) -> DataFrame:
    """home, doc_id, own (number of its block in the home), blocks, first (whether it is the smallest home of the document)."""
    sizes = cut_lineage(members.groupBy("home").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    least = members.groupBy("doc_id").agg(F.min("home").alias("least"))
    dealt = salted_join(members, sizes, "home", F.col("doc_id"), "inner").join(least, "doc_id")
    return dealt.select("home", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int").alias("own"), "blocks", (F.col("home") == F.col("least")).alias("first"))


def first_blocks(members: DataFrame) -> DataFrame:
    """Every document once, in its block of its smallest home; blocks of one document are left out."""
    own = members.where("first")
    several = own.groupBy("home", "own").agg(F.count("*").alias("c")).where("c > 1").select("home", "own")
    return own.join(several, ["home", "own"]).select("home", F.col("own").alias("a"), F.col("own").alias("b"), "doc_id", F.col("own").alias("side"))


def block_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def speakers(members: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """One document for each component and home of several blocks, dealt to blocks anew; each block with itself."""
    own = block_members(members.where("blocks > 1"), labels).groupBy("home", "label").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("c"))
    own = cut_lineage(own.where("c > 1"))
    parts = own.groupBy("home").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1")
    side = F.pmod(F.xxhash64("doc_id", F.lit("speaker")), F.col("parts")).cast("int")
    return own.join(parts, "home").select("home", side.alias("a"), side.alias("b"), "doc_id", side.alias("side"))


def open_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """home, a, b, doc_id, side: the pairs of blocks of a home that hold several components and were not searched before."""
    named = stored(block_members(members, labels))
    blocks = named.groupBy("home", "own").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_and("first").alias("known"))
    mixed = blocks.groupBy("home").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("home")
    blocks = cut_lineage(blocks.join(mixed, "home"))
    other = blocks.select("home", *[F.col(c).alias(f"{c}_b") for c in ("own", "lo", "hi")])
    apart = (F.least("lo", "lo_b") != F.greatest("hi", "hi_b")) & ((F.col("own") < F.col("own_b")) | (F.col("own") == F.col("own_b")) & ~F.col("known"))
    pairs = blocks.join(other, "home").where(apart).select("home", F.col("own").alias("a"), F.col("own_b").alias("b"))
    sides = pairs.select("home", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("own"))
    return sides.join(named, ["home", "own"]).select("home", "a", "b", "doc_id", F.col("own").alias("side"))


def by_block(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of pairs with columns of facts (by doc_id), the rows of each (home, a, b) in one place and in a row."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.join(facts, "doc_id").select("home", "a", "b", "side", "doc_id", *columns)
    return rows.repartition(parts, "home", "a", "b").sortWithinPartitions("home", "a", "b")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks (the last one of a batch waits for the next batch), with the first row of each block and the end."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(j).to_numpy() for j in range(3)]
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return table, np.concatenate([[0], np.flatnonzero(change) + 1, [len(table)]])

    for batch in batches:
        if not len(batch):
            continue
        keys = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(3)]
        last = int(np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))[-1])
        if held and (last or any(held[-1].column(j)[0].as_py() != int(keys[j][0]) for j in range(3))):
            if last:
                held.append(batch.slice(0, last))
            yield out()
            held = [batch.slice(last)]
        elif last:
            held.append(batch.slice(0, last))
            yield out()
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield out()


def near_enough(block: np.ndarray, side: np.ndarray, across: np.ndarray, n: np.ndarray, words: np.ndarray, first: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Which rows have, in their block (and on the other side of it if `across`), a set that their sketches do not rule out."""
    num, den = similar
    order = np.lexsort((n, block))
    block, side, across, n = block[order], side[order], across[order], n[order]
    size = np.diff(first)[order]
    first = first[:-1][order]
    keep = np.zeros(len(order), dtype=bool)
    for shift in range(1, len(order)):
        i = np.flatnonzero(block[shift:] == block[:-shift])
        if not len(i):
            break
        j = i + shift
        pick = (den * n[i] >= num * n[j]) & ~(keep[i] & keep[j]) & (~across[i] | (side[i] != side[j]))
        i, j = i[pick], j[pick]
        if not len(i):
            continue
        width = size[i]
        begin = np.cumsum(width) - width
        step = np.arange(int(width.sum())) - np.repeat(begin, width)
        mine, other = words[np.repeat(first[i], width) + step], words[np.repeat(first[j], width) + step]
        half = size[j] == 2 * width
        fold = np.repeat(half, width)
        other[fold] ^= words[(np.repeat(first[j] + width, width) + step)[fold]]
        apart = np.add.reduceat(np.bitwise_count(mine ^ other).astype(np.int64), begin)
        both = n[i] + n[j]
        close = (apart <= both - 2 * -(-num * both // (num + den))) | (size[j] > 2 * width)
        keep[i[close]] = True
        keep[j[close]] = True
    out = np.zeros(len(order), dtype=bool)
    out[order] = keep
    return out


def may_link(pairs: DataFrame, known: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The rows of pairs whose set has, by the sketches in known (doc_id, n, sketch), a possible partner in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_blocks(batches):
            home, a, b, side, ids, n = (table.column(j).to_numpy() for j in range(6))
            data, offsets = utf8(table.column(6).combine_chunks().cast(pa.large_binary()))
            block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            keep = near_enough(block, side, a != b, n, np.frombuffer(data.tobytes(), np.uint64), offsets.astype(np.int64) // 8, similar)
            _, once = np.unique(np.stack([block[keep], ids[keep]]), axis=1, return_index=True)
            rows = np.flatnonzero(keep)[once]
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (home, a, b, ids, side)], ["home", "a", "b", "doc_id", "side"])

    return by_block(pairs, known, ["n", "sketch"]).mapInArrow(run, "home long, a int, b int, doc_id long, side int")


def search_blocks(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """u, v: stars that connect what is linked within each pair of blocks."""
    num, den = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(across: bool, ids: list, sides: list, sets: list) -> tuple[list, list]:
            order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
            order = [i for k, i in enumerate(order) if not k or ids[i] != ids[order[k - 1]]]
            found = connect([sets[i] for i in order], np.array([sides[i] for i in order]), across, num, den)
            ids = [ids[i] for i in order]
            roots = [found.find(k) for k in range(len(ids))]
            return [ids[k] for k, r in enumerate(roots) if r != k], [ids[r] for k, r in enumerate(roots) if r != k]

        for table, bounds in whole_blocks(batches):
            a, b, side, ids = (table.column(j).to_numpy() for j in range(1, 5))
            lists = table.column(5).combine_chunks()
            values, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(lists.offsets)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                u, v = solve(bool(a[lo] != b[lo]), ids[lo:hi].tolist(), side[lo:hi].tolist(), [values[offsets[i] : offsets[i + 1]] for i in range(lo, hi)])
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return by_block(pairs, sets, ["tokens"]).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable): smallest neighbour labels, then labels of labels, until nothing changes."""
    edges = cut_lineage(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = cut_lineage(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = cut_lineage(step.join(far, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("moved")))
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def link(docs: DataFrame, size: int = SHINGLE, similar: tuple[int, int] = SIMILAR, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id reachable by links).

    Documents link if den * intersection >= num * union of their shingle sets. Words are
    separated by ASCII white space, A-Z lower-cased. Null texts and texts without words
    have an empty set and link with nothing. Rows with equal texts are linked; doc_id
    should name one text (rows with one id and several texts are searched by one of them).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed_docs = stored(signatures(docs, size, similar))
    key = ["n", "s1", "s2"]
    classes = stored(signed_docs.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("doc_id")))
    heads = stored(shared_heads(signed_docs, similar).join(classes, [*key, "doc_id"], "left_semi"))
    members = stored(placed(homes(stored(shared_prefixes(heads, similar))), block))

    known = signed_docs.where("n > 0").select("doc_id", "n", "sketch")

    def search(pairs: DataFrame) -> DataFrame:
        pairs = stored(may_link(pairs, known, similar))
        wanted = bitmap(pairs.select(F.xxhash64("doc_id").alias("h")).distinct(), "h")
        return stored(search_blocks(pairs, full_sets(docs, wanted, size), similar))

    # Each set once, in its first home; then one set a component of big homes; then only blocks that still hold several components.
    edges = search(first_blocks(members))
    labels = components(edges)
    edges = edges.unionByName(search(speakers(members, labels, block)))
    labels = components(edges)
    labels = components(edges.unionByName(search(open_pairs(members, labels))))
    named = classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(*key, F.coalesce("label", "doc_id").alias("component_id"))
    return signed_docs.select("doc_id", *key).join(cut_lineage(named), key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
