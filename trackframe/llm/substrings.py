"""Exact substring removal: bytes of repeated strings of LIMIT bytes, over the whole corpus.

Every window of LIMIT bytes has an anchor inside (see suffixes.window_minima), so equal
windows lie in snippets around equal anchors. Anchors are counted in Spark; snippets around
anchors that occur more than once are brought together by anchor and settled there: equal
snippets by their hashes, then windows of different snippets by a suffix sort.

No group grows with the corpus. Long texts are worked on in pieces; equal snippets of a piece
are settled where they arise, so a text of one period ships a few rows a piece. Rows of
frequent anchors are first settled within salted parts, as many as their count asks for; the
different snippets that are left meet as they are or, where one anchor still has many, by
longer strings around the anchor and at last as single windows, thinned in salted parts again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.frames import Shared, bitmap, in_bitmap, signed, stored
from trackframe.llm.suffixes import Text, repeats, window_minima
from trackframe.llm.textbytes import CHUNK, Powers, mix, prefix_hashes, slices, span_hashes, texts, utf8

LIMIT = 100
GRAM = 32
#: anchors at least so frequent are settled in SALTS parts first; SALTS times as frequent ones in SALTS**2 parts, and so on
HOT = 1000
SALTS = 64
#: anchors with MANY times HOT different snippets are split into narrower ones; fewer are sorted together in one task
MANY = 8
#: bytes of snippets that are settled at once; a task holds some 60 times as much
BATCH = 600_000
#: bits of the filter of repeated anchors: 8 a value between these bounds (8 and 32 MB); above them it lets more through
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 26, 28

#: a snippet with its first window's start and the place of its anchor (`anchor` is set if it is frequent and `key` salted),
#: or, without snippet, a removed span of `lead` bytes from `start` on
ROWS = "key long, doc_id long, start int, lead int, anchor long, snippet binary"


def pieces(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the first byte in its text, bytes, offsets): every window of `limit` bytes lies in one piece."""
    for lo, hi in slices(column):
        data, offsets = utf8(column.slice(lo, hi - lo))
        if len(data) <= 2 * CHUNK or hi - lo > 1:
            yield lo, 0, data, offsets
            continue
        for at in range(0, len(data) - limit + 1, CHUNK):
            part = data[at : at + CHUNK + limit - 1]
            yield lo, at, part, np.array([0, len(part)])


def anchors(docs: DataFrame, limit: int, gram: int) -> DataFrame:
    """anchor: the hash of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for _, _, data, offsets in pieces(texts(batch), limit):
                h, *_ = window_minima(data, offsets, prefix_hashes(data, powers), powers, gram, limit)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h))], ["anchor"])

    return docs.mapInArrow(run, "anchor long")


def batch_of(key: np.ndarray, doc: np.ndarray, start: np.ndarray, lead: np.ndarray, anchor: pa.Array, snippet: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(signed(key)), pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(lead.astype(np.int32)), anchor, snippet]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "start", "lead", "anchor", "snippet"])


def span_batch(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Removed spans as ROWS, overlapping ones of a document joined; keys spread them."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if len(doc):
        number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
        reach = np.maximum.accumulate(end + (number << 32))  # a later document always reaches further
        first = np.flatnonzero(np.concatenate([[True], (start + (number << 32))[1:] > reach[:-1]]))
        end = (reach - (number << 32))[np.append(first[1:], len(doc)) - 1]
        doc, start = doc[first], start[first]
    key = mix(doc.astype(np.int64).view(np.uint64) ^ start.astype(np.uint64))
    return batch_of(key, doc, start, end - start, pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.binary()))


def copies(text: Text, powers: Powers, key: np.ndarray, doc: np.ndarray, start: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows equal to one of the same key that starts earlier, one row for each different snippet of a key)."""
    h = span_hashes(text.prefix, at, at + size, powers)
    order = np.lexsort((start, doc, size, h, key))
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((key[a] == key[b]) & (h[a] == h[b]) & (size[a] == size[b]))
    same = same[text.equal_bytes(at[a[same]], at[b[same]], size[a[same]])]
    linked = np.zeros(len(order), dtype=bool)
    linked[same + 1] = True
    head = order[np.maximum.accumulate(np.where(linked, 0, np.arange(len(order))))]
    later = linked & ((doc[order] > doc[head]) | ((doc[order] == doc[head]) & (start[order] > start[head])))
    return order[later], order[~linked]


def snippets(docs: DataFrame, twice: np.ndarray, often: list[np.ndarray], limit: int, gram: int) -> DataFrame:
    """ROWS: the bytes around each anchor that the bitmap says may occur twice, keyed by anchor (salted if frequent).

    Of equal snippets of a piece only the first is shipped, the others are spans.
    """
    shared = Shared(docs.sparkSession, (twice, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, (twice, often) = Powers(), shared.get()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, base, data, offsets in pieces(texts(batch), limit):
                text = Text(data, powers)
                h, place, start, windows = window_minima(data, offsets, text.prefix, powers, gram, limit)
                pick = np.flatnonzero(in_bitmap(twice, h))
                h, place, at, size = h[pick], place[pick], start[pick], windows[pick] + limit - 1
                row = np.searchsorted(offsets, at, "right") - 1
                doc, start = ids[lo + row], base + at - offsets[row]
                gone, own = copies(text, powers, h, doc, start, at, size)
                yield span_batch(doc[gone], start[gone], start[gone] + size[gone])
                h, place, at, size, doc, start = (x[own] for x in (h, place, at, size, doc, start))
                parts = np.ones(len(own), np.uint64)
                for k, level in enumerate(often):
                    parts[in_bitmap(level, h)] = SALTS ** (k + 1)
                hot = parts > 1
                salt = mix(mix(doc.view(np.uint64)) + start.astype(np.uint64)) % parts
                key = np.where(hot, mix(h ^ mix(salt + np.uint64(1))), h)
                yield batch_of(key, doc, start, place - at, pa.array(signed(h), mask=~hot), cut(data, at, size))

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, ROWS)


def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings of `size` bytes at `start` as one binary column; a piece gives some 80 MB at most."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def settle(key: np.ndarray, doc: np.ndarray, start: np.ndarray, lead: np.ndarray, hot: np.ndarray, data: np.ndarray, offsets: np.ndarray, limit: int, powers: Powers):
    """(doc, start, end) of what is removed, and the rows (numbers) of frequent anchors that are left.

    Equal snippets of a key: all but those with the first start are covered whole. The
    windows of the others are suffix-sorted by their place relative to the anchor.
    """
    text = Text(data, powers)
    size = np.diff(offsets)
    windows = size - limit + 1
    gone, own = copies(text, powers, key, doc, start, offsets[:-1], size)
    out = [(doc[gone], start[gone], start[gone] + size[gone])]
    left = own[hot[own]]
    own = own[~hot[own]]
    _, at, many = np.unique(key[own], return_inverse=True, return_counts=True)
    own = own[many[at] > 1]
    step = np.concatenate([[0], np.cumsum(windows[own])])
    lo = 0
    while lo < len(own):  # whole keys at a time, in parts of bounded size
        hi = max(lo + 1, int(np.searchsorted(step, step[lo] + BATCH // 8, "right")) - 1)
        while hi < len(own) and key[own[hi]] == key[own[hi - 1]]:
            hi += 1
        rows = own[lo:hi]
        lo = hi
        n = windows[rows]
        row = np.repeat(rows, n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        by = np.lexsort((off - lead[row], key[row]))
        row, off = row[by], off[by]
        place = off - lead[row]
        block = np.cumsum(np.concatenate([[0], (key[row][1:] != key[row][:-1]) | (place[1:] != place[:-1])]))
        first = start[row] + off
        ranked = np.lexsort((first, doc[row]))
        rank = np.empty(len(row), np.int64)
        rank[ranked] = np.cumsum(np.concatenate([[0], (doc[row][ranked][1:] != doc[row][ranked][:-1]) | (first[ranked][1:] != first[ranked][:-1])]))
        again = np.flatnonzero(repeats(text, offsets[row] + off, block, rank, limit))
        again = again[np.lexsort((off[again], row[again]))]
        r, f = row[again], first[again]
        breaks = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (f[1:] != f[:-1] + 1)])) if len(r) else np.zeros(0, np.int64)
        ends = np.append(breaks[1:], len(r)) - 1 if len(r) else breaks
        out.append((doc[r[breaks]], f[breaks], f[ends] + limit))
    return tuple(np.concatenate(x) for x in zip(*out)), left


def settle_groups(rows: DataFrame, limit: int) -> DataFrame:
    """Settle rows by key: ROWS with the removed spans and the different snippets of frequent anchors.

    Rows come sorted by key and are worked on in pieces of whole keys.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            whole = table.combine_chunks().to_batches()[0]
            whole = pa.RecordBatch.from_arrays(whole.columns, whole.schema.names)  # as the batches made here, without the flags of the scan
            done = whole.column(5).is_null()
            yield whole.filter(done)
            batch = whole.filter(pc.invert(done))
            if not len(batch):
                return
            key, doc, start, lead = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            hot = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(5).cast(pa.large_binary()))
            (d, s, e), left = settle(key, doc, start, lead, hot, data, offsets, limit, powers)
            yield span_batch(d, s, e)
            yield batch.take(pa.array(left))

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            begin = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
            if begin and size + begin * limit >= BATCH or begin and not held:
                held.append(batch.slice(0, begin))
                yield from work(pa.Table.from_batches(held))
                held, size = [batch.slice(begin)], (len(batch) - begin) * limit
            else:
                held.append(batch)
                size += len(batch) * limit
        if held:
            yield from work(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, ROWS)


def sides(rows: DataFrame, limit: int, gram: int) -> DataFrame:
    """ROWS of the two parts of each snippet, keyed by a longer string than the anchor.

    A window holds its anchor and `limit - gram` other bytes, so half of these before the anchor or
    half of them behind it. The first kind of windows of a snippet becomes one row keyed by the
    anchor with what stands before it, the other windows a row keyed by the anchor with what follows.
    """
    half = (limit - gram) // 2
    after = limit - half + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for whole in batches:
            for k in range(0, len(whole), 2000):
                batch = whole.slice(k, 2000)
                doc, start, lead = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
                data, offsets = utf8(batch.column(5).cast(pa.large_binary()))
                prefix, at, n = prefix_hashes(data, powers), offsets[:-1], np.diff(offsets) - limit + 1
                own = np.flatnonzero(lead >= half)
                many = np.minimum(lead[own] - half + 1, n[own])
                h = mix(span_hashes(prefix, at[own] + lead[own] - half, at[own] + lead[own] + gram, powers))
                yield batch_of(h, doc[own], start[own], lead[own], pa.array(signed(h)), cut(data, at[own], many + limit - 1))
                skip = np.maximum(lead - half + 1, 0)
                own = np.flatnonzero(skip < n)
                skip = skip[own]
                h = span_hashes(prefix, at[own] + lead[own], at[own] + lead[own] + after, powers)
                yield batch_of(h, doc[own], start[own] + skip, lead[own] - skip, pa.array(signed(h)), cut(data, at[own] + skip, n[own] - skip + limit - 1))

    return rows.mapInArrow(run, ROWS)


def single_windows(rows: DataFrame, limit: int) -> DataFrame:
    """ROWS of each window of each snippet by itself, its hash as key and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for whole in batches:
            for k in range(0, len(whole), 2000):
                batch = whole.slice(k, 2000)
                doc, start = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
                data, offsets = utf8(batch.column(5).cast(pa.large_binary()))
                n = np.diff(offsets) - limit + 1
                row = np.repeat(np.arange(len(n)), n)
                off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[row] + off
                h = span_hashes(prefix_hashes(data, powers), at, at + limit, powers)
                yield batch_of(h, doc[row], start[row] + off, np.zeros(len(row)), pa.array(signed(h)), cut(data, at, np.full(len(row), limit)))

    return rows.mapInArrow(run, ROWS)


def levels(most: int, hot: int) -> int:
    """How often a group of `most` rows is to be divided by SALTS to have fewer than `hot`."""
    n = 0
    while most >= hot * SALTS**n:
        n += 1
    return n


def widened(values: DataFrame, column: str, n: int, least: int = LEAST_BITS) -> np.ndarray:
    """A bitmap with BITS_EACH bits for each of n values, within bounds."""
    return bitmap(values, column, min(max(math.ceil(math.log2(max(n, 1) * BITS_EACH)), least), MOST_BITS))


def removed_spans(docs: DataFrame, limit: int = LIMIT, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, start, end: byte spans that cover every repeated window; spans may overlap."""
    counts = stored(anchors(docs, limit, gram).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= 2))
    facts = counts.agg(F.count("*").alias("anchors"), F.sum((F.col("n") >= hot).cast("long")).alias("often"), F.max("n").alias("most")).first()
    deep = levels(facts["most"] or 0, hot)
    often = [widened(counts.where(F.col("n") >= hot * SALTS**k), "anchor", facts["often"], 20) for k in range(deep)]
    found = []

    def settled(rows: DataFrame) -> DataFrame:
        """Settle, keep the spans, return what is left of frequent anchors."""
        done = stored(settle_groups(rows, limit))
        found.append(done.where(F.col("snippet").isNull()).select("doc_id", "start", (F.col("start") + F.col("lead")).alias("end")))
        return done.where(F.col("snippet").isNotNull())

    def thinned(rows: DataFrame, deep: int) -> DataFrame:
        """Settle within fewer and fewer salted parts of each anchor."""
        for k in range(deep, 0, -1):
            rows = settled(rows.withColumn("key", F.xxhash64("anchor", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS**k)))))
        return rows

    def spread(rows: DataFrame) -> DataFrame:
        rows = stored(rows)
        return thinned(rows, levels(rows.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0, hot))

    plain = lambda rows: rows.withColumn("key", F.col("anchor")).withColumn("anchor", F.lit(None).cast("long"))

    def meet(rows: DataFrame) -> DataFrame:
        """Settle the anchors that are left with few different snippets, return the rows of the others."""
        counts = stored(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= 2))
        settled(plain(rows.join(counts.where(F.col("n") < MANY * hot), "anchor", "left_semi").select(*rows.columns)))
        return rows.join(counts.where(F.col("n") >= MANY * hot), "anchor", "left_semi").select(*rows.columns)

    left = settled(snippets(docs, widened(counts, "anchor", facts["anchors"]), often, limit, gram))
    if deep:
        left = meet(thinned(left, deep - 1))
        if not left.isEmpty():
            left = meet(spread(sides(left, limit, gram)))
            if not left.isEmpty():
                settled(plain(spread(single_windows(left, limit))))  # what is left of a window are equal copies, SALTS at most
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, limit: int = LIMIT, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256.

    A null text is empty. Rows with one id count as one document: they do not repeat each
    other at equal starts. Rows without an id are left whole and remove nothing elsewhere. Only
    texts that lose something are shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = removed_spans(docs, limit, gram, hot)
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    lists = stored(lists)
    touched = Shared(docs.sparkSession, bitmap(lists.select(F.xxhash64("doc_id").alias("h")), "h"))
    keyed = docs.withColumn("h", F.xxhash64("doc_id"))

    def may_lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = touched.get()
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(known, batch.column(2).to_numpy(zero_copy_only=False))))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield without(texts(batch), batch.column(0), batch.column(3).to_pylist())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = touched.get()
        for batch in batches:
            batch = batch.filter(pa.array(~in_bitmap(known, batch.column(2).to_numpy(zero_copy_only=False))))
            yield without(texts(batch), batch.column(0), [None] * len(batch))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    cut_rows = keyed.mapInArrow(may_lose, keyed.schema).join(lists, "doc_id", "left").select("doc_id", "text", "h", "spans")
    return keyed.mapInArrow(keep, schema).unionByName(cut_rows.mapInArrow(finish, schema))


def without(column: pa.Array, ids: pa.Array, spans: list) -> pa.RecordBatch:
    """Each text without its spans: sizes, number of merged spans, the bytes left and their digest."""
    sizes, removed, count, kept, sha = [], [], [], [], []
    for text, found in zip(column, spans):
        data = text.as_buffer().to_pybytes()
        gone = merged([(s["start"], s["end"]) for s in found or ()])
        parts, at = [], 0
        for a, b in gone:
            parts.append(data[at:a])
            at = b
        left = b"".join([*parts, data[at:]])
        sizes.append(len(data))
        removed.append(len(data) - len(left))
        count.append(len(gone))
        kept.append(left)
        sha.append(hashlib.sha256(left).hexdigest())
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (sizes, removed, count)), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
