"""Splits, duplicates, leakage and inventory over file and sequence manifests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackframe.functions.columns import once
from trackframe.functions.groups import spread, whole_groups
from trackframe.functions.lineage import cut_lineage
from trackframe.functions.ranks import bucket_rank

# Hex digits of the digest that order a split.
SPLIT_DIGITS = 8
# Which split keeps an image when two splits hold it.
PRIORITY = {"train": 0, "validation": 1, "test": 2}
# Binary logarithm of how many signatures may share a key: comparing them costs less than copying all of them once more.
CROWD = 6
# Keys of more signatures are compared alone, this many pairs at a time.
SMALL, CELLS = 256, 1 << 20


def hash_order(ids: DataFrame, column: str, salt: Column | str, digits: int = 64) -> DataFrame:
    """Distinct ids with `rank` = 1, 2, … by the first `digits` hex digits of SHA-256 of salt + id, ties by id.

    A uniform hash splits into 4096 prefix buckets; a rank is the size of the earlier
    buckets plus the place in one's own, so no task ever orders all ids.
    """
    salt = F.lit(salt) if isinstance(salt, str) else salt
    text = F.concat(salt, F.col(column))
    d = ids.select(column).distinct().withColumn("_h", F.sha2(text, 256)).withColumn("_b", F.substring("_h", 1, 3)).withColumn("_g", F.lit(1))
    return bucket_rank(d, ["_g"], "_b", [F.substring("_h", 1, digits), column]).select(column, "_h", "rank")


def hash_split(ids: DataFrame, column: str = "sequence_id", dev: float = 0.6, val: float = 0.2, test: float = 0.2, seed: int = 26) -> DataFrame:
    """Disjoint development / validation / test membership by seeded hash order.

    Counts round half to even; from three ids on no split stays empty.
    """
    if abs(dev + val + test - 1.0) > 1e-5:
        raise ValueError("split ratios must sum to 1")
    ranked = hash_order(ids, column, f"{seed}:", SPLIT_DIGITS)
    n = F.col("n")
    total = ranked.agg(F.count("*").alias("n"))
    cuts = total.withColumn("v", F.bround(n * val).cast("long")).withColumn("d", F.bround(n * dev).cast("long"))
    cuts = cuts.withColumn("v", F.when((n >= 3) & (F.col("v") == 0), 1).otherwise(F.col("v")))
    short = (n >= 3) & (n - F.col("d") - F.col("v") <= 0)
    cuts = cuts.withColumn("d", F.when(short, F.greatest(F.lit(1), n - F.col("v") - 1)).otherwise(F.col("d")))
    first = cuts.select("d").scalar()
    second = cuts.select(F.col("d") + F.col("v")).scalar()
    split = F.when(F.col("rank") <= first, "development").when(F.col("rank") <= second, "validation").otherwise("test")
    return ranked.select(column, split.alias("split"))


def sample_sequences(ids: DataFrame, n: int, column: str = "sequence_id", seed: int = 26) -> DataFrame:
    """n whole sequences, uniform by seeded hash, without looking at any label."""
    if n < 1:
        raise ValueError("n must be positive")
    d = ids.select(column).distinct()
    return d.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column)), 256), column).limit(n)


def salted_order_groups(ids: DataFrame, salt: str, sizes: dict[str, int], exclude: DataFrame | None = None, column: str = "sequence_id") -> DataFrame:
    """Consecutive groups of the given sizes in salted hash order, known ids left out."""
    pool = ids if exclude is None else ids.join(exclude.select(column), column, "left_anti")
    ranked = hash_order(pool, column, salt)
    group, start = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        group = F.when(F.col("rank").between(start + 1, start + size), F.lit(name)).otherwise(group)
        start += size
    return ranked.select(column, group.alias("group")).where("group is not null")


def exact_duplicates(manifest: DataFrame, digest: str = "sha256") -> DataFrame:
    """Digests shared by several files: how many, in which splits, does it cross.

    Counts combine before the shuffle, so a digest that holds a third of all files is
    no larger than any other; the members stay in the manifest (`duplicate_members`).
    """
    g = manifest.groupBy(digest).agg(
        F.count("*").alias("files"), F.min("name").alias("first_name"), F.count_distinct("source", "split").alias("places"),
        F.array_sort(F.collect_set("split")).alias("splits"),
    )
    return g.where("files > 1").withColumn("crosses_splits", F.size("splits") > 1)


def duplicate_members(manifest: DataFrame, digest: str = "sha256") -> DataFrame:
    """Manifest rows that belong to a duplicate group."""
    return manifest.join(exact_duplicates(manifest, digest).select(digest), digest, "left_semi")


def split_overlap_guard(manifest: DataFrame, digest: str = "sha256", group: str = "split") -> DataFrame:
    """Digests present in more than one group; an empty result means no leak."""
    return manifest.groupBy(digest).agg(
        F.count_distinct(group).alias("groups"), F.array_sort(F.collect_set(group)).alias("names")
    ).where("groups > 1")


def median_signature(df: DataFrame, descriptor: str = "descriptor") -> DataFrame:
    """64-bit signature: bit i says that element i lies above the descriptor's median.

    A descriptor of more than 64 numbers has no such signature and stops the job.
    """
    def middle(d: Column) -> Column:
        n = F.when(F.size(d) <= 64, F.size(d)).otherwise(F.raise_error(F.lit("a descriptor holds more than 64 numbers")).cast("int"))
        at = lambda s, i: F.element_at(s, i.cast("int")).cast("double")
        return F.when(F.size(d) > 0, once(F.sort_array(d), lambda s: (at(s, (n + 1) / 2) + at(s, F.floor(n / 2) + 1)) / 2))

    bit = lambda x, i, m: F.when(x > m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = lambda d: once(middle(d), lambda m: F.aggregate(F.transform(d, lambda x, i: bit(x, i, m)), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x)))
    return df.withColumn("signature", once(F.col(descriptor), bits))


def agreeing_bands(signatures: int, max_hamming: int) -> int:
    """How many bands a key should hold, so that keys are at most CROWD bits narrower than the logarithm of the number of signatures.

    With b = max_hamming + e bands, e of them have 64 * e / b bits.
    """
    e = 1
    while e < 8 and 64 * e / (max_hamming + e) < math.log2(max(signatures, 2)) - CROWD:
        e += 1
    return e


def banded(signatures: DataFrame, max_hamming: int, extra_bands: int | None) -> tuple[DataFrame, list[int], int]:
    """(signatures once per choice of bands, with choice and key, the rows of a key in a row; bits of each band; bands of a choice).

    Of max_hamming + extra_bands bit bands at least `extra_bands` agree on any pair within
    the limit, so such a pair shares the key of some choice of that many bands. The number
    is chosen from the count of signatures: keys widen as they grow.
    """
    if not 0 <= max_hamming <= 56:
        raise ValueError("max_hamming must leave room for bands in 64 bits")
    extra = extra_bands or agreeing_bands(signatures.count(), max_hamming)
    edges = [round(64 * b / (max_hamming + extra)) for b in range(max_hamming + extra + 1)]
    bands = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    as_long = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = F.array(*[F.lit(as_long(sum(chosen))).cast("long") for chosen in combinations(bands, extra)])
    keyed = signatures.select("*", F.posexplode(masks).alias("choice", "mask"))
    keyed = keyed.select("choice", F.col("signature").bitwiseAND(F.col("mask")).alias("key"), *signatures.columns)
    return spread(keyed, ["choice", "key"]).sortWithinPartitions("choice", "key"), bands, extra


def near_rows(signature: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers a < b of all pairs of one key within the limit; the rows of a key begin at `starts`.

    Small keys are compared all together, a distance of rows at a time, large ones in blocks.
    """
    ends = np.append(starts[1:], len(signature))
    size = ends - starts
    end = np.repeat(np.where(size <= SMALL, ends, starts), size)
    a, shift = np.flatnonzero(np.arange(1, len(signature) + 1) < end), 1
    while len(a):
        near = a[np.bitwise_count(signature[a] ^ signature[a + shift]) <= limit]
        yield near, near + shift
        shift += 1
        a = a[a + shift < end[a]]
    for lo, hi in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist()):
        step = max(1, CELLS // (hi - lo))
        for at in range(lo, hi, step):
            a, b = np.nonzero(np.bitwise_count(signature[at : min(at + step, hi), None] ^ signature[None, at:hi]) <= limit)
            yield a[a < b] + at, b[a < b] + at


def first_agreeing(differing: np.ndarray, bands: list[int], extra: int) -> np.ndarray:
    """The bits of the first `extra` bands in which no bit differs."""
    mask, found = np.zeros(len(differing), dtype=np.uint64), np.zeros(len(differing), dtype=np.int64)
    for band in bands:
        same = ((differing & np.uint64(band)) == 0) & (found < extra)
        mask[same] |= np.uint64(band)
        found += same
    return mask


def near_signatures(signed: DataFrame, max_hamming: int = 6, extra_bands: int | None = None) -> DataFrame:
    """(signature, other): every ordered pair of occurring signatures within the limit,
    each signature with itself included.

    Signatures meet under the keys of `banded` and are compared there. A pair is kept at
    its first agreeing choice only; nothing has to be made distinct afterwards.
    """
    distinct = cut_lineage(signed.select("signature").where("signature is not null").distinct())
    keyed, bands, extra = banded(distinct, max_hamming, extra_bands)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = np.array([sum(chosen) for chosen in combinations(bands, extra)], dtype=np.uint64)
        for batch, starts in whole_groups(batches, ["choice", "key"]):
            signature, own = batch["signature"].to_numpy().view(np.uint64), masks[batch["choice"].to_numpy()]
            for a, b in near_rows(signature, starts, max_hamming):
                first = first_agreeing(signature[a] ^ signature[b], bands, extra) == own[a]
                a, b = signature[a[first]].view(np.int64), signature[b[first]].view(np.int64)
                if len(a):
                    yield pd.DataFrame({"signature": np.concatenate([a, b]), "other": np.concatenate([b, a])})

    return keyed.mapInPandas(run, "signature long, other long").unionByName(distinct.select("signature", F.col("signature").alias("other")))


def near_best(ranked: DataFrame, max_hamming: int = 6, extra_bands: int | None = None) -> DataFrame:
    """(signature, _best): the highest `_top` among a signature and those within the limit, from one row per signature (signature, _top).

    Pairs stay in the tasks: a key gives each of its signatures one row at most.
    """
    keyed, _, _ = banded(ranked, max_hamming, extra_bands)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, starts in whole_groups(batches, ["choice", "key"]):
            signature, top = batch["signature"].to_numpy(), batch["_top"].to_numpy()
            best = top.copy()
            for a, b in near_rows(signature.view(np.uint64), starts, max_hamming):
                np.maximum.at(best, a, top[b])
                np.maximum.at(best, b, top[a])
            found = best > top
            yield pd.DataFrame({"signature": signature[found], "_best": best[found]}).drop_duplicates()

    found = keyed.mapInPandas(run, "signature long, _best int").unionByName(ranked.select("signature", F.col("_top").alias("_best")))
    return found.groupBy("signature").agg(F.max("_best").alias("_best"))


def near_duplicates(
    items: DataFrame, max_hamming: int = 6, name: str = "name", split: str = "split", descriptor: str = "descriptor", extra_bands: int | None = None
) -> DataFrame:
    """Report of near pairs between distinct descriptors of different splits.

    Files with one descriptor and one split are folded into a group first, so copies
    never multiply pairs: a row is a pair of groups with sizes, first names, bit
    distance and correlation. To clean splits use `near_leaks`, which needs no pairs.
    """
    sig = median_signature(items, descriptor)
    groups = sig.groupBy(split, "signature", F.col(descriptor).alias("descriptor")).agg(F.count("*").alias("files"), F.min(name).alias("first_name"))
    # Centred numbers and their length belong to a group, not to each of its pairs.
    mean = lambda d: F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x) / F.size(d)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    centred = once(F.col("descriptor"), lambda d: once(mean(d), lambda m: F.transform(d, lambda x: x - m)))
    groups = cut_lineage(groups.withColumn("centred", centred).withColumn("length", once(F.col("centred"), lambda c: F.sqrt(dot(c, c)))).drop("descriptor"))
    close = near_signatures(groups, max_hamming, extra_bands)
    left = groups.select(*[F.col(c).alias(f"l_{c}") for c in groups.columns])
    right = groups.select(*[F.col(c).alias(f"r_{c}") for c in groups.columns])
    pairs = (
        close.join(left, F.col("signature") == F.col("l_signature")).join(right, F.col("other") == F.col("r_signature"))
        .where((F.col(f"l_{split}") != F.col(f"r_{split}")) & (F.col("l_first_name") < F.col("r_first_name")))
    )
    pairs = pairs.withColumns({"_num": dot(F.col("l_centred"), F.col("r_centred")), "_den": F.col("l_length") * F.col("r_length")})
    return pairs.select(
        F.col("l_first_name").alias("left"), F.col(f"l_{split}").alias("left_split"), F.col("l_files").alias("left_files"),
        F.col("r_first_name").alias("right"), F.col(f"r_{split}").alias("right_split"), F.col("r_files").alias("right_files"),
        F.bit_count(F.col("signature").bitwiseXOR(F.col("other"))).alias("hamming"),
        F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(0.0).alias("correlation"),
    )


def near_leaks(items: DataFrame, max_hamming: int = 6, name: str = "name", descriptor: str = "descriptor", extra_bands: int | None = None) -> DataFrame:
    """Names that have a near partner in a higher-priority split: (name, reason).

    The same files as "of every near pair drop the lower-priority one", decided per
    signature: the highest priority among near signatures against one's own. Work
    grows with the signatures, not with the pairs of a crowded one.
    """
    sig = cut_lineage(median_signature(items, descriptor).select(name, "signature", rank_of(F.col("split")).alias("_rank")))
    top = cut_lineage(sig.where("signature is not null").groupBy("signature").agg(F.coalesce(F.max("_rank"), F.lit(-1)).alias("_top")))
    best = near_best(top, max_hamming, extra_bands)
    return sig.join(best, "signature").where("_best > _rank").select(name, F.lit("cross_split_near").alias("reason"))


def rank_of(split: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[split]


def leakage_filter(
    records: DataFrame, near_pairs: DataFrame | None = None, digests: Sequence[str] = ("sha256",), errors: DataFrame | None = None, leaks: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept records, exclusions with reasons); nothing moves between splits.

    records(name, split, digests…); near_pairs(left, right), or leaks(name, reason) from
    `near_leaks`, which needs no pairs. Of a near pair the
    lower-priority split's member goes (the left one on a tie); of an exact group all
    but the highest-priority, first-named file; invalid rows go with their error. Group winners
    come from a combinable minimum, not from sorting a group.
    """
    parts = [] if leaks is None else [leaks.select("name", "reason")]
    side = lambda c: records.select(F.col("name").alias(c), rank_of(F.col("split")).alias(f"{c}_rank"))
    if near_pairs is not None:
        near = near_pairs.select("left", "right").join(side("left"), "left").join(side("right"), "right")
        parts.append(near.select(F.when(F.col("right_rank") < F.col("left_rank"), F.col("right")).otherwise(F.col("left")).alias("name"), F.lit("cross_split_near").alias("reason")))
    for digest in digests:
        order = F.struct((-rank_of(F.col("split"))).alias("p"), F.col("name").alias("name"))
        keep = records.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(order)["name"].alias("winner"), F.count("*").alias("n")).where("n > 1")
        parts.append(records.join(keep, digest).where("name <> winner").select("name", F.lit(digest).alias("reason")))
    if errors is not None:
        parts.append(errors.select("name", F.concat(F.lit("invalid_image_or_label: "), F.col("error")).alias("reason")))
    reasons = parts[0]
    for p in parts[1:]:
        reasons = reasons.unionByName(p)
    excluded = reasons.distinct().groupBy("name").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return records.join(excluded.select("name"), "name", "left_anti"), excluded


def missing_and_orphans(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """Image ids without a label and label ids without an image."""
    i, l = images.select(key).distinct(), labels.select(key).distinct()
    return i.join(l, key, "left_anti").select(key, F.lit("missing_label").alias("problem")).unionByName(
        l.join(i, key, "left_anti").select(key, F.lit("orphan_label").alias("problem"))
    )


def inventory(files: DataFrame, max_pixels: int = 4_000_000) -> DataFrame:
    """Counts per source by size, by mode and by split in one pass, plus oversize files."""
    f = files.withColumn("dimensions", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))
    over = F.count_if(F.col("width").cast("long") * F.col("height") > max_pixels)
    g = f.groupingSets([["source", "dimensions"], ["source", "mode"], ["source", "split"]], "source", "dimensions", "mode", "split").agg(
        F.count("*").alias("files"), over.alias("oversize"), F.grouping_id().alias("gid")
    )
    facet = F.when(F.col("dimensions").isNotNull(), "dimensions").when(F.col("mode").isNotNull(), "mode").otherwise("split")
    return g.select("source", facet.alias("facet"), F.coalesce("dimensions", "mode", "split").alias("value"), "files", "oversize")


def split_completeness(frames: DataFrame, per_sequence: int = 5) -> DataFrame:
    """Sequences of a split that do not hold exactly frames 1..per_sequence."""
    want = F.lit(per_sequence)
    s = frames.groupBy("split", "sequence_id").agg(
        F.count("*").alias("n"), F.count_distinct("frame").alias("distinct_frames"), F.min("frame").alias("lo"), F.max("frame").alias("hi")
    )
    whole = (F.col("n") == want) & (F.col("distinct_frames") == want) & (F.col("lo") == 1) & (F.col("hi") == want)
    return s.where(~whole)


def label_file_match(split_ids: DataFrame, label_ids: DataFrame) -> DataFrame:
    """For each label file: do its sequence ids equal the split's ids?

    split_ids(split, sequence_id); label_ids(file, sequence_id). Exactly one file per
    split should match; a file and a split without a common id are not listed.
    """
    want = split_ids.select("split", "sequence_id").distinct()
    have = label_ids.select("file", "sequence_id").distinct()
    need = want.groupBy("split").agg(F.count("*").alias("need"))
    got = have.groupBy("file").agg(F.count("*").alias("got"))
    both = have.join(want, "sequence_id").groupBy("file", "split").agg(F.count("*").alias("common"))
    j = both.join(need, "split").join(got, "file")
    return j.select("file", "split", ((F.col("common") == F.col("need")) & (F.col("common") == F.col("got"))).alias("matches"))


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "name", digest: str = "sha256") -> DataFrame:
    """Files added, removed or changed between two manifests."""
    o, n = old.select(key, F.col(digest).alias("was"), F.lit(True).alias("o")), new.select(key, F.col(digest).alias("now"), F.lit(True).alias("n"))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def balanced_sample(rows: DataFrame, label: str = "positive", sizes: dict = {True: 48, False: 16}, key: str = "name", seed: int = 26) -> DataFrame:
    """The first `sizes[class]` rows of each class in seeded hash order, train only.

    Top-k per class: Spark keeps at most k rows per task before the shuffle.
    """
    order = W.partitionBy(label).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), key)
    limit = F.when(F.col(label), sizes[True]).otherwise(sizes[False])
    ranked = rows.where("split = 'train'").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(sizes.values()))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")


def split_class_counts(records: DataFrame) -> DataFrame:
    """Images, positives, negatives and boxes per split, with label states.

    records(split, boxes int, has_label boolean, valid boolean).
    """
    state = F.when(~F.col("valid"), "invalid").when(F.col("boxes") > 0, "positive").when(F.col("has_label"), "empty_file").otherwise("missing_assumed_negative")
    r = records.withColumn("state", state)
    return r.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if("has_label").alias("label_files"), F.sum("boxes").alias("boxes"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("positive", "empty_file", "missing_assumed_negative", "invalid")],
    )


def prior_use_exclusions(candidates: DataFrame, memberships: Sequence[DataFrame]) -> DataFrame:
    """Candidates (split, sequence_id) that no membership table has used before."""
    key = ["split", "sequence_id"]
    used = memberships[0].select(*key)
    for m in memberships[1:]:
        used = used.unionByName(m.select(*key))
    return candidates.join(used.distinct(), key, "left_anti")


def empty_sequences(labels: DataFrame) -> DataFrame:
    """Sequences without any labelled object. labels(sequence_id, num_objects)."""
    return labels.groupBy("sequence_id").agg(F.sum("num_objects").alias("objects")).where("objects = 0").select("sequence_id")


def first_examples(labels: DataFrame) -> DataFrame:
    """Smallest (numeric) sequence id that is empty and smallest that is not."""
    s = labels.groupBy("sequence_id").agg(F.sum("num_objects").alias("objects"))
    number = F.col("sequence_id").cast("bigint")
    return s.agg(F.min(F.when(F.col("objects") == 0, number)).alias("first_empty"), F.min(F.when(F.col("objects") > 0, number)).alias("first_non_empty"))


def outputs_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: are two outputs equal as bags of rows, and how many rows differ.

    Row counts per distinct row are compared, so repeated rows count too.
    """
    cols = a.columns
    if sorted(cols) != sorted(b.columns):
        raise ValueError("outputs have different columns")
    tall = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s")))
    diff = tall.groupBy(*cols).agg(F.sum("_s").alias("_d")).where("_d <> 0")
    return diff.agg(
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias("only_in_a"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias("only_in_b"),
    ).withColumn("equal", (F.col("only_in_a") == 0) & (F.col("only_in_b") == 0))
