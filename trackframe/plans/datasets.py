"""Queries: splits, duplicates, leakage, inventory and scoring."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackframe.operators import datasets as ds
from trackframe.operators import scoring as sc
from trackframe.plans import views as v
from trackframe.plans.registry import query
from trackframe.plans.trajectory import r6


def customer_ids(spark, d):
    return v.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sequence_id"))


CUST = "cust AS (SELECT CAST(c_custkey AS VARCHAR) AS sequence_id FROM customer)"


@query("hash_split", v.sql("", """
    SELECT sequence_id, CASE WHEN rk <= nd THEN 'development' WHEN rk <= nd + nv THEN 'validation' ELSE 'test' END AS split FROM (
      SELECT sequence_id, row_number() OVER (ORDER BY substr(sha256('26:' || sequence_id), 1, 8), sequence_id) AS rk,
        CAST(round_even(count(*) OVER () * 0.6::DOUBLE, 0) AS BIGINT) AS nd, CAST(round_even(count(*) OVER () * 0.2::DOUBLE, 0) AS BIGINT) AS nv FROM cust)""", CUST))
def _(spark, d):
    return ds.hash_split(customer_ids(spark, d))


@query("sample_sequences", v.sql("", "SELECT sequence_id FROM cust ORDER BY sha256('26:' || sequence_id), sequence_id LIMIT 24", CUST))
def _(spark, d):
    return ds.sample_sequences(customer_ids(spark, d), 24)


@query("salted_order_groups", v.sql("", """
    SELECT sequence_id, CASE WHEN rk <= 40 THEN 'train' ELSE 'validation' END AS "group" FROM (
      SELECT c.sequence_id, row_number() OVER (ORDER BY sha256('assess-v1:' || c.sequence_id), c.sequence_id) AS rk
      FROM cust c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE CAST(s.s_suppkey AS VARCHAR) = c.sequence_id)) WHERE rk <= 60""", CUST))
def _(spark, d):
    known = v.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sequence_id"))
    return ds.salted_order_groups(customer_ids(spark, d), "assess-v1:", {"train": 40, "validation": 20}, known)


@query("exact_duplicates", v.sql("manifest", """
    SELECT sha256, count(*) AS files, min(name) AS first_name, count(DISTINCT source || '/' || split) AS places,
      string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) > 1 AS crosses_splits FROM manifest GROUP BY 1 HAVING count(*) > 1"""))
def _(spark, d):
    return ds.exact_duplicates(v.manifest(spark, d)).withColumn("splits", F.array_join("splits", ","))


@query("duplicate_members", v.sql("manifest", """
    SELECT sha256, name, source, split FROM manifest WHERE sha256 IN (SELECT sha256 FROM manifest GROUP BY 1 HAVING count(*) > 1)"""))
def _(spark, d):
    return ds.duplicate_members(v.manifest(spark, d)).select("sha256", "name", "source", "split")


@query("split_overlap_guard", v.sql("manifest", """
    SELECT sha256, count(DISTINCT source) AS groups, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM manifest GROUP BY 1 HAVING count(DISTINCT source) > 1"""))
def _(spark, d):
    return ds.split_overlap_guard(v.manifest(spark, d), group="source").withColumn("names", F.array_join("names", ","))


class Cells(dict):
    """The digest class of a word, remembered for the first words only; the empty word has a class of its own."""

    def __missing__(self, word: str) -> int:
        cell = hashlib.md5(word.encode(), usedforsecurity=False).digest()[0] >> 2 if word else 64
        if len(self) < 1 << 18:
            self[word] = cell
        return cell


def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and how many words of the text fall into each of 64 classes, of rows whose text has a word."""
    known = Cells()
    for batch in batches:
        rows, counts = [], []
        for i, text in enumerate(batch.column(1)):
            words = (text.as_py() or "").replace("\n", " ").split(" ")
            n = np.bincount(np.frombuffer(bytes(map(known.__getitem__, words)), np.uint8), minlength=65)[:64]
            if n.any():
                rows.append(i)
                counts.append(n)
        if rows:
            lists = pa.ListArray.from_arrays(np.arange(0, 64 * len(rows) + 1, 64, dtype=np.int32), np.concatenate(counts).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["doc_id", "n"])


def described(spark, d):
    """Documents by 64 numbers: how many of their words fall into each of 64 digest classes. Copies and near copies come close."""
    docs = v.read(spark, d, "documents").select("doc_id", "text")
    counts = docs.mapInArrow(count_cells, T.StructType([docs.schema["doc_id"], T.StructField("n", T.ArrayType(T.LongType()))]))
    m = counts.groupBy("doc_id").agg(*[F.sum(F.col("n")[i]).cast("double").alias(f"n{i}") for i in range(64)])
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test")
    return m.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), split.alias("split"), F.array(*[f"n{i}" for i in range(64)]).alias("descriptor"))


NEAR_LIMIT = 6

NEAR = """wd AS (SELECT doc_id, CAST(floor(CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) / 4) AS INTEGER) AS cell FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS w FROM documents)),
    hs AS (SELECT doc_id, map_from_entries(list((cell, n))) AS m FROM (SELECT doc_id, cell, count(*) AS n FROM wd GROUP BY ALL) GROUP BY 1),
    ds AS (SELECT 'doc-' || doc_id AS name, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
      [CAST(coalesce(m[i], 0) AS DOUBLE) FOR i IN range(0, 64)] AS e FROM hs),
    sg AS (SELECT name, split, e, list_sum([CASE WHEN e[i + 1] > (s[32] + s[33]) / 2 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END FOR i IN range(0, 64)])::UBIGINT AS bits FROM (SELECT *, list_sort(e) AS s FROM ds)),
    gr AS (SELECT split, bits, e, count(*) AS files, min(name) AS first_name FROM sg GROUP BY ALL),
    nr AS (SELECT a.first_name AS "left", a.split AS left_split, a.files AS left_files, b.first_name AS "right", b.split AS right_split, b.files AS right_files,
      CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) AS hamming, a.e AS ae, b.e AS be
      FROM gr a JOIN gr b ON a.split <> b.split AND a.first_name < b.first_name)"""


@query("near_duplicates", v.sql("", f"SELECT * EXCLUDE (ae, be) FROM nr WHERE hamming <= {NEAR_LIMIT}", NEAR))
def _(spark, d):
    return ds.near_duplicates(described(spark, d), NEAR_LIMIT).drop("correlation")


LEAKS = NEAR + f""", lp AS (SELECT name, bits, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS p FROM sg),
    lk AS (SELECT name, 'cross_split_near' AS reason FROM lp a WHERE EXISTS (SELECT 1 FROM lp b WHERE b.p > a.p AND bit_count(xor(a.bits, b.bits)) <= {NEAR_LIMIT}))"""


@query("near_leaks", v.sql("", "SELECT name, reason FROM lk", LEAKS))
def _(spark, d):
    return ds.near_leaks(described(spark, d), NEAR_LIMIT)


@query("near_duplicate_correlation", v.sql("", f"""
    SELECT "left", "right", round(corr(x, y), 6) AS correlation FROM (
      SELECT "left", "right", unnest([CAST(q AS DOUBLE) FOR q IN ae]) AS x, unnest([CAST(q AS DOUBLE) FOR q IN be]) AS y FROM nr WHERE hamming <= {NEAR_LIMIT}) GROUP BY ALL""", NEAR))
def _(spark, d):
    return ds.near_duplicates(described(spark, d), NEAR_LIMIT).select("left", "right", *r6("correlation"))


def records(spark, d):
    """Document manifest as image records: split by id as the descriptors are, exact groups by text hash."""
    number = F.substring("name", 5, 20).cast("long") % 10
    return v.manifest(spark, d).withColumn("split", F.when(number < 6, "train").when(number < 8, "validation").otherwise("test"))


RECORDS = LEAKS + """, pr AS (SELECT name, sha256, size, CASE WHEN CAST(substr(name, 5) AS BIGINT) % 10 < 6 THEN 0 WHEN CAST(substr(name, 5) AS BIGINT) % 10 < 8 THEN 1 ELSE 2 END AS p FROM manifest)"""


@query("leakage_filter", v.sql("manifest", """
    SELECT name, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (
      SELECT name, reason FROM lk
      UNION ALL SELECT name, 'sha256' FROM (SELECT name, row_number() OVER (PARTITION BY sha256 ORDER BY p DESC, name) AS rn FROM pr) WHERE rn > 1
      UNION ALL SELECT name, 'invalid_image_or_label: too_short' FROM pr WHERE size < 20) GROUP BY name""", RECORDS))
def _(spark, d):
    r = records(spark, d)
    errors = r.where("size < 20").select("name", F.lit("too_short").alias("error"))
    leaks = ds.near_leaks(described(spark, d), NEAR_LIMIT)
    return ds.leakage_filter(r, errors=errors, leaks=leaks)[1].withColumn("reasons", F.array_join("reasons", ","))


@query("missing_and_orphans", v.sql("", """
    SELECT doc_id AS stem, 'missing_label' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'orphan_label' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""))
def _(spark, d):
    stem = lambda t: v.read(spark, d, t).select(F.col("doc_id").alias("stem"))
    return ds.missing_and_orphans(stem("documents"), stem("labels"))


def files(spark, d):
    x = v.read(spark, d, "documents")
    return x.select(
        "source", F.col("lang").alias("mode"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
        F.greatest(F.col("n_chars"), F.lit(1)).alias("width"), F.lit(480).cast("long").alias("height"),
    )


@query("inventory", v.sql("", """
    SELECT source, facet, value, count(*) AS files, count(*) FILTER (w * 480 > 4000000) AS oversize FROM (
      SELECT source, greatest(n_chars, 1) AS w, unnest(['dimensions', 'mode', 'split']) AS facet,
        unnest([greatest(n_chars, 1) || 'x480', lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END]) AS value FROM documents) GROUP BY ALL"""))
def _(spark, d):
    return ds.inventory(files(spark, d))


@query("split_completeness", v.sql("", """
    SELECT split, sequence_id, count(*) AS n, count(DISTINCT frame) AS distinct_frames FROM (
      SELECT l_returnflag AS split, CAST(l_orderkey AS VARCHAR) AS sequence_id, l_linenumber AS frame FROM lineitem) GROUP BY ALL
    HAVING NOT (count(*) = 5 AND count(DISTINCT frame) = 5 AND min(frame) = 1 AND max(frame) = 5)"""))
def _(spark, d):
    f = v.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_orderkey").cast("string").alias("sequence_id"), F.col("l_linenumber").alias("frame"))
    return ds.split_completeness(f).select("split", "sequence_id", "n", "distinct_frames")


@query("label_file_match", v.sql("", """
    SELECT f.file, s.split, coalesce(c.common, 0) = s.need AND coalesce(c.common, 0) = f.got AS matches FROM
      (SELECT event_type AS file, count(DISTINCT user_id) AS got FROM events GROUP BY 1) f CROSS JOIN
      (SELECT split, count(*) AS need FROM ids2 GROUP BY 1) s LEFT JOIN (
        SELECT e.event_type AS file, i.split, count(DISTINCT e.user_id) AS common FROM events e JOIN ids2 i ON i.user_id = e.user_id GROUP BY ALL) c
      ON c.file = f.file AND c.split = s.split""",
    "ids2 AS (SELECT DISTINCT user_id, 'all' AS split FROM events UNION SELECT DISTINCT user_id, 'clickers' FROM events WHERE event_type = 'click')"))
def _(spark, d):
    e = v.read(spark, d, "events")
    every = e.select(F.lit("all").alias("split"), F.col("user_id").alias("sequence_id"))
    click = e.where("event_type = 'click'").select(F.lit("clickers").alias("split"), F.col("user_id").alias("sequence_id"))
    return ds.label_file_match(every.unionByName(click), e.select(F.col("event_type").alias("file"), F.col("user_id").alias("sequence_id")))


def benchmark_manifest(spark, d):
    return v.read(spark, d, "benchmark").select(F.concat(F.lit("doc-"), F.col("item_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"))


@query("manifest_diff", v.sql("manifest", """
    SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM manifest o FULL OUTER JOIN (SELECT 'doc-' || item_id AS name, sha256(text) AS sha256 FROM benchmark) n ON o.name = n.name
    WHERE o.name IS NULL OR n.name IS NULL OR o.sha256 <> n.sha256"""))
def _(spark, d):
    return ds.manifest_diff(v.manifest(spark, d), benchmark_manifest(spark, d))


def labelled(spark, d):
    lab = v.read(spark, d, "labels").select("doc_id", "quality", "toxic")
    docs = v.read(spark, d, "documents").select("doc_id", "lang", "n_chars").join(lab, "doc_id", "left")
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "validation").otherwise("test")
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), split.alias("split"),
        F.coalesce(F.col("quality") + F.col("toxic"), F.lit(0)).alias("boxes"), F.col("quality").isNotNull().alias("has_label"), (F.col("n_chars") >= 20).alias("valid"),
    )


LABELLED = """lb AS (SELECT 'doc-' || d.doc_id AS name, CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'validation' ELSE 'test' END AS split,
    coalesce(quality + toxic, 0) AS boxes, quality IS NOT NULL AS has_label, n_chars >= 20 AS valid FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("balanced_sample", v.sql("", """
    SELECT name, positive FROM (SELECT name, boxes > 0 AS positive, row_number() OVER (PARTITION BY boxes > 0 ORDER BY sha256('26:' || name), name) AS rn FROM lb WHERE split = 'train')
    WHERE rn <= CASE WHEN positive THEN 48 ELSE 16 END""", LABELLED))
def _(spark, d):
    return ds.balanced_sample(labelled(spark, d).withColumn("positive", F.col("boxes") > 0)).select("name", "positive")


@query("split_class_counts", v.sql("", """
    SELECT split, count(*) AS images, count(*) FILTER (has_label) AS label_files, CAST(sum(boxes) AS BIGINT) AS boxes, count(*) FILTER (valid AND boxes > 0) AS positive,
      count(*) FILTER (valid AND boxes = 0 AND has_label) AS empty_file, count(*) FILTER (valid AND boxes = 0 AND NOT has_label) AS missing_assumed_negative,
      count(*) FILTER (NOT valid) AS invalid FROM lb GROUP BY 1""", LABELLED))
def _(spark, d):
    return ds.split_class_counts(labelled(spark, d))


@query("prior_use_exclusions", v.sql("", """
    SELECT 'test' AS split, CAST(c_custkey AS VARCHAR) AS sequence_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
      AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)"""))
def _(spark, d):
    t = lambda df, c: df.select(F.lit("test").alias("split"), F.col(c).cast("string").alias("sequence_id"))
    used = [t(v.read(spark, d, "events").where("event_type = 'purchase'"), "user_id"), t(v.read(spark, d, "supplier"), "s_suppkey")]
    return ds.prior_use_exclusions(t(v.read(spark, d, "customer"), "c_custkey"), used)


def object_counts(spark, d):
    return v.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("sequence_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("num_objects"))


@query("empty_sequences", v.sql("", "SELECT CAST(o_custkey AS VARCHAR) AS sequence_id FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') = 0"))
def _(spark, d):
    return ds.empty_sequences(object_counts(spark, d))


@query("first_examples", v.sql("", """
    SELECT min(CASE WHEN n = 0 THEN k END) AS first_empty, min(CASE WHEN n > 0 THEN k END) AS first_non_empty FROM (
      SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1)"""))
def _(spark, d):
    return ds.first_examples(object_counts(spark, d))


@query("outputs_equal", v.sql("", """
    SELECT (SELECT count(*) FROM (SELECT lang, source FROM documents EXCEPT ALL SELECT lang, source FROM documents WHERE n_chars > 100)) AS only_in_a, 0 AS only_in_b,
      (SELECT count(*) FROM documents WHERE n_chars <= 100) = 0 AS equal"""))
def _(spark, d):
    x = v.read(spark, d, "documents")
    return ds.outputs_equal(x.select("lang", "source"), x.where("n_chars > 100").select("lang", "source"))


# Scorer: the first ten embedding dimensions stand in for the ten named features.
def scorer_rows(spark, d):
    e = v.read(spark, d, "embeddings")
    pairs = [x for i, n in enumerate(sc.FEATURES) for x in (F.lit(n), F.col("embedding")[i].cast("double") * (i + 1))]
    return e.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("detection_id"), F.concat(F.lit("q"), F.col("label").cast("string")).alias("sequence_id"),
        F.create_map(*pairs).alias("evidence"), (F.col("label") < 5).cast("int").alias("label"),
        F.when(F.col("label") == 9, "other").otherwise(sc.DETECTOR).alias("detector_name"),
    )


LOGF = """lf AS (SELECT vec_id, label, [sign(CAST(embedding[i] AS DOUBLE) * i) * ln(1 + abs(CAST(embedding[i] AS DOUBLE) * i)) FOR i IN range(1, 11)] AS f FROM embeddings),
    un AS (SELECT vec_id, label, unnest(f) AS val, unnest(range(1, 11)) AS i FROM lf),
    mo AS (SELECT i, avg(val) AS m, greatest(stddev_pop(val), 1e-8) AS s FROM un GROUP BY 1)"""


@query("signed_log_features", v.sql("", "SELECT 'v' || vec_id AS detection_id, CAST(i AS INTEGER) AS feature, round(val, 6) + 0.0::DOUBLE AS value FROM un", LOGF))
def _(spark, d):
    good, _ = sc.signed_log_features(scorer_rows(spark, d))
    return good.select("detection_id", F.posexplode("features").alias("feature", "value")).select("detection_id", (F.col("feature") + 1).alias("feature"), F.round("value", 6).alias("value"))


@query("standardize", v.sql("", "SELECT 'v' || vec_id AS detection_id, CAST(i AS INTEGER) AS feature, round((val - m) / s, 6) + 0.0::DOUBLE AS value FROM un JOIN mo USING (i)", LOGF))
def _(spark, d):
    good, _ = sc.signed_log_features(scorer_rows(spark, d))
    z = sc.standardize(good, sc.feature_moments(good))
    return z.select("detection_id", F.posexplode("features").alias("feature", "value")).select("detection_id", (F.col("feature") + 1).alias("feature"), F.round("value", 6).alias("value"))


@query("fit_logistic")
def _(spark, d):
    good, _ = sc.signed_log_features(scorer_rows(spark, d))
    model = sc.fit_logistic(good)
    return sc.score(good, model).select("sequence_id", "detection_id", "label", "score", "category")


# A fixed model keeps the score query checkable: unit scale, rising coefficients.
FIXED = sc.ScorerModel((0.0,) * 10, (1.0,) * 10, tuple(0.1 * (i + 1) for i in range(10)), -0.25)


@query("assess", v.sql("", """
    SELECT detection_id, sequence_id, CASE WHEN ok THEN round(s, 6) END AS score, CASE WHEN ok THEN 'experimental' ELSE 'unavailable' END AS status,
      CASE WHEN NOT ok THEN NULL WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS category FROM (
      SELECT 'v' || vec_id AS detection_id, 'q' || any_value(label) AS sequence_id, any_value(label) <> 9 AS ok,
        1 / (1 + exp(-least(greatest(sum(val * 0.1::DOUBLE * i) - 0.25, -35), 35))) AS s FROM un GROUP BY vec_id)""", LOGF))
def _(spark, d):
    a = sc.assess(scorer_rows(spark, d), FIXED)
    return a.select("detection_id", "sequence_id", F.round("score", 6).alias("score"), "status", "category")


@query("training_labels", v.sql("pairs", """
    SELECT d.detection_id, CASE WHEN p.truth_id IS NULL THEN 0 ELSE 1 END AS label FROM detections d LEFT JOIN pairs p ON p.detection_id = d.detection_id"""))
def _(spark, d):
    return sc.training_labels(v.detections(spark, d), v.visible_truth(spark, d)).select("detection_id", "label")


@query("model_guard", v.sql("", """
    SELECT 'v' || vec_id AS detection_id, 'unavailable' AS status, 'incompatible_model_version' AS detail FROM embeddings"""))
def _(spark, d):
    import dataclasses

    old = dataclasses.replace(FIXED, version="candidate-logistic-v0")
    return sc.assess(scorer_rows(spark, d), old).select("detection_id", "status", "detail")
