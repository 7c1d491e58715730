"""The pipeline stage by stage against brute force, and rows without an id through every operator."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import DOC, sentence
from trackframe.llm import decontaminate, jaccard, language, mixing, quality_model, quality_rules, secrets, substrings, toxicity
from trackframe.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and benchmark with copies, near copies, a leak, secrets, junk, nulls and a repeated row."""
    rng = random.Random(21)
    base = sentence(rng, 80)
    item = sentence(rng, 30)
    near = base.replace(base.split()[40], "changed", 1)
    data = [(i, sentence(rng, rng.randint(20, 90)), "xx" if i % 2 else "yy", "abc"[i % 3]) for i in range(60)]
    data += [(100, base, "xx", "a"), (90, near, "xx", None), (110, base.upper(), "xx", "b"), (120, sentence(rng, 10) + " " + item + " tail", "yy", "b")]
    data += [(130, f"{sentence(rng, 20)} password = hunter2hunter2 end", "xx", "c"), (131, None, "xx", "a"), (132, "", "yy", "a"), (133, "123 --- !!", "yy", "a"), (None, sentence(rng, 25), "xx", "a")]
    data.append(data[3])
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in data], DOC)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), data, item


def test_stages(spark, folder):
    sf, data, item = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    left = [d for d in data if d[1] and re.search(r"[^\W\d_]", d[1])]

    docs = stages["language"](spark, docs, sf)
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    assert docs.columns == columns and ids(docs) == sorted(str(d[0]) for d in left)

    docs = stages["near_duplicates"](spark, docs, sf)
    group = brute.linked_components([(d[0], d[1]) for d in left if d[0] is not None])
    left = [d for d in left if d[0] is None or group[d[0]][1] == d[0]]
    left = list({d[0]: d for d in left}.values())
    assert docs.columns == columns and ids(docs) == sorted(str(d[0]) for d in left) and "110" not in ids(docs)

    docs = stages["decontamination"](spark, docs, sf)
    left = [d for d in left if item not in d[1]]
    assert docs.columns == columns and ids(docs) == sorted(str(d[0]) for d in left) and "120" not in ids(docs)

    docs = stages["secrets"](spark, docs, sf)
    assert docs.columns == columns and docs.count() == len(left)
    for r in docs.collect():
        assert r.n_chars == len(r.text) and "hunter2" not in r.text
    changed = [r for r in docs.collect() if "<SECRET>" in r.text]
    assert [r.doc_id for r in changed] == [130]

    mixed = stages["mixing"](spark, docs, sf).collect()
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(brute.words(r.text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = brute.fill(1.5 * sum(size.values()), [(s, (3, 1, 2)[k % 3], 2 * size[s]) for k, s in enumerate(order)])
    for s in order:
        assert abs(sum(r.taken for r in mixed if r.source == s) - want[s]) <= 2
    assert all(0 < r.taken <= 2 * r.n_words for r in mixed)


def test_near_duplicates_at_five_words_and_eight_tenths(spark):
    rng = random.Random(5)
    long, short, other = sentence(rng, 100), sentence(rng, 50).split(), sentence(rng, 50).split()
    data = [(1, long), (2, long + " " + sentence(rng, 15)), (3, long + " " + sentence(rng, 40)), (10, " ".join(short)), (11, " ".join([*short[:24], "changed", *short[25:]])), (20, " ".join(other)), (21, " ".join([*other[:10], "one", *other[11:30], "two", *other[31:]]))]
    docs = spark.createDataFrame([(i, t, "xx", "a", len(t)) for i, t in data], DOC)
    group = brute.linked_components(data, 80, 100, 5)
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect())
    assert kept == [i for i, _ in data if group[i][1] == i] == [1, 3, 10, 20, 21]


def test_run_equals_stages(spark, folder):
    sf, _, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda df: sorted((str(r.doc_id), r.text, r.taken) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(docs)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "One two three four five six " * 9, "xx", "a", 1), (None, None, None, None, None), (5, "one two three four five six " * 9, "xx", "a", 1)], DOC)
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "one two three four five six one two three four five six one two")], "item_id long, text string")
    runs = [mixing.mix(docs), jaccard.link(docs), language.language_of(docs), secrets.scan(docs), quality_model.score(docs, labels), toxicity.score(docs, labels), substrings.remove(docs), quality_rules.apply_rules(docs)]
    assert [df.count() for df in runs] == [3] * len(runs)
    assert decontaminate.contaminated(docs, bench).count() == 2
    assert {r.component_id for r in jaccard.link(docs).collect()} == {5, None}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf, name):
    from tests.oracle import compare, connect

    assert compare(QUERIES[name](spark, sf), ORACLES[name], connect(sf))[1] is None


def test_ten_queries_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_language_decides(spark, sf):
    """A script without a profile is rejected because of its language, a null lang is filled; a repeated id keeps the same row every time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null")
    profiles = language.learn_profiles(docs)
    sample = docs.where("length(text) > 200").limit(20).cache()
    odd = sample.withColumn("lang", F.lit(None).cast("string")).unionByName(sample.limit(1).withColumns({"doc_id": F.lit(-5).cast(docs.schema["doc_id"].dataType), "text": F.lit("ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾᛁᛃ ᛇᛈᛉᛊᛏᛒ")}))
    kept = {r.doc_id: r.lang for r in language.keep_identified(odd, profiles).collect()}
    right = {r.doc_id: r.lang for r in sample.collect()}
    assert -5 not in kept and set(kept) == set(right) and sum(kept[i] == right[i] for i in right) >= 0.9 * len(right)
