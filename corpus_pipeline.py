"""From raw documents to a training mix: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. `run` writes each stage as Parquet below the checkpoint folder of the
session, so no stage is computed twice and a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions.lineage import ensure_checkpoint_dir
from trackframe.llm import decontaminate, jaccard, language, mixing, secrets
from trackframe.llm.frames import held_out, table

#: learned profiles, hashes and patterns are beyond SQL; tests compare with a brute-force run
ORACLE_SQL = None

#: words of a shingle and similarity of the near-duplicate stage; op2_jaccard_join has its own
SHINGLE, SIMILAR = 5, (80, 100)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one language profile is nearest to; others, null texts and texts without letters go. A null `lang` is filled, others stay."""
    return language.keep_identified(docs, language.learn_profiles(docs.where(~held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked on five words at 0.8. Rows without an id stay; of rows that repeat an id the one
    with the smallest hash of its columns stays, so that reruns agree."""
    linked = jaccard.link(docs, SHINGLE, SIMILAR)
    kept = docs.join(linked.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "doc_id", "left_anti")
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1)
    if not repeated.isEmpty():
        values = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = kept.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min_by(values, F.struct(F.xxhash64(values), F.col("text"))).alias("one")).select("one.*")
        kept = one.unionByName(kept.where(F.col("doc_id").isNull()))
    return kept.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Rows without an id stay."""
    hit = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by marks and n_chars counted anew."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, target of the source and words taken (columns of these names are replaced)."""
    docs = docs.drop("mix_key", "n_words", "source_target", "taken")
    keyed = docs.withColumn("mix_key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    mixed = mixing.mix(keyed, key="mix_key").where("taken > 0").select(F.col("doc_id").alias("mix_key"), F.col("size").alias("n_words"), F.col("target").alias("source_target"), "taken")
    return keyed.join(mixed.dropDuplicates(["mix_key"]), "mix_key").drop("mix_key")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
