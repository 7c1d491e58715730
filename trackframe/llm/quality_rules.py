"""Quality rules of documents and of their hosts, in DataFrame functions only.

A document fails by its own numbers; a host fails by the rate of failing documents, shrunk
towards all hosts with a beta prior whose two parameters come from the hosts themselves
(moments over all hosts, weighted by their documents). A host with few documents thus needs more evidence than a big one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.frames import cut_lineage, salted_join

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: host rates at or above this fail
HOST_LIMIT = 0.5


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more in the list.

    Windows are hashed and sorted with their places; only lists with a repeat get that far.
    """
    last = F.size(words) - 3
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
        count = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")))["n"]
        on = lambda value, fn: F.get(F.transform(F.array(value), fn), F.lit(0))
        return on(placed, lambda s: on(F.array_sort(twice(s)), count))

    return F.when(last < 1, 0).otherwise(F.get(F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))), F.lit(0)))


def document_counts(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host and the counts of each row; a null text has no words, symbols or lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    filled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text"))
    split = filled.withColumn("words", F.filter(F.split("text", GAP), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return split.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed() -> Column:
    """What counts against a host: the base rules, a symbol for every second word, half of the lines repeated."""
    return base_failed() | (2 * F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by the moments of the rates of all hosts, each weighted by its documents; (0.5, 0.5) if they say nothing.

    The spread that documents alone would give is taken off; one row of sums reaches the driver.
    """
    docs, failed = F.col("docs"), F.col("failed")
    m = hosts.agg(F.sum(docs).alias("docs"), F.sum(failed).alias("failed"), F.sum(failed * failed / docs).alias("rates"), F.sum(docs * docs).cast("double").alias("squares"), F.count("*").alias("n")).first()
    if m["n"] < 2 or not 0 < m["failed"] < m["docs"]:
        return 0.5, 0.5
    mean = m["failed"] / m["docs"]
    spread = mean * (1 - mean)
    apart = m["rates"] - m["failed"] * m["failed"] / m["docs"]
    between = max((apart - (m["n"] - 1) * spread) / (m["docs"] - m["squares"] / m["docs"]), spread / 1000)
    size = min(max(spread / between - 1, 1.0), 1000.0)
    return mean * size, (1 - mean) * size


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, docs, failed, rate (shrunk), host_kept. A null host is a host of its own."""
    hosts = cut_lineage(counts.groupBy("host").agg(F.count("*").alias("docs"), F.sum(rule_failed().cast("long")).alias("failed")))
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + alpha) / (F.col("docs") + alpha + beta)
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") < limit)


def apply_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, counts, base_failed, host, rate, host_kept, kept.

    Empty and null texts fail the base rules. Counts are taken once and stored, rates come
    from one combinable aggregate, and rows of a big host are spread over many places.
    """
    counts = cut_lineage(document_counts(docs, host))
    key = F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("n"))
    verdicts = host_verdicts(counts, limit).select(key.alias("host_key"), "rate", "host_kept")
    both = salted_join(counts.withColumn("host_key", key), verdicts, "host_key", F.col("doc_id")).drop("host_key")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
