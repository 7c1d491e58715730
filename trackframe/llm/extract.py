"""Main text of web pages: page furniture and the templates of each site removed.

Furniture is told by element names and by words in class, id and role. Templates are told by
counting: the text of every subtree, in articles and furniture too, is hashed, the contexts
of each hash are counted per host, and a subtree with enough of them is deleted from all
pages of the host. A host of P pages needs sqrt(LEAST * MOST * P) contexts, LEAST at
least, so boilerplate of a part of a big host is found too; texts of a few words need MOST of the
pages. Copies of a page are one context, see Page.candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.frames import SALTS, Shared, bitmap, cut_lineage, in_bitmap, stored
from trackframe.llm.markup import parse
from trackframe.llm.textbytes import texts

LEAST = 10
MOST = 0.5


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port or a leading www.; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def subtrees(pages: DataFrame) -> DataFrame:
    """page_key, host, hash, context, short, shown: the distinct candidate subtrees of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hosts, rows = [], [], []
            for key, host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "html").to_pylist()):
                found = sorted(parse(source).candidates())
                keys += [key] * len(found)
                hosts += [host] * len(found)
                rows += found
            hashes, contexts, short, shown = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(contexts, pa.int64()), pa.array(short, pa.bool_()), pa.array(shown, pa.bool_())], ["page_key", "host", "hash", "context", "short", "shown"])

    return pages.select("page_key", "host", "html").where(F.col("host").isNotNull()).mapInArrow(run, "page_key long, host string, hash long, context long, short boolean, shown boolean")


def templates(pages: DataFrame, found: DataFrame, least: int = LEAST, most: float = MOST) -> DataFrame:
    """host, hash of the subtrees with enough contexts for the number of the host's pages, `least` or more."""
    totals = cut_lineage(pages.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("host_pages")))
    counts = found.select("host", "hash", "short", "context").distinct().groupBy("host", "hash", "short").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    enough = F.when(F.col("short"), most * F.col("host_pages")).otherwise(F.sqrt(least * most * F.col("host_pages")))
    return counts.join(totals, "host").where(F.col("n") >= enough).select("host", "hash")


def main_text(pages: DataFrame, least: int = LEAST, most: float = MOST) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars; one row for each row.

    White space inside a block is one blank, blocks are joined by two newlines. A null or
    empty page has the empty text. Pages without a host have no template. Repeated rows
    count as so many pages, but as one context.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("page_key", F.xxhash64("page_id", "url"))
    found = stored(subtrees(pages))
    known = cut_lineage(templates(pages, found, least, most))
    salt = F.pmod("page_key", F.lit(SALTS)).cast("int")
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = found.where("shown").select("page_key", "host", "hash").distinct().withColumn("salt", salt).join(spread, ["host", "hash", "salt"]).groupBy("page_key").agg(F.collect_set("hash").alias("template"))
    own = cut_lineage(own)
    touched = Shared(pages.sparkSession, bitmap(own, "page_key"))

    def where(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = touched.get()
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(known, batch.column(3).to_numpy(zero_copy_only=False)) == hit))

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [parse(source).main_text(frozenset(gone or ())) for source, gone in zip(texts(batch, "html").to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    pages = pages.drop("host")
    lose = pages.mapInArrow(where(True), pages.schema).join(own, "page_key", "left")  # only these are shuffled
    keep = pages.mapInArrow(where(False), pages.schema).withColumn("template", F.lit(None).cast("array<long>"))
    columns, schema = ["page_id", "url", "html", "template"], "page_id long, url string, text string"
    text = keep.select(columns).mapInArrow(run, schema).unionByName(lose.select(columns).mapInArrow(run, schema))
    return text.withColumn("n_chars", F.length("text").cast("long"))
