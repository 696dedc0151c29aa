"""Blocks that the latest pages of a domain share: learned per domain, removed from what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryloom.functions.markdown import blocks
from quarryloom.functions.text import bound, content_hash, trim

RECENT_PAGES = 3


def block_hashes(block_texts: Column) -> Column:
    """Different hashes of the trimmed blocks, in the order they first come."""
    return F.array_distinct(F.transform(block_texts, lambda b: content_hash(trim(b))))


def template_hashes(pages: DataFrame, recent: int = RECENT_PAGES) -> DataFrame:
    """pages: domain, url, fetched_at, block_hashes -> domain, hash that each of the domain's latest pages
    has. Domains of fewer pages have none. Pages of one time are taken by url."""
    latest = Window.partitionBy("domain").orderBy(F.desc("fetched_at"), "url")
    return (
        pages.withColumn("_place", F.row_number().over(latest))
        .filter(F.col("_place") <= recent)
        .select("domain", "url", F.explode(F.array_distinct("block_hashes")).alias("hash"))
        .groupBy("domain", "hash")
        .agg(F.count(F.lit(1)).alias("pages"))
        .filter(F.col("pages") >= recent)
        .select("domain", "hash")
    )


def remove_template(docs: DataFrame, templates: DataFrame, markdown: str = "markdown") -> DataFrame:
    """docs (with domain) with shown (the blocks that are no template, joined by a blank line) and removed.
    Where the domain has no templates the text stays as it is.

    A domain's templates are blocks that each of its latest pages has, so their set is no larger than a page.
    The join has no aggregation on the side of docs, so Spark can split a domain that most pages share, or
    broadcast the templates where they are few."""
    known = templates.groupBy("domain").agg(F.collect_set("hash").alias("_known"))

    def cut(found: Column) -> Column:
        kept = F.filter(found, lambda b: ~F.array_contains("_known", content_hash(trim(b))))
        return bound(kept, lambda k: F.struct(F.array_join(k, "\n\n").alias("shown"), (F.size(found) - F.size(k)).cast("long").alias("removed")))

    whole = F.struct(F.col(markdown).alias("shown"), F.lit(0).cast("long").alias("removed"))
    told = docs.join(known, "domain", "left").withColumn("_cut", F.when(F.col("_known").isNull(), whole).otherwise(bound(blocks(F.col(markdown)), cut)))
    return told.withColumns({"shown": F.col("_cut.shown"), "removed": F.col("_cut.removed")}).drop("_known", "_cut")
