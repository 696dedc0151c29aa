"""Links of pages, sitemaps and feeds: dedupe, filter, source choice and hints at structured data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryloom.functions.urls import matches_filter, says_structured, structured_ending

MAX_LINKS, MAX_CHILDREN, MAX_HINTS = 200, 3, 5
SOURCES = ["sitemap", "rss", "page"]


def first_of_each(links: DataFrame, *keys: str) -> DataFrame:
    """links (keys, url, title, pos) without later links to the same url."""
    return links.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "url").orderBy("pos"))).filter("_n = 1").drop("_n")


def finish(links: DataFrame, key: str, wanted: str | None = None, limit: int = MAX_LINKS) -> DataFrame:
    """One row for each key: links (array of url, title; first `limit` in order), truncated, before_filter."""
    one = first_of_each(links, key)
    match = F.coalesce(matches_filter(F.col("url"), wanted), F.lit(False)) | F.coalesce(matches_filter(F.col("title"), wanted), F.lit(False))
    order = Window.partitionBy(key, "_match").orderBy("pos")
    ranked = one.withColumn("_match", match).withColumn("_n", F.row_number().over(order))
    kept = F.when(F.col("_match") & (F.col("_n") <= limit), F.struct("pos", "url", "title"))
    return ranked.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(kept)), lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))).alias("links"),
        (F.count(F.when(F.col("_match"), 1)) > limit).alias("truncated"),
        F.count(F.lit(1)).alias("before_filter"),
    )


def choose_source(links: DataFrame, key: str) -> DataFrame:
    """Of links with source (sitemap, rss or page), those of each key's first source that has any."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return links.withColumn("_r", rank).withColumn("_b", F.min("_r").over(Window.partitionBy(key))).filter("_r = _b").drop("_r", "_b")


def data_sources(links: DataFrame, key: str, base: str, limit: int = MAX_HINTS) -> DataFrame:
    """One row for each key with hints: array of lines. links: key, base (the page's url), url, title, pos.
    Links of one structured file type make one line, and come first; then links whose words point to data."""
    told = links.withColumn("_end", structured_ending(F.col("url"))).withColumn("_says", says_structured(F.col("title"), F.col("url"), F.col(base)))
    used = told.filter(F.col("_end").isNotNull() | F.col("_says")).withColumn("_group", F.coalesce("_end", F.concat(F.lit("url:"), F.col("url"))))
    grouped = used.groupBy(key, "_group", F.col("_end").isNull().alias("_word")).agg(
        F.min(F.struct("pos", "url", "title")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    line = F.concat(F.lit("- "), F.when(F.coalesce("first.title", F.lit("")) != "", F.concat(F.col("first.title"), F.lit(" — "))).otherwise(""), F.col("first.url"))
    more = F.concat(F.lit("(ほか"), (F.col("n") - 1).cast("string"), F.lit("件"), F.when(~F.col("_word"), F.concat(F.lit("、links filter:'*"), F.col("_group"), F.lit("' で列挙可"))).otherwise(""), F.lit(")"))
    full = grouped.withColumn("line", F.when(F.col("n") > 1, F.concat(line, more)).otherwise(line))
    place = Window.partitionBy(key).orderBy("_word", "first.pos")
    return (
        full.withColumn("_n", F.row_number().over(place))
        .filter(F.col("_n") <= limit)
        .groupBy(key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]).alias("hints"))
    )
