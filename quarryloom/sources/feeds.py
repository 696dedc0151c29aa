"""Links of sitemaps, feeds and robots files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryloom.functions.urls import origin
from quarryloom.operators.extract import page_sources
from quarryloom.operators.links import MAX_CHILDREN, MAX_LINKS, choose_source, finish

_LOC = re.compile(r"<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?loc\s*>", re.S | re.I)
#: How long a robots file holds (fixed value).
ROBOTS_TTL_MS = 60 * 60 * 1000
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)


def _text(xml: str, tag: str) -> str | None:
    m = re.search(rf"<(?:\w+:)?{tag}\b[^>]*>(.*?)</(?:\w+:)?{tag}\s*>", xml, re.S | re.I)
    if not m:
        return None
    return " ".join(unescape(re.sub(r"<[^>]+>", "", _CDATA.sub(lambda c: c[1], m[1]))).split()) or None


def parse_sitemap(xml: str | None) -> tuple[list[str], list[str]]:
    """Pages of a urlset, and sitemaps of a sitemapindex."""
    xml = xml or ""
    found = [unescape(u.strip()) for u in _LOC.findall(re.sub(r"<(?:image|video|news):.*?</(?:image|video|news):\w+>", "", xml, flags=re.S))]
    return ([], found) if re.search(r"<(?:\w+:)?sitemapindex\b", xml) else (found, []) if re.search(r"<(?:\w+:)?urlset\b", xml) else ([], [])


def parse_feed(xml: str | None) -> list[tuple[str, str | None]]:
    """url, title of RSS items, else of Atom entries."""
    xml = xml or ""
    items = re.findall(r"<item\b[^>]*>(.*?)</item\s*>", xml, re.S | re.I)
    if items:
        return [(url, _text(i, "title")) for i in items if (url := _text(i, "link"))]
    out = []
    for entry in re.findall(r"<entry\b[^>]*>(.*?)</entry\s*>", xml, re.S | re.I):
        tags = re.findall(r"<link\b([^>]*)>", entry, re.I)
        tags = [t for t in tags if not re.search(r"rel\s*=\s*[\"'](?!alternate)", t)] or tags
        href = next((m[1] for t in tags if (m := re.search(r"href\s*=\s*[\"']([^\"']*)", t))), None)
        if href:
            out.append((unescape(href), _text(entry, "title")))
    return out


def parse_robots(body: str | None, agent: str) -> tuple[list[tuple[bool, str]], float | None, list[str]]:
    """allow and pattern of the agent's group (else of *), its crawl delay in seconds, and all sitemaps."""
    groups: dict[str, tuple[list[tuple[bool, str]], list[float]]] = {}
    now: list[str] = []
    fresh, sitemaps = False, []
    for line in (body or "").splitlines():
        name, colon, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            now, fresh = ([*now, value.lower()] if fresh else [value.lower()]), True
            groups.setdefault(value.lower(), ([], []))
            continue
        if name == "sitemap":
            sitemaps.append(value)
            continue
        fresh = False
        for g in now:
            if name in ("allow", "disallow"):
                groups[g][0].append((name == "allow", value))
            elif name == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                groups[g][1].append(float(value))
    mine = next((groups[g] for g in sorted(groups, key=len, reverse=True) if g != "*" and g in agent.lower()), groups.get("*", ([], [])))
    return [r for r in mine[0] if r[1]], mine[1][0] if mine[1] else None, sitemaps


def sitemap_links(sitemaps: DataFrame, seed: str = "seed", url: str = "url", body: str = "body") -> DataFrame:
    """seed, url, title, pos, source of captured sitemaps. A sitemapindex is followed to its first three
    children, one level deep, as far as they were captured and until they gave 200 links."""

    @F.pandas_udf("pages array<string>, children array<string>")
    def parsed(xml: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_sitemap(x) for x in xml], columns=["pages", "children"])

    told = sitemaps.select(F.col(seed).alias("seed"), F.col(url).alias("at"), parsed(body).alias("p"))
    direct = told.filter(F.size("p.pages") > 0).select("seed", F.lit(0).alias("child"), F.posexplode("p.pages").alias("n", "url"))
    asked = told.select("seed", F.posexplode(F.slice("p.children", 1, MAX_CHILDREN)).alias("child", "at"))
    every = asked.join(told.select(F.col("at"), F.col("p.pages").alias("pages")).dropDuplicates(["at"]), "at").select("seed", "child", F.posexplode("pages").alias("n", "url"))
    # a child is not asked for once those before it gave MAX_LINKS
    per_child = every.groupBy("seed", "child").agg(F.count(F.lit(1)).alias("_links"))
    ahead = per_child.withColumn("_ahead", F.coalesce(F.sum("_links").over(Window.partitionBy("seed").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = every.join(ahead.filter(F.col("_ahead") < MAX_LINKS).select("seed", "child"), ["seed", "child"], "left_semi")
    rows = direct.unionByName(inner)
    return rows.select("seed", "url", F.lit(None).cast("string").alias("title"), (F.col("child").cast("long") * (1 << 32) + F.col("n")).alias("pos"), F.lit("sitemap").alias("source"))


def feed_links(feeds: DataFrame, seed: str = "seed", body: str = "body") -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, u, t, i, "rss") for s, x in zip(pdf["seed"], pdf["body"]) for i, (u, t) in enumerate(parse_feed(x))]
            yield pd.DataFrame(rows, columns=["seed", "url", "title", "pos", "source"])

    return feeds.select(F.col(seed).cast("string").alias("seed"), F.col(body).alias("body")).mapInPandas(of, "seed string, url string, title string, pos bigint, source string")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """origin, allow, pattern of every rule that holds for the agent. robots: origin, body; where it has status,
    only what was answered with success counts, as a robots file that can't be had forbids nothing."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(o, a, p) for o, b in zip(pdf["origin"], pdf["body"]) for a, p in parse_robots(b, agent)[0]]
            yield pd.DataFrame(rows, columns=["origin", "allow", "pattern"])

    return _answered(robots).mapInPandas(of, "origin string, allow boolean, pattern string")


def robots_hosts(robots: DataFrame, agent: str) -> DataFrame:
    """origin, crawl_delay_ms (null if none is said), sitemaps (array, in order) of every robots file."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(o, *parse_robots(b, agent)[1:]) for o, b in zip(pdf["origin"], pdf["body"])]
            yield pd.DataFrame([(o, None if d is None else d * 1000, s) for o, d, s in rows], columns=["origin", "d", "sitemaps"])

    told = _answered(robots).mapInPandas(of, "origin string, d double, sitemaps array<string>")
    return told.select("origin", F.col("d").cast("long").alias("crawl_delay_ms"), "sitemaps")


def robots_fresh(fetched_at: Column, now: Column, ttl: int = ROBOTS_TTL_MS) -> Column:
    """Whether a robots file that was fetched then still holds."""
    return F.coalesce(now - fetched_at < ttl, F.lit(False))


def _answered(robots: DataFrame) -> DataFrame:
    return (robots.filter(F.col("status").between(200, 299)) if "status" in robots.columns else robots).select("origin", "body")


def discover_links(pages: DataFrame, sitemaps: DataFrame, feeds: DataFrame, robots: DataFrame, agent: str = "*", wanted: str | None = None, limit: int = MAX_LINKS) -> DataFrame:
    """url, source (sitemap, rss or page), links (array of url, title), truncated, before_filter of every page.

    pages: url, html; sitemaps and feeds: url, body; robots: origin, body; all as captured. A page's links are
    those of the first sitemap that has any, of those its robots file names or else of /sitemap.xml; else those
    of the feed that the page names; else those in the page."""
    seeds = pages.select(F.col("url").alias("seed"), "html", origin(F.col("url")).alias("origin"))
    declared = robots_hosts(robots, agent).select("origin", "sitemaps")
    asked = seeds.drop("html").join(declared, "origin", "left").select(
        "seed", F.posexplode(F.when(F.size("sitemaps") > 0, F.col("sitemaps")).otherwise(F.array(F.concat("origin", F.lit("/sitemap.xml"))))).alias("turn", "at")
    )
    # a seed's candidates are told apart by their place, and the first with links is taken
    key = F.to_json(F.struct("seed", "turn"))
    captured = sitemaps.select(F.col("url").alias("at"), "body")
    found = sitemap_links(asked.join(captured, "at").select(key.alias("seed"), F.col("at").alias("url"), "body").unionByName(captured.select(F.lit(None).cast("string").alias("seed"), F.col("at").alias("url"), "body")))
    named = found.filter(F.col("seed").isNotNull()).withColumn("k", F.from_json("seed", "seed string, turn int")).select(F.col("k.seed").alias("seed"), F.col("k.turn").alias("turn"), "url", "title", "pos", "source")
    first = named.withColumn("least", F.min("turn").over(Window.partitionBy("seed"))).filter("turn = least").drop("turn", "least")
    parsed = page_sources(pages)
    fed = feed_links(parsed.filter(F.col("feed").isNotNull()).join(feeds.select(F.col("url").alias("feed"), "body"), "feed").select(F.col("url").alias("seed"), "body"))
    own = parsed.select(F.col("url").alias("seed"), F.explode("links").alias("l")).select("seed", "l.url", "l.title", "l.pos", F.lit("page").alias("source"))
    chosen = choose_source(first.unionByName(fed).unionByName(own), "seed")
    done = finish(chosen, "seed", wanted, limit).join(chosen.groupBy("seed").agg(F.first("source").alias("source")), "seed")
    none = F.array().cast("array<struct<url:string,title:string>>")
    return pages.select("url").join(done.withColumnRenamed("seed", "url"), "url", "left").select(
        "url", F.coalesce("source", F.lit("page")).alias("source"), F.coalesce("links", none).alias("links"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("before_filter", F.lit(0)).alias("before_filter")
    )
