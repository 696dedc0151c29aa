"""Queries over a few rows written out here, for what the test tables hold no case of. Their oracles are the
rows expected, written out as well, from the rules and not from a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryloom.functions import charset as CH
from quarryloom.functions import markdown as M
from quarryloom.functions.cjk import cjk_normalised
from quarryloom.functions.net import ip_reserved
from quarryloom.operators import extract as E
from quarryloom.operators import geometry as G
from quarryloom.operators import policy as P
from quarryloom.operators import render as R
from quarryloom.operators.view import fetch
from quarryloom.plans.base import query
from quarryloom.sources import feeds as S
from quarryloom.sources import state as ST

_TYPES = {str: "VARCHAR", int: "BIGINT", float: "DOUBLE", bool: "BOOLEAN"}


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).upper() if isinstance(v, bool) else repr(v)


def expected(columns: str, *rows: tuple) -> str:
    """SQL that gives these rows; a column's type is that of its first value that is not null."""
    names = columns.split()
    kinds = [next((_TYPES[type(r[i])] for r in rows if r[i] is not None), "VARCHAR") for i in range(len(names))]
    values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds))} FROM (VALUES {values}) AS t({', '.join(names)})"


@query(
    "charset_cases",
    expected(
        "id encoding text",
        (1, "cp932", "表示"), (2, "euc_jp", "<meta charset=euc-jp>漢字"), (3, "euc_jp", "これは日本語の文章です。"), (4, "utf-8", "naïve"), (5, "iso2022_jp", "日本"), (6, "utf-8", "plain"), (7, None, None), (8, "cp932", "これは日本語の文章です。"),
    ),
)
def charset_cases(spark, sf):
    """The header's name, the page's, a byte order mark, escape sequences, and bytes that say nothing."""
    prose = "これは日本語の文章です。"
    rows = [
        (1, bytearray("表示".encode("cp932")), "text/html; charset=Shift_JIS"), (2, bytearray("<meta charset=euc-jp>漢字".encode("euc_jp")), "text/html"), (3, bytearray(prose.encode("euc_jp")), None),
        (4, bytearray("﻿naïve".encode()), "text/html; charset=UTF-8"), (5, bytearray("日本".encode("iso2022_jp")), None), (6, bytearray(b"plain"), "text/html; charset=no-such"), (7, None, "text/html"), (8, bytearray(prose.encode("cp932")), None),
    ]
    df = spark.createDataFrame(rows, "id long, body binary, content_type string")
    return df.select("id", CH.decoded("body", "content_type").alias("d")).select("id", "d.encoding", "d.text")


@query(
    "cjk_cases",
    expected("id text", (1, "日本語です"), (2, "改行はつながる"), (3, "ABC 123"), (4, "とても**重要**です"), (5, "語 and 語"), (6, "`語 語`と語"), (7, None), (8, "段落\n\n段落")),
)
def cjk_cases(spark, sf):
    rows = [(1, "日本 語　です"), (2, "改行は\nつながる"), (3, "ＡＢＣ　１２３"), (4, "とても **重要** です"), (5, "語 and 語"), (6, "`語 語`と 語"), (7, None), (8, "段落\n\n段落")]
    return spark.createDataFrame(rows, "id long, text string").select("id", cjk_normalised("text").alias("text"))


@query("fence_blocks", expected("id pos block", (1, 0, "a"), (1, 1, "```\nx\n\n# y\n```"), (1, 2, "b"), (2, 0, "p\n```\nopen\n\nto the end"), (3, 0, "  ```py\n\n\n```\nafter")))
def fence_blocks(spark, sf):
    """Blank lines inside a fence part no blocks; an open fence runs to the end."""
    rows = [(1, "a\n\n```\nx\n\n# y\n```\n\nb"), (2, "p\n```\nopen\n\nto the end"), (3, "  ```py\n\n\n```\nafter"), (4, ""), (5, None)]
    found = spark.createDataFrame(rows, "id long, md string").select("id", F.posexplode(M.blocks(F.col("md"))).alias("pos", "block"))
    return found.select("id", F.col("pos").cast("long").alias("pos"), "block")


@query("fence_headings", expected("id line level text", (1, 0, 1, "T"), (1, 6, 2, "After"), (2, 1, 3, "only")))
def fence_headings(spark, sf):
    rows = [(1, "# T\n```\n# not\n\n## nor\n```\n## After"), (2, "x\n### only\n####### seven"), (3, "#none")]
    found = spark.createDataFrame(rows, "id long, md string").select("id", F.explode(M.headings(F.col("md"))).alias("h"))
    return found.select("id", F.col("h.line").cast("long").alias("line"), F.col("h.level").cast("long").alias("level"), "h.text")


_IPS = [
    ("8.8.8.8", False), ("10.1.2.3", True), ("172.31.255.255", True), ("172.32.0.1", False), ("192.168.0.1", True), ("169.254.9.9", True), ("100.64.0.1", True), ("127.0.0.1", True), ("0.0.0.0", True),
    ("::1", True), ("fe80::1", True), ("fd00::1", True), ("2606:4700::1111", False), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False), ("64:ff9b::a00:1", True), ("64:ff9b::808:808", False), ("not an address", True),
]


@query("ip_cases", expected("ip reserved", *_IPS))
def ip_cases(spark, sf):
    return spark.createDataFrame([(ip,) for ip, _ in _IPS], "ip string").select("ip", ip_reserved(F.col("ip")).alias("reserved"))


@query("cluster_cases", expected("page ids text_length bottom", (1, "1,2,3", 600, 130.0), (2, "8", 50, 30.0)))
def cluster_cases(spark, sf):
    """Page 1: a main column and a narrow one beside it; page 2: two blocks too far apart to be one column."""
    rows = [
        (1, 1, 100.0, 10.0, 500.0, 20.0, 200), (1, 2, 105.0, 50.0, 500.0, 20.0, 200), (1, 3, 100.0, 110.0, 500.0, 20.0, 200), (1, 4, 700.0, 10.0, 200.0, 20.0, 250), (1, 5, 700.0, 40.0, 200.0, 20.0, 250), (1, 6, 100.0, 60.0, 0.0, 20.0, 900),
        (2, 8, 0.0, 10.0, 100.0, 20.0, 50), (2, 9, 0.0, 500.0, 100.0, 20.0, 50),
    ]
    blocks = spark.createDataFrame(rows, "page long, id long, x double, y double, width double, height double, text_length long")
    return G.main_cluster(blocks, "page").select("page", F.array_join(F.col("block_ids").cast("array<string>"), ",").alias("ids"), "text_length", "bottom")


_PARA = "The harbour was quiet that morning, and the boats, all of them, lay still. Nobody spoke, for there was nothing to say. "
_PROSE = (_PARA * 3).strip()


@query(
    "statistics_cases",
    expected(
        "id table_cells images images_without_alt canvases svgs image_area",
        (1, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2, 0.0, 3.0, 2.0, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 0.0, 1.0, 2.0, 0.0), (4, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ),
)
def statistics_cases(spark, sf):
    rows = [
        (1, "<table><tr><th>a<th>b<tr><td>1<td>2</table>"), (2, "<img src=a><img src=b alt=''><img src=c width=4000 height=4000>"), (3, "<canvas></canvas><svg><td>no cell</td></svg><p><svg></svg>"), (4, None),
    ]
    pages = spark.createDataFrame(rows, "id long, html string").withColumn("url", F.lit("https://e.example/"))
    return E.extract_markdown(pages).select("id", "table_cells", "images", "images_without_alt", "canvases", "svgs", "image_area")


@query(
    "extract_cases",
    expected(
        "id markdown method pruned error_code",
        (1, "# Title\n\nshort", "selector", 0, None), (2, None, None, 0, "EXTRACTION_FAILED"), (3, "short", "body-fallback", 2, None), (4, "漢字", "body-fallback", 0, None), (5, "| a | b |\n| --- | --- |\n| x | 1 |\n|  | 2 |", "body-fallback", 0, None),
        (6, "", "body-fallback", 0, None),
    ),
)
def extract_cases(spark, sf):
    """A selector that is met and one that is not, page furniture, ruby, a cell of two rows, no page."""
    rows = [
        (1, "<div class=x><h1>Title</h1><p>short</div><p>other", "div.x"), (2, "<p>short", ".none"), (3, "<nav>menu</nav><p>short<footer>foot</footer>", None), (4, "<p><ruby>漢字<rt>かんじ</rt></ruby>", None),
        (5, "<table><tr><th>a<th>b<tr><td rowspan=2>x<td>1<tr><td>2</table>", None), (6, None, None),
    ]
    parts = []
    for selector in ("div.x", ".none", None):
        mine = [(i, h) for i, h, s in rows if s == selector]
        pages = spark.createDataFrame(mine, "id long, html string").withColumn("url", F.lit("https://e.example/"))
        parts.append(E.extract_markdown(pages, selector=selector).select("id", "markdown", "method", "pruned", "error_code"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("geometry_extraction", expected("id markdown method", (1, "字" * 250, "geometry"), (2, "外\n\n短", "body-fallback")))
def geometry_extraction(spark, sf):
    """The blocks that geometry names, if they hold text enough; else the body."""
    rows = [(1, f'<span data-gid="1">{"字" * 250}</span><p>外</p>', ["1"], 250), (2, '<p>外</p><p data-gid="1">短</p>', ["1"], 1)]
    pages = spark.createDataFrame(rows, "id long, html string, block_ids array<string>, text_length long").withColumn("url", F.lit("https://e.example/"))
    return E.extract_with_geometry(pages).select("id", "markdown", "method")


_SITEMAP = "<urlset>{}</urlset>"
_INDEX = "<sitemapindex>{}</sitemapindex>"


def _locs(*urls: str, tag: str = "url") -> str:
    return "".join(f"<{tag}><loc>{u}</loc></{tag}>" for u in urls)


@query("sitemap_cases", expected("seed n first last", ("a", 2, "https://a/1", "https://a/2"), ("b", 3, "https://b/1", "https://b/3"), ("c", 250, "https://c/0", "https://c/249")))
def sitemap_cases(spark, sf):
    """A list of pages; an index of four children, of which three are followed; one whose first child has enough."""
    rows = [
        ("a", "https://a/s", _SITEMAP.format(_locs("https://a/1", "https://a/2"))), ("b", "https://b/s", _INDEX.format(_locs(*[f"https://b/c{i}" for i in range(1, 5)], tag="sitemap"))),
        *[(None, f"https://b/c{i}", _SITEMAP.format(_locs(f"https://b/{i}"))) for i in range(1, 5)], ("c", "https://c/s", _INDEX.format(_locs("https://c/c0", "https://c/c1", tag="sitemap"))),
        (None, "https://c/c0", _SITEMAP.format(_locs(*[f"https://c/{i}" for i in range(250)]))), (None, "https://c/c1", _SITEMAP.format(_locs("https://c/more"))),
    ]
    found = S.sitemap_links(spark.createDataFrame(rows, "seed string, url string, body string")).filter("seed is not null")
    return found.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "pos").alias("first"), F.max_by("url", "pos").alias("last"))


_RSS = "<rss><channel><item><title>One &amp; two</title><link>https://f/1</link></item><item><title><![CDATA[<b>B</b>]]></title><link>https://f/2</link></item><item><title>no link</title></item></channel></rss>"
_ATOM = '<feed><entry><title>E</title><link rel="self" href="https://f/self"/><link href="https://f/e?a=1&amp;b=2"/></entry></feed>'


@query("feed_cases", expected("seed url title pos", ("r", "https://f/1", "One & two", 0), ("r", "https://f/2", "B", 1), ("t", "https://f/e?a=1&b=2", "E", 0)))
def feed_cases(spark, sf):
    rows = [("r", _RSS), ("t", _ATOM), ("x", "no feed"), ("n", None)]
    return S.feed_links(spark.createDataFrame(rows, "seed string, body string")).select("seed", "url", "title", "pos")


_ROBOTS = "User-agent: *\nDisallow: /private\nCrawl-delay: 2.5\n\nUser-agent: quarry\nUser-agent: other\nAllow: /private/ok # here\nDisallow: /private\nDisallow:\nSitemap: https://o/s1\nSitemap: https://o/s2"


@query("robots_cases", expected("origin allow pattern", ("https://o", True, "/private/ok"), ("https://o", False, "/private"), ("https://p", False, "/x")))
def robots_cases(spark, sf):
    rows = [("https://o", _ROBOTS, 200), ("https://p", "user-agent:*\ndisallow:/x", 200), ("https://q", "User-agent: *\nDisallow: /", 503), ("https://r", None, 404)]
    return S.robots_rules(spark.createDataFrame(rows, "origin string, body string, status int"), "Quarry/1.0")


@query("robots_hosts", expected("origin crawl_delay_ms sitemaps", ("https://o", 2500, "https://o/s1,https://o/s2"), ("https://p", None, "")))
def robots_hosts(spark, sf):
    rows = [("https://o", _ROBOTS, 200), ("https://p", "user-agent:*\ndisallow:/x", 200), ("https://q", "Crawl-delay: 9", 500)]
    return S.robots_hosts(spark.createDataFrame(rows, "origin string, body string, status int"), "somebody").withColumn("sitemaps", F.array_join("sitemaps", ","))


@query(
    "discover_links",
    expected(
        "url source urls truncated before_filter",
        ("https://a.example/", "sitemap", "https://a.example/1,https://a.example/2", True, 3), ("https://b.example/x", "sitemap", "https://b.example/s2", False, 1), ("https://c.example/", "rss", "https://f/1,https://f/2", False, 2),
        ("https://d.example/", "page", "https://d.example/in,https://o.example/", False, 2), ("https://e.example/", "page", "", False, 0),
    ),
)
def discover_links(spark, sf):
    """A sitemap at the usual place; the second of those that robots names, as the first has no links; the feed
    that a page names; the links of a page, as its feed is not to be had; nothing at all."""
    feed = '<link rel="alternate" type="application/rss+xml" href="/feed">'
    pages = [
        ("https://a.example/", "<a href=/own>o</a>"), ("https://b.example/x", feed), ("https://c.example/", f"<head>{feed}</head><a href=/own>o</a>"), ("https://d.example/", f"{feed}<a href=in>I</a><a href=https://o.example/>O</a><a href=in>again</a>"), ("https://e.example/", None),
    ]
    sitemaps = [("https://a.example/sitemap.xml", _SITEMAP.format(_locs(*[f"https://a.example/{i}" for i in (1, 2, 3)]))), ("https://b.example/one", "<html>none</html>"), ("https://b.example/two", _SITEMAP.format(_locs("https://b.example/s2")))]
    robots = [("https://b.example", "Sitemap: https://b.example/one\nSitemap: https://b.example/two"), ("https://a.example", "User-agent: *\nDisallow:")]
    found = S.discover_links(
        spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame(sitemaps, "url string, body string"), spark.createDataFrame([("https://c.example/feed", _RSS)], "url string, body string"),
        spark.createDataFrame(robots, "origin string, body string"), limit=2,
    )
    return found.select("url", "source", F.array_join(F.transform("links", lambda x: x["url"]), ",").alias("urls"), "truncated", "before_filter")


@query(
    "metadata_defaults",
    expected("url title final_url tier low_quality pruned_blocks extraction hints", ("u", None, "u", "http", False, 0, "readability", 0), ("v", "T", "w", "browser", True, 3, "geometry", 1)),
)
def metadata_defaults(spark, sf):
    meta = "title: string, final_url: string, tier: string, low_quality: boolean, quality_reason: string, pruned_blocks: int, adapter: string, extraction: string, hints: array<string>"
    rows = [("u", "m", 1, (None,) * 9), ("v", "m", 2, ("T", "w", "browser", True, "r", 3, None, "geometry", ["- a"]))]
    pages = ST.with_defaults(spark.createDataFrame(rows, "url string, markdown string, fetched_at long, metadata struct<" + meta + ">"))
    return pages.select("url", "title", "final_url", "tier", "low_quality", F.col("pruned_blocks").cast("long").alias("pruned_blocks"), "extraction", F.size("hints").cast("long").alias("hints"))


_OLD = "# T\n\nold\n\n## Same\n\nas it was"
_NEW = "<div id=m><h1>T</h1><p>new</p><h2>Same</h2><p>as it was</p></div>"


def _requests(spark):
    rows = [
        ("https://e/fresh", 200, _NEW), ("https://e/same", 304, None), ("https://e/odd", 304, None), ("https://e/first", 200, _NEW), ("https://e/diff", 200, _NEW), ("https://e/equal", 200, _NEW), ("https://e/all", 200, "<h1>X</h1><p>y</p>"),
        ("https://e/gone", 404, "<p>none</p>"), ("ftp://e/x", 200, _NEW),
    ]
    cache = [("https://e/fresh", 990, _OLD), ("https://e/same", 0, _OLD), ("https://e/diff", 0, _OLD), ("https://e/equal", 0, "# T\n\nnew\n\n## Same\n\nas it was"), ("https://e/all", 0, _OLD), ("https://e/gone", 0, _OLD)]
    return spark.createDataFrame(rows, "url string, status int, html string"), spark.createDataFrame(cache, "url string, fetched_at long, markdown string")


@query(
    "fetch_cached",
    expected(
        "url cache answer error_code held",
        ("https://e/fresh", "fresh", "full", None, "old"), ("https://e/same", "revalidated", "full", None, "old"), ("https://e/odd", None, None, "UNEXPECTED_NOT_MODIFIED", None), ("https://e/first", "miss", "full", None, "new"), ("https://e/diff", "miss", "diff", None, "new"),
        ("https://e/equal", "miss", "unchanged", None, "new"), ("https://e/all", "miss", "full", None, "y"), ("https://e/gone", None, None, "HTTP_STATUS_ERROR", None), ("ftp://e/x", None, None, "INVALID_URL", None),
    ),
)
def fetch_cached(spark, sf):
    """Each way in which a request meets the cache: state, kind of answer, and what is held afterwards."""
    requests, cache = _requests(spark)
    held = F.regexp_extract("markdown", r"\A# \w+\n\n(\w+)", 1)
    return fetch(requests, cache, 1000, ttl=100).select("url", "cache", "answer", "error_code", held.alias("held"))


@query("fetch_forced", expected("url cache answer", ("https://e/diff", "miss", "full"), ("https://e/equal", "miss", "full"), ("https://e/fresh", "fresh", "full")))
def fetch_forced(spark, sf):
    requests, cache = _requests(spark)
    asked = requests.filter(F.col("url").isin("https://e/diff", "https://e/equal", "https://e/fresh"))
    return fetch(asked, cache, 1000, ttl=100, force_full=True).select("url", "cache", "answer")


@query("fetch_selected", expected("url cache answer error_code response", ("https://e/fresh", "miss", "full", None, "T"), ("https://e/same", None, None, "UNEXPECTED_NOT_MODIFIED", None)))
def fetch_selected(spark, sf):
    """A selector goes by the cache."""
    requests, cache = _requests(spark)
    found = fetch(requests.filter(F.col("url").isin("https://e/fresh", "https://e/same")), cache, 1000, ttl=100, selector="h1")
    return found.select("url", "cache", "answer", "error_code", F.nullif(F.regexp_extract("response", r"\n\n# (\w+)\z", 1), F.lit("")).alias("response"))


@query(
    "error_codes",
    expected(
        "id error_code",
        (1, "INVALID_URL"), (2, "ROBOTS_DENIED"), (3, "PRIVATE_ADDRESS_DENIED"), (4, "FETCH_TIMEOUT"), (5, "NETWORK_ERROR"), (6, "UNEXPECTED_NOT_MODIFIED"), (7, None), (8, "HTTP_STATUS_ERROR"), (9, "PAYLOAD_TOO_LARGE"), (10, None), (11, "UNSUPPORTED_CONTENT"),
    ),
)
def error_codes(spark, sf):
    """What a captured fetch fails with, the first check first; the last row asks for links of what is no page."""
    ok = ("https://e/", True, "8.8.8.8", 5, 200, False, "text/html", "x", False)
    change = lambda i, **c: (i, *[c.get(k, v) for k, v in zip(("url", "allowed", "ip", "ms", "status", "cached", "type", "body", "links"), ok)])
    rows = [
        change(1, url="file:///x"), change(2, allowed=False), change(3, ip="10.0.0.1"), change(4, ms=900, status=None), change(5, status=None), change(6, status=304), change(7, status=304, cached=True), change(8, status=500), change(9, body="x" * 9),
        change(10), change(11, type="application/zip", links=True),
    ]
    df = spark.createDataFrame(rows, "id long, url string, allowed boolean, ip string, ms long, status int, cached boolean, content_type string, body string, links boolean")
    routed = P.route(df.withColumn("body", F.col("body").cast("binary")), body_cap=8)
    routing = F.coalesce("error_code", F.when(F.col("links") & (F.col("kind") == "handoff"), "UNSUPPORTED_CONTENT"))
    found = P.failure(F.col("url"), F.col("allowed"), ip_reserved(F.col("ip")), F.col("ms"), 500, F.col("status"), F.col("cached"), routing)
    return routed.select("id", found.alias("error_code"))


@query(
    "cache_revalidation",
    expected("url pos status", ("a", 0, "miss"), ("a", 1, "fresh"), ("a", 2, "revalidated"), ("a", 3, "fresh"), ("a", 4, "miss"), ("b", 0, "error"), ("b", 1, "miss"), (None, 0, "miss")),
)
def cache_revalidation(spark, sf):
    rows = [("a", 0, 1, False), ("a", 9, 2, True), ("a", 10, 3, True), ("a", 19, 4, False), ("a", 20, 5, False), ("b", 0, 6, True), ("b", 1, 7, False), (None, 5, 8, None)]
    df = spark.createDataFrame(rows, "url string, at long, tie long, same boolean")
    return P.cache_replay(df, "url", "at", "tie", 10, "same").select("url", F.col("pos").cast("long").alias("pos"), "status")


@query(
    "redirects_denied",
    expected("url final_url n_hops error_code", ("https://a/1", "https://b/no", 1, "ROBOTS_DENIED"), ("https://a/2", "https://a/no", 1, None), ("https://a/3", "https://b/yes", 1, None)),
)
def redirects_denied(spark, sf):
    """A hop to another origin asks that origin's robots; one within the origin does not ask again."""
    hops = [("https://a/1", 302, "https://b/no", True), ("https://a/2", 302, "https://a/no", True), ("https://a/3", 302, "https://b/yes", True), ("https://b/no", 200, None, False), ("https://a/no", 200, None, False), ("https://b/yes", 200, None, True)]
    starts = spark.createDataFrame([(f"https://a/{i}",) for i in (1, 2, 3)], "url string")
    out = P.resolve_redirects(starts, spark.createDataFrame(hops, "url string, status int, location string, allowed boolean"))
    return out.select("url", "final_url", F.col("n_hops").cast("long").alias("n_hops"), "error_code")


@query("links_of_page", expected("url response", ("https://a.example/", "url: https://a.example/\nsource: sitemap\ncount: 1\n\n- https://a.example/2")))
def links_of_page(spark, sf):
    """discover_links with a filter, as text."""
    pages = spark.createDataFrame([("https://a.example/", "")], "url string, html string")
    sitemaps = spark.createDataFrame([("https://a.example/sitemap.xml", _SITEMAP.format(_locs("https://a.example/1", "https://a.example/2")))], "url string, body string")
    found = S.discover_links(pages, sitemaps, spark.createDataFrame([], "url string, body string"), spark.createDataFrame([], "origin string, body string"), wanted="/2")
    return found.select("url", R.links_response(F.col("url"), F.col("source"), F.col("links"), F.col("truncated"), F.col("before_filter")).alias("response"))


@query(
    "tier_choice",
    expected(
        "id tier escalation method markdown",
        (1, "http", None, "readability", _PROSE), (2, "browser", "empty-root", "body-fallback", "rendered"), (3, "http", None, "body-fallback", "few"), (4, "browser", None, "geometry", "字" * 250), (5, "http", None, "body-fallback", ""), (6, "http", None, "body-fallback", "few"),
    ),
)
def tier_choice(spark, sf):
    """A page that reads well; an empty root; a poor page whose browser page is no better, one whose layout
    shows its column; an empty root without a browser page; a poor page without one."""
    root, column = '<div id="root"></div>', f'<span data-gid="1">{"字" * 250}</span>'
    article = f"<article><p>{_PROSE}</p></article>"
    rows = [(1, article, "<p>other", None, 0), (2, root, "<p>rendered", None, 0), (3, "<p>few", "<p>other", None, 0), (4, "<p>few", column, ["1"], 250), (5, root, None, None, 0), (6, "<p>few", None, None, 0)]
    captures = spark.createDataFrame(rows, "id long, http_html string, browser_html string, block_ids array<string>, text_length long").withColumn("url", F.lit("https://e.example/"))
    return E.extract_of_two(captures).select("id", "tier", "escalation", "method", "markdown")


@query("ttl_settings", expected("raw ttl", ("5000", 5000.0), ("0", 900000.0), ("-1", 900000.0), ("x", 900000.0), (None, 900000.0), ("Infinity", 900000.0), ("1.5e3", 1500.0)))
def ttl_settings(spark, sf):
    raws = [(x,) for x in ("5000", "0", "-1", "x", None, "Infinity", "1.5e3")]
    return spark.createDataFrame(raws, "raw string").select("raw", P.ttl_setting(F.col("raw")).alias("ttl"))


@query("prune_throttle", expected("last due", (None, True), (0, True), (900, True), (901, False), (1000, False)))
def prune_throttle(spark, sf):
    rows = spark.createDataFrame([(None,), (0,), (900,), (901,), (1000,)], "last long")
    return rows.select("last", ST.prune_due(F.col("last"), F.lit(1000), 100).alias("due"))


@query("stale_hosts", expected("host", ("new",), ("edge",), ("awaited",)))
def stale_hosts(spark, sf):
    rows = [("new", 990, False), ("edge", 900, None), ("old", 899, False), ("awaited", 10, True)]
    return ST.drop_stale_hosts(spark.createDataFrame(rows, "host string, last_request_at long, waiting boolean"), 1000, 100).select("host")
