"""Queries on page trees. SQL cannot parse HTML: tests hold these against fixtures, except where the test
tables' markup is regular enough for patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryloom.functions.cjk import cjk_normalised
from quarryloom.functions.net import V4_BOUNDS, ip_reserved
from quarryloom.functions.urls import origin
from quarryloom.operators import extract as E
from quarryloom.operators import geometry as G
from quarryloom.operators import policy as P
from quarryloom.operators.view import assessed, fetch_view
from quarryloom.plans.base import query, table


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html")


@query("extract_markdown")
def extract_markdown(spark, sf):
    return E.extract_markdown(_pages(spark, sf)).select("page_id", "title", "method", "pruned", "markdown")


@query("extract_selector")
def extract_selector(spark, sf):
    return E.extract_markdown(_pages(spark, sf), selector="article > h1, footer").select("page_id", "markdown", "error_code")


@query(
    "page_statistics",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<(td|th)\\b')) AS DOUBLE) AS table_cells, CAST(len(regexp_extract_all(html, '<img\\b')) AS DOUBLE) AS images FROM pages""",
)
def page_statistics(spark, sf):
    return E.extract_markdown(_pages(spark, sf)).select("page_id", "table_cells", "images")


@query("page_quality")
def page_quality(spark, sf):
    return assessed(_pages(spark, sf)).select("page_id", "tokens", "quality.density", "quality.low_quality", "quality.reason")


@query(
    "page_links",
    """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">')))) AS i FROM pages),
    f AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link_url, min(i) AS i FROM l GROUP BY ALL)
    SELECT page_id, link_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS link_pos FROM f""",
)
def page_links(spark, sf):
    return E.page_links(_pages(spark, sf)).select("page_id", "link_url", "link_pos")


@query("spa_signals")
def spa_signals(spark, sf):
    s = E.spa_statistics(_pages(spark, sf))
    return s.select("page_id", "html_chars", "text_chars", P.spa_reason(*[F.col(c) for c in ("root_id", "root_chars", "noscript", "html_chars", "text_chars")]).alias("reason"))


@query("cjk_normalise")
def cjk_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cjk_normalised(F.concat("text", F.lit(" とても **重要** です ＡＢＣ"))).alias("text"))


@query(
    "ip_reserved",
    f"""SELECT event_id, '64:ff9b::' || upper(to_hex(event_id % 65536)) || ':1' AS ip, {' OR '.join(f'(event_id % 65536) * 65536 + 1 BETWEEN {a} AND {b}' for a, b in V4_BOUNDS)} AS reserved FROM events""",
)
def ip_reserved_query(spark, sf):
    v6 = F.concat(F.lit("64:ff9b::"), F.hex(F.col("event_id") % 65536), F.lit(":1"))
    return table(spark, sf, "events").select("event_id", v6.alias("ip"), ip_reserved(v6).alias("reserved"))


@query("main_cluster")
def main_cluster(spark, sf):
    """Blocks laid out in two columns from the turns of conversations."""
    side = (F.col("turn") % 2) * 400
    blocks = table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("id"), side.cast("double").alias("x"), (F.col("turn") * 30).cast("double").alias("y"), F.lit(300.0).alias("width"), F.lit(20.0).alias("height"), F.length("text").alias("text_length")
    )
    return G.main_cluster(blocks, "conv_id")


def _captured(spark, sf):
    return _pages(spark, sf).select("url", "html", F.col("page_id").alias("fetched_at"))


@query("fetch_view_auto")
def fetch_view_auto(spark, sf):
    return fetch_view(_captured(spark, sf), "auto", max_tokens=2000)


@query("fetch_view_outline")
def fetch_view_outline(spark, sf):
    return fetch_view(_captured(spark, sf), "outline")


@query("fetch_view_section")
def fetch_view_section(spark, sf):
    return fetch_view(_captured(spark, sf), "markdown", section="s1", max_tokens=500)


@query("page_origins", "SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, count(*) AS pages FROM pages GROUP BY 1")
def page_origins(spark, sf):
    return _pages(spark, sf).groupBy(origin(F.col("url")).alias("origin")).agg(F.count(F.lit(1)).alias("pages"))
