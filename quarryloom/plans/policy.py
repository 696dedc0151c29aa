"""Queries on fetch policy, addresses, quality, links and responses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.functions import net as N
from quarryloom.functions import quality as Q
from quarryloom.functions import urls as U
from quarryloom.operators import links as L
from quarryloom.operators import policy as P
from quarryloom.plans.base import query, table
from quarryloom.sources import state as S

HOUR = 3_600_000
_MS = "CAST(epoch_us(ts) // 1000 AS BIGINT)"


def millis():
    """Milliseconds of a time without zone, whatever the session's zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000").cast("long")


def requests(spark, sf):
    at = millis()
    return table(spark, sf, "events").select("event_id", "user_id", at.alias("at"))


@query(
    "turn_schedule",
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, {_MS} AS t, greatest(1000, CASE WHEN user_id % 2 = 0 THEN {HOUR} ELSE 0 END) AS d,
      row_number() OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS i FROM events),
    g AS (SELECT event_id, user_id, t, d, i, t AS granted FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.t, e.d, e.i, greatest(e.t, g.granted + e.d) FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
    SELECT event_id, user_id, t AS "at", CAST(granted AS BIGINT) AS granted, CAST(granted - t AS BIGINT) AS waited FROM g""",
)
def turn_schedule(spark, sf):
    delay = F.when(F.col("user_id") % 2 == 0, HOUR).otherwise(0)
    return P.turn_schedule(requests(spark, sf).withColumn("delay", delay), "user_id", "at", "event_id", "delay").drop("delay")


@query("host_last_request", f"SELECT user_id, max({_MS}) AS last_request_at FROM events GROUP BY user_id")
def host_last_request(spark, sf):
    return requests(spark, sf).groupBy("user_id").agg(F.max("at").alias("last_request_at"))


_REPLAY = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, {_MS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) - 1 AS pos FROM events),
    g AS (SELECT event_id, user_id, t, pos, t AS last, 'miss' AS status FROM e WHERE pos = 0
      UNION ALL SELECT e.event_id, e.user_id, e.t, e.pos, CASE WHEN e.t - g.last < {24 * HOUR} THEN g.last ELSE e.t END, CASE WHEN e.t - g.last < {24 * HOUR} THEN 'fresh' ELSE 'miss' END
      FROM g JOIN e ON e.user_id = g.user_id AND e.pos = g.pos + 1)"""


@query("cache_replay", _REPLAY + ' SELECT user_id, CAST(pos AS INT) AS pos, t AS "at", event_id, status FROM g')
def cache_replay(spark, sf):
    return P.cache_replay(requests(spark, sf), "user_id", "at", "event_id", 24 * HOUR).withColumnRenamed("tie", "event_id")


def snapshot(spark, sf):
    """url, fetched_at, markdown, etag: versions of pages, made of events."""
    at = millis()
    return table(spark, sf, "events").select(
        F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example/"), (F.col("event_id") % 5).cast("string")).alias("url"),
        at.alias("fetched_at"),
        F.col("event_type").alias("markdown"),
        F.col("event_id").alias("version"),
    )


_SNAP = f"SELECT 'https://u' || user_id || '.example/' || (event_id % 5) AS url, {_MS} AS fetched_at, event_type AS markdown, event_id AS version FROM events"


@query("state_upsert", f"SELECT * FROM ({_SNAP}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, version DESC) = 1")
def state_upsert(spark, sf):
    rows = snapshot(spark, sf)
    return S.upsert(rows.filter(F.col("version") % 2 == 0), rows.filter(F.col("version") % 2 == 1), ["url"], "fetched_at", "version")


@query("state_touch", f"""WITH s AS (SELECT * FROM ({_SNAP}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, version DESC) = 1)
    SELECT url, CASE WHEN version % 3 = 0 THEN fetched_at + 1000 ELSE fetched_at END AS fetched_at, markdown, version FROM s""")
def state_touch(spark, sf):
    state = state_upsert(spark, sf)
    return S.touch(state, state.filter(F.col("version") % 3 == 0).select("url", (F.col("fetched_at") + 1000).alias("fetched_at")), ["url"])


@query("ttl_prune", f"SELECT * FROM ({_SNAP}) WHERE fetched_at >= (SELECT max({_MS}) FROM events) - {48 * HOUR}")
def ttl_prune(spark, sf):
    rows = snapshot(spark, sf)
    now = rows.agg(F.max("fetched_at")).first()[0] or 0
    return S.prune(rows, "fetched_at", now, 48 * HOUR)


@query(
    "freshness",
    f"SELECT url, version, coalesce((SELECT max({_MS}) FROM events) - fetched_at < {24 * HOUR}, false) AS fresh FROM ({_SNAP})",
)
def freshness(spark, sf):
    rows = snapshot(spark, sf)
    now = rows.agg(F.max("fetched_at").alias("now"))
    joined = rows.crossJoin(F.broadcast(now))  # one row
    return joined.select("url", "version", P.is_fresh(F.col("fetched_at"), F.col("now"), 24 * HOUR).alias("fresh"))


@query(
    "url_parts",
    r"""SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS hostname, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END AS path,
    regexp_matches(url, '(?i)^https?://') AS is_http FROM pages""",
)
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", U.hostname(u).alias("hostname"), U.host_with_port(u).alias("host"), U.origin(u).alias("origin"), U.pathname(u).alias("path"), U.is_http(u).alias("is_http"))


def page_links(spark, sf):
    """page_id, base, url, title, pos of the links in pages, by their regular markup."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    pairs = F.zip_with(found, titles, lambda a, b: F.struct(a.alias("href"), b.alias("title")))
    rows = table(spark, sf, "pages").select("page_id", F.col("url").alias("base"), F.posexplode(pairs).alias("pos", "l"))
    return rows.select("page_id", "base", "pos", F.concat(U.origin(F.col("base")), F.col("l.href")).alias("url"), F.col("l.title").alias("title"))


_LINKS = """l0 AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title,
    unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">')))) AS pos FROM pages),
  l AS (SELECT page_id, base, CAST(pos AS INT) AS pos, regexp_extract(base, '^(https?://[^/?#]*)', 1) || href AS url, title FROM l0),
  one AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1)"""


@query("link_dedupe", f"WITH {_LINKS} SELECT page_id, pos, url, title FROM one")
def link_dedupe(spark, sf):
    return L.first_of_each(page_links(spark, sf), "page_id").select("page_id", "pos", "url", "title")


@query(
    "link_filter",
    f"""WITH {_LINKS}, m AS (SELECT *, regexp_matches(url, '(?i)/t.*e') OR regexp_matches(title, '(?i)/t.*e') AS ok FROM one),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id, ok ORDER BY pos) AS n FROM m)
    SELECT page_id, coalesce(string_agg(url, ' ' ORDER BY pos) FILTER (ok AND n <= 3), '') AS urls, count(*) FILTER (ok) > 3 AS truncated, count(*) AS before_filter FROM k GROUP BY page_id""",
)
def link_filter(spark, sf):
    done = L.finish(page_links(spark, sf), "page_id", "/t*e", 3)
    return done.select("page_id", F.array_join(F.transform("links", lambda x: x["url"]), " ").alias("urls"), "truncated", "before_filter")


@query(
    "link_source",
    f"""WITH {_LINKS}, s AS (SELECT *, CASE WHEN pos % 4 = 0 AND page_id % 3 = 0 THEN 'sitemap' WHEN pos % 2 = 0 AND page_id % 2 = 0 THEN 'rss' ELSE 'page' END AS source FROM l),
    r AS (SELECT *, list_position(['sitemap', 'rss', 'page'], source) AS p FROM s) SELECT page_id, pos, url, source FROM r QUALIFY p = min(p) OVER (PARTITION BY page_id)""",
)
def link_source(spark, sf):
    source = F.when((F.col("pos") % 4 == 0) & (F.col("page_id") % 3 == 0), "sitemap").when((F.col("pos") % 2 == 0) & (F.col("page_id") % 2 == 0), "rss").otherwise("page")
    return L.choose_source(page_links(spark, sf).withColumn("source", source), "page_id").select("page_id", "pos", "url", "source")


@query(
    "data_sources",
    f"""WITH {_LINKS}, x AS (SELECT page_id, base, pos, title, url || CASE pos % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.zip' WHEN 2 THEN '/api/v1' ELSE '' END AS url FROM one),
    t AS (SELECT *, CASE WHEN regexp_matches(url, '\\.csv$') THEN '.csv' WHEN regexp_matches(url, '\\.zip$') THEN '.zip' END AS ending FROM x),
    u AS (SELECT *, coalesce(ending, 'url:' || url) AS g FROM t WHERE ending IS NOT NULL OR regexp_matches(title || ' ' || url, '(?i)\\bapi\\b')),
    f AS (SELECT page_id, g, ending IS NULL AS word, min(pos) AS pos, arg_min(url, pos) AS url, arg_min(title, pos) AS title, count(*) AS n FROM u GROUP BY page_id, g, ending IS NULL),
    k AS (SELECT *, '- ' || CASE WHEN title <> '' THEN title || ' — ' ELSE '' END || url || CASE WHEN n > 1 THEN '(ほか' || (n - 1) || '件' || CASE WHEN word THEN '' ELSE '、links filter:''*' || g || ''' で列挙可' END || ')' ELSE '' END AS line,
      row_number() OVER (PARTITION BY page_id ORDER BY word, pos) AS place FROM f)
    SELECT page_id, string_agg(line, chr(10) ORDER BY place) AS hints FROM k WHERE place <= 5 GROUP BY page_id""",
)
def data_sources(spark, sf):
    ends = F.element_at(F.array(F.lit(".csv"), F.lit(".zip"), F.lit("/api/v1"), F.lit("")), F.col("pos") % 4 + 1)
    rows = L.first_of_each(page_links(spark, sf), "page_id").withColumn("url", F.concat("url", ends))
    return L.data_sources(rows, "page_id", "base").select("page_id", F.array_join("hints", "\n").alias("hints"))


_IP = "((event_id * 7919) % 256) || '.' || ((event_id * 104729) % 256) || '.' || (event_id % 256) || '.' || (user_id % 256)"


@query(
    "ipv4_reserved",
    f"""WITH e AS (SELECT event_id, ip, CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536 + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT) AS n
      FROM (SELECT event_id, {_IP} AS ip, string_split({_IP}, '.') AS p FROM events))
    SELECT event_id, ip, {' OR '.join(f'n BETWEEN {a} AND {b}' for a, b in N.V4_BOUNDS)} AS reserved FROM e""",
)
def ipv4_reserved(spark, sf):
    e = F.col("event_id")
    part = lambda c: F.pmod(c, F.lit(256)).cast("string")
    ip = F.concat_ws(".", part(e * 7919), part(e * 104729), part(e), part(F.col("user_id")))
    return table(spark, sf, "events").select("event_id", ip.alias("ip"), N.ipv4_reserved(ip).alias("reserved"))


_CODES = ["ENOTFOUND", "EAI_AGAIN", "CERT_HAS_EXPIRED", "ERR_TLS_X", "ECONNRESET", "ERR_HTTP2_STREAM_ERROR", "EOTHER", "HOSTNAME_MISMATCH", None]


@query(
    "error_kind",
    f"""WITH e AS (SELECT event_id, [{', '.join(f"'{c}'" if c else 'NULL' for c in _CODES)}][event_id % 9 + 1] AS a, [{', '.join(f"'{c}'" if c else 'NULL' for c in _CODES)}][(event_id // 9) % 9 + 1] AS b FROM events),
    k AS (SELECT *, CASE WHEN a IN ('ENOTFOUND', 'EAI_AGAIN') THEN 'dns' WHEN a LIKE 'CERT@_%' ESCAPE '@' OR a LIKE 'ERR@_TLS@_%' ESCAPE '@' OR a = 'HOSTNAME_MISMATCH' THEN 'tls' WHEN a = 'ECONNRESET' OR a LIKE 'ERR@_HTTP2@_%' ESCAPE '@' THEN 'connection' END AS ka,
      CASE WHEN b IN ('ENOTFOUND', 'EAI_AGAIN') THEN 'dns' WHEN b LIKE 'CERT@_%' ESCAPE '@' OR b LIKE 'ERR@_TLS@_%' ESCAPE '@' OR b = 'HOSTNAME_MISMATCH' THEN 'tls' WHEN b = 'ECONNRESET' OR b LIKE 'ERR@_HTTP2@_%' ESCAPE '@' THEN 'connection' END AS kb FROM e)
    SELECT event_id, coalesce(ka, kb, 'unknown') AS kind, CASE WHEN ka IS NOT NULL THEN a WHEN kb IS NOT NULL THEN b ELSE 'inner' END AS detail FROM k""",
)
def error_kind(spark, sf):
    codes = F.array(*[F.lit(c).cast("string") for c in _CODES])
    cause = lambda i, m: F.struct(F.element_at(codes, (i % 9 + 1).cast("int")).alias("code"), F.lit(m).alias("message"))
    causes = F.array(cause(F.col("event_id"), "outer"), cause(F.floor(F.col("event_id") / 9), "inner"))
    return table(spark, sf, "events").select("event_id", N.classify_causes(causes).alias("c")).select("event_id", "c.*")


_Q = """doc_id, n_chars * 0.9::DOUBLE AS e, CAST(n_chars + (doc_id % 7) * 300 AS DOUBLE) AS v, CAST(doc_id % 50 AS DOUBLE) AS cells, CAST(doc_id % 11 AS DOUBLE) AS cv, CAST(doc_id % 5 AS DOUBLE) AS sv, CAST(doc_id % 60 AS DOUBLE) AS leaves,
    CAST(doc_id % 4 AS DOUBLE) AS img, CAST(doc_id % 3 AS DOUBLE) AS noalt, (doc_id % 10) / 10.0::DOUBLE AS area, n_chars // 4 AS tok, CASE WHEN doc_id % 6 = 0 THEN (doc_id % 9) / 9.0::DOUBLE END AS vis, CASE WHEN doc_id % 12 = 0 THEN (doc_id % 4) / 8.0::DOUBLE END AS tab"""


@query(
    "quality",
    f"""WITH q AS (SELECT {_Q} FROM documents),
    a AS (SELECT *, CASE WHEN v > 0 THEN e / v ELSE 1 END AS density, coalesce(vis, CASE WHEN leaves > 0 THEN (cells + cv + sv) / leaves ELSE 0 END) AS occupancy, CASE WHEN img > 0 THEN noalt / img ELSE 0 END AS missing_alt, tok >= 500 AS enough,
      CASE WHEN vis IS NOT NULL THEN coalesce(tab, 0) WHEN leaves > 0 THEN cells / leaves ELSE 0 END AS t, CASE WHEN vis IS NOT NULL THEN greatest(vis - coalesce(tab, 0), 0) WHEN leaves > 0 THEN (cv + sv) / leaves ELSE 0 END AS o FROM q),
    b AS (SELECT *, CASE WHEN density >= 1 OR enough THEN o ELSE t + o END AS counted FROM a)
    SELECT doc_id, density, occupancy, missing_alt, CASE WHEN density < 0.6::DOUBLE AND NOT enough THEN 'density' WHEN counted > 0.3::DOUBLE THEN 'occupancy' WHEN area > 0.3::DOUBLE AND missing_alt > 0.5::DOUBLE AND NOT enough THEN 'images' END AS why FROM b""",
)
def quality(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    mod = lambda k: (d % k).cast("double")
    r = Q.evaluate_quality(
        n * F.lit(0.9), (n + (d % 7) * 300).cast("double"), mod(50), mod(11), mod(5), mod(60), mod(4), mod(3), mod(10) / 10, F.floor(n / 4),
        F.when(d % 6 == 0, mod(9) / 9), F.when(d % 12 == 0, mod(4) / 8),
    )
    why = F.when(F.col("r.reason").startswith("抽出"), "density").when(F.col("r.reason").startswith("表"), "occupancy").when(F.col("r.reason").startswith("J6"), "images")
    return table(spark, sf, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.density", "r.occupancy", "r.missing_alt", why.alias("why"))


@query(
    "tile_plan",
    """WITH d AS (SELECT doc_id, CAST(n_chars % 2000 AS INT) AS w, CAST(n_chars * 3 AS INT) AS h FROM documents),
    t AS (SELECT *, greatest(h, 1) AS total, least(10, CAST(ceil(greatest(h, 1) / 1080.0::DOUBLE) AS INT)) AS n FROM d)
    SELECT doc_id, CAST(i AS INT) AS tile, CAST(i * 1080 AS INT) AS y, CASE WHEN w > 0 THEN least(w, 1280) ELSE 1280 END AS width, CAST(least(1080, total - i * 1080) AS INT) AS height, ceil(total / 1080.0::DOUBLE) > 10 AS cut
    FROM (SELECT *, unnest(range(n)) AS i FROM t)""",
)
def tile_plan(spark, sf):
    w, h = (F.col("n_chars") % 2000).cast("int"), (F.col("n_chars") * 3).cast("int")
    plan = Q.tile_plan(w, h, F.lit(1280), F.lit(1080))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(plan).alias("tile", "t"), Q.tiles_cut(h, F.lit(1080)).alias("cut"))
    return rows.select("doc_id", "tile", "t.y", "t.width", "t.height", "cut")


@query(
    "response_routing",
    """WITH r AS (SELECT page_id, CASE page_id % 11 WHEN 0 THEN 304 WHEN 1 THEN 404 ELSE 200 END AS status, CASE page_id % 5 WHEN 0 THEN 'text/csv' WHEN 1 THEN NULL WHEN 2 THEN 'application/xhtml+xml; charset=utf-8' ELSE 'Text/HTML' END AS ct, strlen(html) AS n FROM pages),
    k AS (SELECT *, CASE WHEN status = 304 THEN 'not_modified' WHEN status = 404 THEN 'error' WHEN (ct IS NULL OR ct <> 'text/csv') AND n > 6000 THEN 'error' WHEN ct IS NULL OR ct <> 'text/csv' THEN 'html' ELSE 'handoff' END AS kind FROM r)
    SELECT page_id, kind, CASE WHEN kind = 'error' THEN CASE WHEN status = 404 THEN 'HTTP_STATUS_ERROR' ELSE 'PAYLOAD_TOO_LARGE' END END AS error_code, CASE WHEN kind = 'handoff' THEN least(n, 1000) ELSE 0 END AS preview_bytes, kind = 'handoff' AND n > 1000 AS cut FROM k""",
)
def response_routing(spark, sf):
    p = F.col("page_id")
    status = F.when(p % 11 == 0, 304).when(p % 11 == 1, 404).otherwise(200)
    ct = F.when(p % 5 == 0, "text/csv").when(p % 5 == 1, F.lit(None).cast("string")).when(p % 5 == 2, "application/xhtml+xml; charset=utf-8").otherwise("Text/HTML")
    rows = table(spark, sf, "pages").select("page_id", status.alias("status"), ct.alias("content_type"), F.col("html").cast("binary").alias("body"))
    return P.route(rows, 6000, 1000).select("page_id", "kind", "error_code", F.coalesce(F.octet_length("preview"), F.lit(0)).cast("long").alias("preview_bytes"), "cut")


@query(
    "redirects",
    """WITH RECURSIVE h AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 200 WHEN c_custkey % 17 = 0 THEN 302 ELSE 301 END AS status, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 17 = 0 THEN NULL ELSE c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 6 ELSE 1 END END AS loc FROM customer),
    w AS (SELECT k AS start, k AS cur, 0 AS n FROM h UNION ALL SELECT w.start, h.loc, w.n + 1 FROM w JOIN h ON h.k = w.cur WHERE h.loc IS NOT NULL AND w.n < 5),
    l AS (SELECT start, max(n) AS n FROM w GROUP BY start), f AS (SELECT w.start, w.cur, w.n, h.status, h.loc, h.k IS NOT NULL AS seen FROM l JOIN w USING (start, n) LEFT JOIN h ON h.k = w.cur)
    SELECT start || '' AS url, cur || '' AS final_url, CAST(n AS INT) AS n_hops, CAST(CASE WHEN loc IS NOT NULL THEN 310 ELSE coalesce(status, 0) END AS INT) AS status, CASE WHEN NOT seen THEN 'NETWORK_ERROR' WHEN loc IS NOT NULL OR status = 302 THEN 'HTTP_STATUS_ERROR' END AS error_code FROM f""",
)
def redirects(spark, sf):
    k = F.col("c_custkey")
    end = (k % 3 == 0) | (k % 17 == 0)
    hops = table(spark, sf, "customer").select(
        k.cast("string").alias("url"),
        F.when(k % 3 == 0, 200).when(k % 17 == 0, 302).otherwise(301).alias("status"),
        F.when(~end, (k + F.when(k % 2 == 0, 6).otherwise(1)).cast("string")).alias("location"),
    )
    return P.resolve_redirects(hops.select("url"), hops).withColumn("status", F.coalesce("status", F.lit(0)))


_ROBOTS = [("/en/", False), ("/en/7*", True), ("/*.html$", False), ("/de/", False), ("/de/6", True), ("/", True)]


@query(
    "robots_allowed",
    """WITH t AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || regexp_extract(url, '(\\?[^#]*)', 1) AS p FROM pages),
    r AS (SELECT * FROM (VALUES ('/en/', false, '^/en/'), ('/en/7*', true, '^/en/7'), ('/*.html$', false, '^/.*\\.html$'), ('/de/', false, '^/de/'), ('/de/6', true, '^/de/6'), ('/', true, '^/')) AS v(pattern, allow, rx)),
    m AS (SELECT t.page_id, r.pattern, r.allow FROM t JOIN r ON regexp_matches(t.p, r.rx))
    SELECT t.page_id, coalesce((SELECT arg_max(allow, length(pattern) * 2 + CAST(allow AS INT)) FROM m WHERE m.page_id = t.page_id), true) AS allowed FROM t""",
)
def robots_allowed(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("allow", T.BooleanType())])
    rules = pages.select(U.origin(F.col("url")).alias("origin")).distinct().crossJoin(F.broadcast(spark.createDataFrame(_ROBOTS, schema)))
    return P.robots_allowed(pages, rules).select("page_id", "allowed")


@query(
    "spa_rules",
    """WITH s AS (SELECT doc_id, ['root', 'main', 'app', NULL][doc_id % 4 + 1] AS root, doc_id % 25 AS rc, ['', 'Please enable JS', 'nothing', '有効にして'][(doc_id // 4) % 4 + 1] AS ns, CAST(n_chars * 2 AS DOUBLE) AS h, CAST((doc_id % 20) * 20 AS DOUBLE) AS t FROM documents)
    SELECT doc_id, CASE WHEN root IN ('root', 'app') AND rc < 10 THEN 'empty-root' WHEN regexp_matches(ns, '(?i)javascript|有効に|enable') THEN 'noscript' WHEN h > 2000 AND t / greatest(h, 1) < 0.02::DOUBLE THEN 'low-text-share' WHEN h > 2000 AND t < 200 THEN 'little-text' END AS reason FROM s""",
)
def spa_rules(spark, sf):
    d = F.col("doc_id")
    root = F.element_at(F.array(F.lit("root"), F.lit("main"), F.lit("app"), F.lit(None).cast("string")), (d % 4 + 1).cast("int"))
    said = F.element_at(F.array(F.lit(""), F.lit("Please enable JS"), F.lit("nothing"), F.lit("有効にして")), (F.floor(d / 4) % 4 + 1).cast("int"))
    reason = P.spa_reason(root, d % 25, said, (F.col("n_chars") * 2).cast("double"), ((d % 20) * 20).cast("double"))
    return table(spark, sf, "documents").select("doc_id", reason.alias("reason"))


@query(
    "pdf_decision",
    """WITH p AS (SELECT conv_id, list(left(text, CAST((conv_id % 4) * 25 AS INT)) ORDER BY turn) AS pages FROM conversations GROUP BY conv_id),
    t AS (SELECT conv_id, list_transform(pages, lambda x: trim(x, ' ')) AS pages FROM p)
    SELECT conv_id, list_sum(list_transform(pages, lambda x: length(x))) >= len(pages) * 30 AS has_text, array_to_string(list_transform(pages, lambda x, i: '## ページ ' || i || chr(10) || chr(10) || x), chr(10) || chr(10)) AS markdown FROM t""",
)
def pdf_decision(spark, sf):
    part = F.struct("turn", F.expr("left(text, cast((conv_id % 4) * 25 as int))").alias("t"))
    pages = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]).alias("p"))
    return pages.select("conv_id", Q.has_text_layer(F.col("p")).alias("has_text"), Q.pdf_markdown(F.col("p")).alias("markdown"))


@query("scale_clamp", "SELECT doc_id, least(greatest((doc_id % 30) / 20.0::DOUBLE, 0.5::DOUBLE), 1.0::DOUBLE) AS scale FROM documents")
def scale_clamp(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.clamp_scale((F.col("doc_id") % 30) / F.lit(20.0)).alias("scale"))


@query(
    "visual_area",
    """SELECT conv_id, CASE WHEN conv_id % 9 > 0 THEN least(list_sum(list(length(text) * CAST(turn + 1 AS DOUBLE) ORDER BY turn)) / ((conv_id % 9) * 1000.0::DOUBLE), 1) ELSE 0 END AS share FROM conversations GROUP BY conv_id""",
)
def visual_area(spark, sf):
    sides = F.struct("turn", F.length("text").alias("w"), (F.col("turn") + 1).alias("h"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(sides)).alias("s"))
    side = lambda k: F.transform("s", lambda x: x[k])
    return rows.select("conv_id", Q.area_share(side("w"), side("h"), F.col("conv_id") % 9, F.lit(1000)).alias("share"))
