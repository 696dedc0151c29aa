"""Addresses, errors, quality, turns, cache, links, robots, state and streams."""

import pytest
from pyspark.sql import functions as F

from quarryloom.functions import net as N
from quarryloom.functions import quality as Q
from quarryloom.functions.charset import decode_body
from quarryloom.operators import geometry as G
from quarryloom.operators import links as L
from quarryloom.operators import policy as P
from quarryloom.sources import feeds
from quarryloom.sources import state as S


@pytest.mark.parametrize(
    "ip,reserved",
    [(x, False) for x in ("8.8.8.8", "93.184.216.34", "2001:4860:4860::8888", "::ffff:8.8.8.8", "64:ff9b::808:808")]
    + [(x, True) for x in ("127.0.0.1", "10.0.0.1", "172.16.0.1", "192.168.1.1", "169.254.1.1", "0.0.0.0", "100.64.0.1", "::1", "fc00::1", "fe80::1", "::ffff:127.0.0.1", "::127.0.0.1", "64:ff9b::7f00:1", "nonsense", "")],
)
def test_addresses(spark, ip, reserved):
    assert N.address_reserved(ip) is reserved
    if ":" not in ip:
        assert spark.createDataFrame([(ip,)], "ip string").select(N.ipv4_reserved(F.col("ip"))).first()[0] is reserved


def test_errors(spark):
    rows = [([("X", "outer"), ("ENOTFOUND", "dns")],), ([("CERT_HAS_EXPIRED", "m")],), ([("ERR_HTTP2_STREAM_ERROR", "m")],), ([("X", "outer"), ("Y", "inner"), (None, None)],), ([],)]
    got = spark.createDataFrame(rows, "c array<struct<code:string,message:string>>").select(N.classify_causes(F.col("c")).alias("k")).collect()
    assert [tuple(r["k"]) for r in got] == [("dns", "ENOTFOUND"), ("tls", "CERT_HAS_EXPIRED"), ("connection", "ERR_HTTP2_STREAM_ERROR"), ("unknown", "inner"), ("unknown", None)]


BASE = dict(ext=900.0, vis=1000.0, cells=2, canvas=0, svg=0, leaves=50, img=1, alt=0, area=0.05, tok=200, real=None, table=None)


@pytest.mark.parametrize(
    "change,kind",
    [
        ({}, None), ({"ext": 300.0}, "抽出"), ({"cells": 40}, "表"), ({"ext": 600.0}, None), ({"ext": 300.0, "tok": 500}, None), ({"ext": 300.0, "tok": 499}, "抽出"),
        ({"ext": 300.0, "tok": 5000, "cells": 40}, None), ({"ext": 300.0, "tok": 5000, "cells": 0, "canvas": 20}, "表"), ({"img": 4, "alt": 4, "area": 0.5}, "J6"),
        ({"img": 4, "alt": 0, "area": 0.5}, None), ({"img": 4, "alt": 4, "area": 0.5, "tok": 844}, None), ({"real": 0.5}, "表"), ({"real": 0.5, "table": 0.5, "tok": 5000}, None),
        ({"real": 0.5, "table": 0.1, "tok": 5000}, "表"), ({"ext": 0.0, "vis": 0.0}, None), ({"leaves": 0, "cells": 0}, None),
    ],
)
def test_quality(spark, change, kind):
    v = {**BASE, **change}
    row = spark.createDataFrame([tuple(v.values())], "ext double, vis double, cells int, canvas int, svg int, leaves int, img int, alt int, area double, tok int, real double, `table` double")
    r = row.select(Q.evaluate_quality(*[F.col(c) for c in ("ext", "vis", "cells", "canvas", "svg", "leaves", "img", "alt", "area", "tok", "real", "table")]).alias("q")).first()["q"]
    assert r["low_quality"] is (kind is not None) and (kind is None or r["reason"].startswith(kind))


@pytest.mark.parametrize("w,h,n,last,cut", [(1280, 800, 1, 800, False), (1280, 2160, 2, 1080, False), (1280, 2500, 3, 340, False), (800, 1000, 1, 1000, False), (1280, 1000000, 10, 1080, True), (1280, 0, 1, 1, False)])
def test_tiles(spark, w, h, n, last, cut):
    r = spark.createDataFrame([(w, h)], "w int, h int").select(Q.tile_plan(F.col("w"), F.col("h"), F.lit(1280), F.lit(1080)).alias("t"), Q.tiles_cut(F.col("h"), F.lit(1080)).alias("c")).first()
    assert len(r["t"]) == n and r["t"][-1]["height"] == last and r["t"][0]["width"] == min(w, 1280) and r["c"] is cut


def test_turns(spark):
    rows = [("a", 0, 1, 0), ("a", 0, 2, 0), ("b", 0, 3, 0), ("c", 0, 4, 3000), ("c", 10, 5, 3000)]
    got = P.turn_schedule(spark.createDataFrame(rows, "host string, at long, id long, delay int"), "host", "at", "id", "delay").collect()
    assert {r["id"]: r["waited"] for r in got} == {1: 0, 2: 1000, 3: 0, 4: 0, 5: 2990}


def test_streams_equal_batches(spark, tmp_path):
    from quarryloom.streaming.stateful import CacheMachine, TemplateLearner, TurnQueue, VersionDiffer, apply

    rows = [(f"u{i % 3}", i * 700, i) for i in range(40)]
    schema = "url string, at long, tie long"
    for k in range(4):  # arrive in order, in four batches
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {tuple(r) for r in spark.table(name).collect()}

    got = run(apply(stream(), "url", CacheMachine(2000)), "cache")
    want = P.cache_replay(spark.createDataFrame(rows, schema), "url", "at", "tie", 2000).select("url", "at", "tie", "status")
    assert got == {tuple(r) for r in want.collect()}
    got = run(apply(stream().withColumnRenamed("url", "host"), "host", TurnQueue(3000)), "turns")
    want = P.turn_schedule(spark.createDataFrame(rows, "host string, at long, tie long"), "host", "at", "tie", min_interval=3000).select("host", "at", "tie", "granted")
    assert got == {tuple(r) for r in want.collect()}
    versions = stream().select("url", F.col("at").alias("fetched_at"), F.col("tie").cast("string").alias("markdown"))
    got = run(apply(versions, "url", VersionDiffer()), "versions")
    assert {(u, t, p) for u, t, p, _ in got} == {(u, t, str(i - 3) if i >= 3 else None) for u, t, i in rows}
    pages = stream().select(F.lit("d").alias("domain"), F.col("tie").cast("string").alias("url"), F.col("at").alias("fetched_at"), F.array(F.lit("Nav"), F.col("url")).alias("block_hashes"))
    got = {u: h for _, u, h in ((a, b, tuple(c)) for a, b, c in run_list(spark, pages, tmp_path, TemplateLearner, apply))}
    assert got["0"] == () and got["1"] == () and got["2"] == ("Nav",) and got["39"] == ("Nav",)


def run_list(spark, pages, tmp_path, processor, apply):
    q = apply(pages, "domain", processor()).writeStream.format("memory").queryName("templates").outputMode("append").option("checkpointLocation", f"{tmp_path}/t").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table("templates").collect()]


def test_links(spark):
    rows = [("p", "https://a/blog/1", "One", 0), ("p", "https://a/x/articles/2", None, 1), ("p", "https://a/blog/1", "Again", 2)]
    df = spark.createDataFrame(rows, "page string, url string, title string, pos int")
    links = lambda f, **k: L.finish(df, "page", f, **k).first()
    assert [x["url"] for x in links("BLOG").links] == ["https://a/blog/1"] and links("*/articles/*").links[0]["url"].endswith("2")
    assert links("nomatch").links == [] and links("nomatch").before_filter == 2
    assert links(None, limit=1).truncated and len(links(None, limit=1).links) == 1


def test_data_sources(spark):
    rows = [("https://e.jp/p", f"https://e.jp/d/{i}.csv", f"年度{i}", i) for i in range(20)] + [("https://e.jp/p", "https://e.jp/x.zip", "Z", 30), ("https://e.jp/p", "https://e.jp/api/", "doc", 31)]
    rows += [("https://e.jp/q", "https://other.jp/", "オープンデータ", 0), ("https://e.jp/q", "https://e.jp/r?u=redirect_api_log", "ダウンロード", 1)]
    df = spark.createDataFrame(rows, "base string, url string, title string, pos int").withColumn("page", F.col("base"))
    got = {r["page"]: r["hints"] for r in L.data_sources(df, "page", "base").collect()}
    assert set(got) == {"https://e.jp/p"}
    assert got["https://e.jp/p"] == ["- 年度0 — https://e.jp/d/0.csv(ほか19件、links filter:'*.csv' で列挙可)", "- Z — https://e.jp/x.zip", "- doc — https://e.jp/api/"]


def test_feeds_and_robots(spark):
    assert feeds.parse_sitemap("<urlset><url><loc> https://a/1?x&amp;y </loc></url></urlset>") == (["https://a/1?x&y"], [])
    assert feeds.parse_sitemap("<sitemapindex><sitemap><loc>https://a/s</loc></sitemap></sitemapindex>") == ([], ["https://a/s"])
    assert feeds.parse_feed("<rss><item><title><![CDATA[A & B]]></title><link>https://a</link></item></rss>") == [("https://a", "A & B")]
    assert feeds.parse_feed('<feed><entry><title>T</title><link rel="self" href="s"/><link href="https://b"/></entry></feed>') == [("https://b", "T")]
    assert feeds.parse_sitemap(None) == ([], []) and feeds.parse_feed("") == []
    body = "User-agent: *\nDisallow: /p\nCrawl-delay: 3\nUser-agent: ql\nAllow: /p/ok$\nDisallow: /p/*\nSitemap: https://a/s.xml"
    assert feeds.parse_robots(body, "other") == ([(False, "/p")], 3.0, ["https://a/s.xml"])
    rules = feeds.robots_rules(spark.createDataFrame([("https://a", body), ("https://b", None)], "origin string, body string"), "ql-bot")
    urls = spark.createDataFrame([("https://a/p/ok",), ("https://a/p/ok/x",), ("https://a/p",), ("https://b/p/x",)], "url string")
    assert {r["url"]: r["allowed"] for r in P.robots_allowed(urls, rules).collect()} == {"https://a/p/ok": True, "https://a/p/ok/x": False, "https://a/p": True, "https://b/p/x": True}
    maps = spark.createDataFrame([("s", "https://a/i", "<sitemapindex>" + "".join(f"<sitemap><loc>https://a/{k}</loc></sitemap>" for k in range(5)) + "</sitemapindex>")] + [(None, f"https://a/{k}", f"<urlset><url><loc>https://a/p{k}</loc></url></urlset>") for k in range(5)], "seed string, url string, body string")
    assert [r["url"] for r in feeds.sitemap_links(maps).filter("seed = 's'").orderBy("pos").collect()] == ["https://a/p0", "https://a/p1", "https://a/p2"]


def test_snapshots(spark, tmp_path):
    schema = S.SCHEMAS["host_requests"]
    store = S.Snapshots(spark, f"file://{tmp_path}/hosts", schema)
    assert store.read().count() == 0
    store.write(spark.createDataFrame([("a", 5)], schema))
    store.write(S.raise_to(store.read(), spark.createDataFrame([("a", 3), ("b", 1)], schema), ["host"], "last_request_at"))
    store.write(S.raise_to(store.read(), spark.createDataFrame([("b", 9)], schema), ["host"], "last_request_at"))
    assert {tuple(r) for r in store.read().collect()} == {("a", 5), ("b", 9)}


@pytest.mark.parametrize(
    "body,header,codec,text",
    [
        ("日本語".encode("cp932"), "text/html; charset=Shift_JIS", "cp932", "日本語"), (b'<meta charset="x-euc-jp">' + "日本".encode("euc_jp"), None, "euc_jp", None),
        ("日本語です".encode("iso2022_jp"), None, "iso2022_jp", "日本語です"), ("日本語です".encode(), None, "utf-8", "日本語です"), ("日本語の文章です".encode("cp932"), None, "cp932", "日本語の文章です"), (b"", None, "utf-8", ""),
    ],
)
def test_charsets(body, header, codec, text):
    found, got = decode_body(body, header)
    assert found.replace("-", "_") == codec.replace("-", "_") and (text is None or got == text)


def test_columns_of_a_page(spark):
    rows = [("p", 1, 0.0, 0.0, 200.0, 20.0, 50), ("p", 2, 0.0, 30.0, 200.0, 20.0, 50), ("p", 3, 300.0, 0.0, 200.0, 20.0, 400), ("p", 4, 300.0, 30.0, 200.0, 20.0, 500), ("p", 5, 300.0, 2000.0, 200.0, 20.0, 10), ("p", 6, 0.0, 60.0, 0.0, 20.0, 99)]
    r = G.main_cluster(spark.createDataFrame(rows, "page string, id int, x double, y double, width double, height double, text_length int"), "page").first()
    assert (r["block_ids"], r["text_length"], r["top"], r["bottom"], r["left"]) == ([3, 4], 900, 0.0, 50.0, 300.0)
