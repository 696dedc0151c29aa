"""When and whether a page may be fetched: cache freshness, turns per host, robots, redirects, routing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryloom.functions.urls import is_html_type, is_http, origin, pathname

TTL_MS, MIN_INTERVAL_MS = 15 * 60 * 1000, 1000  # fixed values
MAX_REDIRECTS, BODY_CAP, PREVIEW_CAP = 5, 20 * 1024 * 1024, 256 * 1024
# fixed values: rules that a page needs a browser
SPA_ROOTS, SPA_ROOT_CHARS, SPA_HTML, SPA_SHARE, SPA_CHARS = ["root", "app", "__next", "__nuxt"], 10, 2000, 0.02, 200


def turn_schedule(requests: DataFrame, host: str, arrival: str, tie: str, interval: str | None = None, min_interval: int = MIN_INTERVAL_MS) -> DataFrame:
    """requests with granted and waited: a host's requests go in order of arrival, each at least an interval
    after the one before. interval: column of a host's crawl delay, which counts if it is longer.

    granted_i = max(arrival_i, granted_i-1 + d) unrolls to i d + max over j <= i of (arrival_j - j d): one
    running maximum, nothing sequential to write."""
    d = F.greatest(F.lit(min_interval), F.coalesce(F.col(interval), F.lit(0))).cast("long") if interval else F.lit(min_interval).cast("long")
    order = Window.partitionBy(host).orderBy(arrival, tie)
    placed = requests.withColumn("_i", F.row_number().over(order)).withColumn("_d", d)
    base = F.max(F.col(arrival) - F.col("_i") * F.col("_d")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("granted", base + F.col("_i") * F.col("_d")).withColumn("waited", F.col("granted") - F.col(arrival)).drop("_i", "_d")


def ttl_setting(raw: Column, default: int = TTL_MS) -> Column:
    """Milliseconds that a setting's text asks for; the default where it is no number above zero."""
    asked = raw.try_cast("double")
    return F.when((asked > 0) & (asked < float("inf")), asked).otherwise(F.lit(float(default)))


def is_fresh(fetched_at: Column, now: Column, ttl: int = TTL_MS) -> Column:
    return F.coalesce(now - fetched_at < ttl, F.lit(False))


def cache_replay(requests: DataFrame, url: str, at: str, tie: str, ttl: int = TTL_MS, not_modified: str | None = None) -> DataFrame:
    """url, pos, at, tie, status of every request: fresh while less than ttl has passed since the last fetch,
    else it is fetched again: a miss. not_modified: a column that says that the server answers 304: what is
    cached is then revalidated; where nothing is, that is an error and nothing is kept.

    It is a recurrence over fetches that no window states, so a url's requests go through one task in order;
    the task holds the last fetch only, however many they are."""
    said = F.coalesce(F.col(not_modified), F.lit(False)) if not_modified else F.lit(False)
    rows = requests.select(url, F.col(at).cast("long").alias("at"), F.col(tie).alias("tie"), said.alias("_304"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, last, pos = False, None, None, 0
        for batch in batches:
            places, states = [], []
            for u, t, modified in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if not begun or u != key:
                    begun, key, last, pos = True, u, None, 0
                fresh = t is not None and last is not None and t - last < ttl
                state = "fresh" if fresh else "miss" if not modified else "error" if last is None else "revalidated"
                if state in ("miss", "revalidated"):
                    last = t
                places.append(pos)
                states.append(state)
                pos += 1
            cols = [batch.column(0), pa.array(places, pa.int32()), batch.column(1), batch.column(2), pa.array(states, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [url, "pos", "at", "tie", "status"])

    dealt = rows.repartition(url).sortWithinPartitions(url, "at", "tie")
    return dealt.mapInArrow(replay, f"`{url}` {kinds[url]}, pos int, at bigint, tie {kinds['tie']}, status string")


def route(responses: DataFrame, body_cap: int = BODY_CAP, preview_cap: int = PREVIEW_CAP) -> DataFrame:
    """responses (status, content_type, body) with kind (not_modified, html, handoff or error), error_code,
    preview (first bytes of what is handed off) and cut (it has more)."""
    size = F.octet_length("body")
    html = is_html_type(F.col("content_type"))
    kind = (
        F.when(F.col("status") == 304, "not_modified")
        .when(~F.col("status").between(200, 299), "error")
        .when(html & (size > body_cap), "error")
        .when(html, "html")
        .otherwise("handoff")
    )
    code = F.when(kind == "error", F.when(F.col("status").between(200, 299), "PAYLOAD_TOO_LARGE").otherwise("HTTP_STATUS_ERROR"))
    handed = kind == "handoff"
    return responses.withColumns(
        {"kind": kind, "error_code": code, "preview": F.when(handed, F.substring("body", 1, preview_cap)), "cut": handed & (size > preview_cap)}
    )


def failure(url: Column, allowed: Column, address_reserved: Column, elapsed_ms: Column, timeout_ms: int, status: Column, cached: Column, code: Column) -> Column:
    """error_code of a captured fetch, or null: the first check that fails, in the order in which a fetch meets
    them. allowed: by robots; address_reserved: of the resolved address; code: what routing found."""
    return (
        F.when(~is_http(url), "INVALID_URL")
        .when(~F.coalesce(allowed, F.lit(True)), "ROBOTS_DENIED")
        .when(F.coalesce(address_reserved, F.lit(False)), "PRIVATE_ADDRESS_DENIED")
        .when(F.coalesce(elapsed_ms >= timeout_ms, F.lit(False)), "FETCH_TIMEOUT")
        .when(status.isNull(), "NETWORK_ERROR")
        .when((status == 304) & ~F.coalesce(cached, F.lit(False)), "UNEXPECTED_NOT_MODIFIED")
        .otherwise(code)
    )


def resolve_redirects(starts: DataFrame, hops: DataFrame, limit: int = MAX_REDIRECTS) -> DataFrame:
    """starts: url; hops: url, status, location (absolute or null) of each captured response -> url,
    final_url, n_hops, status, error_code. Status 310 after limit hops; a redirect without location fails. Where
    hops has allowed (by robots, of its own url), a hop to another origin that is not allowed is ROBOTS_DENIED."""
    hops = hops if "allowed" in hops.columns else hops.withColumn("allowed", F.lit(True))
    redirect = F.col("h.status").isin(301, 302, 303, 307, 308)
    now = starts.select("url", F.col("url").alias("final_url"), F.lit(0).alias("n_hops"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("error_code"), F.lit(False).alias("done"))
    for _ in range(limit + 1):
        met = now.alias("s").join(hops.alias("h"), (F.col("s.final_url") == F.col("h.url")) & ~F.col("s.done"), "left")
        seen = F.col("h.url").isNotNull()
        denied = seen & (F.col("s.n_hops") > 0) & ~F.coalesce("h.allowed", F.lit(True)) & ~origin(F.col("s.final_url")).eqNullSafe(origin(F.col("s.url")))
        on = seen & ~denied & redirect & F.col("h.location").isNotNull()
        over = on & (F.col("s.n_hops") >= limit)
        go = on & ~over
        now = met.select(
            F.col("s.url").alias("url"),
            F.when(go, F.col("h.location")).otherwise(F.col("s.final_url")).alias("final_url"),
            F.when(go, F.col("s.n_hops") + 1).otherwise(F.col("s.n_hops")).alias("n_hops"),
            F.when(F.col("s.done"), F.col("s.status")).when(denied, F.lit(None).cast("int")).when(over, 310).when(go, F.lit(None).cast("int")).otherwise(F.col("h.status")).alias("status"),
            F.when(F.col("s.done"), F.col("s.error_code")).when(denied, "ROBOTS_DENIED").when(over | (seen & redirect & F.col("h.location").isNull()), "HTTP_STATUS_ERROR").when(~seen, "NETWORK_ERROR").alias("error_code"),
            (F.col("s.done") | ~go).alias("done"),
        )
    return now.drop("done")


def robots_allowed(requests: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """requests with allowed. rules: origin, allow, pattern (of the agent's group). The longest pattern that
    matches path and query decides, allow wins a tie; no rule allows."""
    target = F.concat(pathname(F.col(url)), F.regexp_extract(F.col(url), r"(\?[^#]*)", 1))
    literal = F.regexp_replace(F.regexp_replace("pattern", r"\$\z", ""), r"([\\.+?^${}()|\[\]])", r"\\$1")
    regex = F.concat(F.lit(r"\A"), F.regexp_replace(literal, r"\*", ".*"), F.when(F.col("pattern").endswith("$"), r"\z").otherwise(""))
    asked = requests.select(url).distinct().withColumn("_origin", origin(F.col(url))).withColumn("_target", target)
    used = rules.filter(F.col("pattern") != "").withColumn("_regex", regex)
    hit = asked.join(used, asked["_origin"] == used["origin"]).filter(F.expr("_target rlike _regex"))
    best = hit.groupBy(url).agg(F.max(F.struct(F.length("pattern").alias("n"), F.col("allow").cast("int").alias("ok"))).alias("_b")).select(F.col(url).alias("_u"), (F.col("_b.ok") == 1).alias("_ok"))
    return requests.join(best, requests[url] == best["_u"], "left").withColumn("allowed", F.coalesce("_ok", F.lit(True))).drop("_u", "_ok")


def spa_reason(root_id: Column, root_chars: Column, noscript: Column, html_chars: Column, text_chars: Column) -> Column:
    """Why a page is to be rendered in a browser, or null: the first rule that holds."""
    return (
        F.when(root_id.isin(SPA_ROOTS) & (root_chars < SPA_ROOT_CHARS), "empty-root")
        .when(noscript.rlike("(?i)javascript|有効に|enable"), "noscript")
        .when((html_chars > SPA_HTML) & (text_chars / F.greatest(html_chars, F.lit(1)) < SPA_SHARE), "low-text-share")
        .when((html_chars > SPA_HTML) & (text_chars < SPA_CHARS), "little-text")
    )
