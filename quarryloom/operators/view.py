"""What a fetch of captured pages answers: fetch_view in markdown, outline or auto mode, fetch with a cache."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.functions import markdown as M
from quarryloom.functions.quality import evaluate_quality
from quarryloom.functions.text import estimate_tokens
from quarryloom.functions.urls import hostname, is_http
from quarryloom.operators import diff as D
from quarryloom.operators import render as R
from quarryloom.operators import template as P
from quarryloom.operators.extract import extract_with_links
from quarryloom.operators.links import data_sources
from quarryloom.operators.policy import TTL_MS, is_fresh

MODES = ("auto", "markdown", "outline")
MAX_TOKENS = 8000


def assessed(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """pages (url, html, fetched_at) with what extraction gave, links, token estimate and quality; one parse a page."""
    got = extract_with_links(pages, selector=selector).withColumn("tokens", estimate_tokens(F.coalesce("markdown", F.lit(""))))
    c = F.col
    none = F.lit(None).cast("double")
    chars = F.length(F.regexp_replace(F.coalesce("markdown", F.lit("")), r"\s+", "")).cast("double")
    q = evaluate_quality(chars, c("visible_chars"), c("table_cells"), c("canvases"), c("svgs"), c("leaves"), c("images"), c("images_without_alt"), c("image_area"), c("tokens"), none, none)
    return got.withColumn("quality", q)


def _with_hints(rows: DataFrame, got: DataFrame, key: str = "url") -> DataFrame:
    """rows with hints, from the links of the pages of the same key."""
    links = got.select(F.col(key).alias("page_key"), F.col("url").alias("base"), F.explode("links").alias("l")).select("page_key", "base", "l.url", "l.title", "l.pos")
    return rows.join(data_sources(links, "page_key", "base").withColumnRenamed("page_key", key), key, "left")


def _info(cache: Column) -> Column:
    return F.struct(
        F.col("title").alias("title"), F.col("url").alias("url"), cache.alias("cache"), F.lit("http").alias("tier"), F.col("pruned").alias("pruned"),
        F.col("adapter").alias("adapter"), F.col("method").alias("extraction"), F.coalesce("hints", F.array().cast("array<string>")).alias("hints"),
    )


def fetch(
    requests: DataFrame, cache: DataFrame, now: int, page: int = 1, max_tokens: int = MAX_TOKENS, force_full: bool = False, selector: str | None = None, ttl: int = TTL_MS, templates: DataFrame | None = None
) -> DataFrame:
    """url, cache (fresh, revalidated or miss), answer (full, diff or unchanged), error_code, response and
    markdown (what the cache is to hold) of every request.

    requests: url, status, html as captured; cache: url, fetched_at, markdown; templates: domain, hash. What is
    cached answers while it is fresh, and after a 304; a 304 without it is an error. Else the page is extracted,
    and if it was cached before, the answer is what changed in its sections. A selector takes and leaves no cache."""
    got = assessed(requests, selector).drop("html").persist(StorageLevel.DISK_ONLY)
    held = cache.select("url", F.col("fetched_at").alias("_at"), F.col("markdown").alias("_held"))
    rows = got.join(held.limit(0) if selector else held, "url", "left")
    known, not_modified = F.col("_held").isNotNull(), F.col("status") == 304
    state = F.when(known & is_fresh(F.col("_at"), F.lit(now), ttl), "fresh").when(known & not_modified, "revalidated").otherwise("miss")
    told = rows.withColumn("state", state).withColumn("domain", hostname(F.col("url")))
    bad = (
        F.when(~is_http(F.col("url")), "INVALID_URL")
        .when((F.col("state") == "miss") & not_modified, "UNEXPECTED_NOT_MODIFIED")
        .when((F.col("state") == "miss") & ~F.col("status").between(200, 299), "HTTP_STATUS_ERROR")
        .when(F.col("state") == "miss", F.col("error_code"))
    )
    now_md = F.when(F.col("state") == "miss", F.col("markdown")).otherwise(F.col("_held"))
    view = told.withColumns({"code": bad, "current": now_md, "previous": F.when(F.col("state") == "miss", F.col("_held"))})
    known_blocks = templates if templates is not None and not force_full else templates.limit(0) if templates is not None else None
    if known_blocks is None:
        view = view.withColumns({"shown": F.col("current"), "removed": F.lit(0).cast("long"), "before": F.col("previous")})
    else:
        before = P.remove_template(view.select("url", "domain", "previous"), known_blocks, "previous").select("url", F.col("shown").alias("before"))
        view = P.remove_template(view, known_blocks, "current").join(before, "url", "left")
    eligible = F.lit(not force_full) & F.col("code").isNull() & (F.col("state") == "miss") & F.col("before").isNotNull()
    changed = D.section_diff(view.filter(eligible & (F.col("before") != F.col("shown"))).select("url", "before", "shown"), "before", "shown", "url")
    sections = changed.groupBy("url").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") != "unchanged", F.struct("pos", "type", "level", "heading", "content")))).alias("changes"),
        (F.count(F.when(F.col("type") == "unchanged", 1)) == 0).alias("all_changed"),
    )
    full = _with_hints(view.join(sections, "url", "left"), got).withColumn("page", _info(F.col("state")))
    answer = D.answer_kind(eligible, F.col("before"), F.col("shown"), F.size("changes"), F.col("all_changed"))
    paged = full.withColumn("answer", answer).withColumn("paged", M.paginate(M.measured(M.blocks(F.col("shown"))), max_tokens, F.lit(page)))
    text = (
        F.when(F.col("answer") == "unchanged", R.unchanged_response(F.col("page")))
        .when(F.col("answer") == "diff", R.diff_response(F.col("page"), F.col("changes"), F.col("removed")))
        .otherwise(R.markdown_response(F.col("page"), F.col("paged"), F.col("removed")))
    )
    fine = F.col("code").isNull()
    return paged.select(
        "url", F.when(fine, F.col("state")).alias("cache"), F.when(fine, F.col("answer")).alias("answer"), F.col("code").alias("error_code"), F.when(fine, text).alias("response"),
        F.when(fine & F.lit(not selector), F.col("current")).alias("markdown"),
    )


def fetch_view(
    pages: DataFrame, mode: str = "auto", section: str | None = None, page: int = 1, max_tokens: int = MAX_TOKENS, force_full: bool = False, selector: str | None = None
) -> DataFrame:
    """url, mode_used, error_code, response of every page: template blocks removed, then a section, an
    outline or a page of the Markdown. In auto mode a page of low quality is marked for a screenshot.

    What extraction gave is kept on the executors' disks until spark.catalog.clearCache()."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    # a domain's templates are known only when all its pages are extracted, so extraction is kept, without the html
    # a url may be captured more than once: pages are told apart by a number
    got = assessed(pages, selector).drop("html").withColumns({"domain": hostname(F.col("url")), "_no": F.monotonically_increasing_id()}).persist(StorageLevel.DISK_ONLY)
    if force_full or selector:
        shown = got.withColumns({"shown": F.col("markdown"), "removed": F.lit(0).cast("long")})
    else:
        hashed = got.filter(F.col("markdown").isNotNull()).select("domain", "url", "fetched_at", P.block_hashes(M.blocks(F.col("markdown"))).alias("block_hashes"))
        shown = P.remove_template(got, P.template_hashes(hashed))
    base = _with_hints(shown, got, "_no").withColumn("page", _info(F.lit("miss")))
    bad = F.when(~is_http(F.col("url")), "INVALID_URL").otherwise(F.col("error_code"))
    if section:
        one = M.sections(shown.filter(F.col("shown").isNotNull()), "shown", "_no").filter(F.col("id") == section).select("_no", "content", M.breadcrumb(F.col("ancestors")).alias("path"))
        rows = base.join(one, "_no", "left").withColumn("paged", M.paginate(M.measured(M.blocks(F.col("content"))), max_tokens, F.lit(page)))
        text = R.markdown_response(F.col("page"), F.col("paged"), F.col("removed"), F.lit(section), F.col("path"))
        code = F.coalesce(bad, F.when(F.col("content").isNull(), "SECTION_NOT_FOUND"))
        return rows.select("url", F.lit("markdown").alias("mode_used"), code.alias("error_code"), F.when(code.isNull(), text).alias("response"))
    if mode == "outline":
        lines = M.outline(shown.filter(F.col("shown").isNotNull()), "shown", "_no").groupBy("_no").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "level", "heading", "excerpt", "tokens"))).alias("sections"))
        rows = base.join(lines, "_no", "left")
        sections = F.coalesce("sections", F.array().cast("array<struct<ord:int,id:string,level:int,heading:string,excerpt:string,tokens:bigint>>"))
        text = R.outline_response(F.col("page"), sections, estimate_tokens(F.col("shown")), F.col("removed"))
        return rows.select("url", F.lit("outline").alias("mode_used"), bad.alias("error_code"), F.when(bad.isNull(), text).alias("response"))
    rows = base.withColumn("paged", M.paginate(M.measured(M.blocks(F.col("shown"))), max_tokens, F.lit(page)))
    text = R.markdown_response(F.col("page"), F.col("paged"), F.col("removed"))
    picture = F.col("quality.low_quality") if mode == "auto" else F.lit(False)
    used = F.when(picture, "screenshot").otherwise("markdown")
    return rows.select("url", used.alias("mode_used"), bad.alias("error_code"), F.when(bad.isNull(), F.when(picture, F.concat(F.lit("reason: "), F.col("quality.reason"))).otherwise(text)).alias("response"))
