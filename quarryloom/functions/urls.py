"""URL parts and predicates as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: file endings and words of links to structured data
STRUCTURED = [".csv", ".tsv", ".zip", ".json", ".xlsx", ".xls"]
ANYWHERE_WORDS = ["一括ダウンロード", "sitemap.xml", "rss"]
OWN_HOST_WORDS = ["オープンデータ"]
TEXT_TYPES = r"(?i)\A(?:text/(?:plain|csv|tab-separated-values|xml)|application/(?:json|xml))\z"


def is_http(url: Column) -> Column:
    return url.rlike(r"(?i)\Ahttps?://")


def authority(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"\A[^@]*@", "")


def host_with_port(url: Column) -> Column:
    """Lower case, default ports left out: what requests are limited by."""
    full = F.lower(authority(url))
    scheme = F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(scheme == "http", F.regexp_replace(full, r":80\z", "")).when(scheme == "https", F.regexp_replace(full, r":443\z", "")).otherwise(full)


def hostname(url: Column) -> Column:
    """Lower case, without port: what templates are learned by."""
    return F.regexp_replace(F.lower(authority(url)), r":[0-9]*\z", "")


def origin(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), host_with_port(url))


def pathname(url: Column) -> Column:
    found = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def mime(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split(content_type, ";")[0])), F.lit(""))


def is_html_type(content_type: Column) -> Column:
    return content_type.isNull() | content_type.rlike(r"(?i)text/html|application/xhtml\+xml")


def is_text_type(content_type: Column) -> Column:
    m = mime(content_type)
    return m.rlike(TEXT_TYPES) | m.rlike(r"\+(?:json|xml)\z")


def looks_like_pdf(url: Column, content_type: Column) -> Column:
    typed = F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False))
    return typed | F.lower(pathname(url)).endswith(".pdf")


def matches_filter(text: Column, wanted: str | None) -> Column:
    """An unanchored glob if wanted has a *, else a substring; case does not count; None matches all."""
    if not wanted:
        return F.lit(True)
    if "*" in wanted:
        return text.rlike("(?i)" + ".*".join(re.escape(p) for p in wanted.split("*")))
    return F.contains(F.lower(text), F.lit(wanted.lower()))


def structured_ending(url: Column) -> Column:
    """The ending of STRUCTURED that the path has, or null."""
    path = F.lower(pathname(url))
    return F.coalesce(*[F.when(path.endswith(e), F.lit(e)) for e in STRUCTURED])


def says_structured(title: Column, url: Column, base: Column) -> Column:
    """Words that point to structured data: API as a word, others anywhere, some on the page's own host only."""
    said = F.concat_ws(" ", F.coalesce(title, F.lit("")), url)
    lower = F.lower(said)
    words = lambda ws: [F.contains(lower, F.lit(w.lower())) for w in ws]
    anywhere = F.lit(False)
    for w in words(ANYWHERE_WORDS):
        anywhere = anywhere | w
    own = F.lit(False)
    for w in words(OWN_HOST_WORDS):
        own = own | w
    return said.rlike(r"(?i)\bapi\b") | anywhere | (own & (hostname(url) == hostname(base)))


def guess_filename(url: Column) -> Column:
    last = F.try_element_at(F.filter(F.split(pathname(url), "/"), lambda p: p != ""), F.lit(-1))
    safe = F.regexp_replace(F.coalesce(last, F.lit("")), r"[^A-Za-z0-9._-]", "_")
    return F.when(safe == "", "download").otherwise(safe)
