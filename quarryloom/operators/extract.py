"""Trees over DataFrames: each page is parsed once, in Arrow batches, and gives one struct."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.dom import content as C
from quarryloom.operators.policy import spa_reason

_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()
STATS = ["visible_chars", "leaves", "table_cells", "canvases", "svgs", "images", "images_without_alt", "image_area"]
SPA = ["root_id", "root_chars", "noscript", "html_chars", "text_chars"]
EXTRACTED = T.StructType([
    T.StructField("title", _S), T.StructField("markdown", _S), T.StructField("method", _S), T.StructField("adapter", _S), T.StructField("pruned", _L), T.StructField("error_code", _S),
    *(T.StructField(s, _D) for s in STATS),
])


LINKS = T.ArrayType(T.StructType([T.StructField("url", _S), T.StructField("title", _S), T.StructField("pos", _L)]))


#: Rows, and bytes of columns, that are Python objects at a time; one row at least.
SLICE_ROWS, SLICE_BYTES = 64, 1 << 20


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE_ROWS, fewer where rows are long. Spark's batches hold up to 10,000 rows or 64 MB
    which as objects, with all that is made of them, take a worker many times that."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _mapped(df: DataFrame, fields: list[T.StructField], columns: list[str], make) -> DataFrame:
    """df with new fields; make turns the values of columns into a row of them."""
    keep = list(df.columns)
    schema = T.StructType([*df.schema.fields, *fields])
    types = [f.dataType for f in fields]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(t) for t in types]
        for batch in sliced(batches):
            inputs = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            rows = [make(*values) for values in zip(*inputs)]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*keep, *(f.name for f in fields)])

    return df.mapInArrow(of, schema)


def extract_markdown(pages: DataFrame, html: str = "html", url: str = "url", selector: str | None = None) -> DataFrame:
    """pages with the fields of EXTRACTED."""

    def one(h, u):
        e = C.extract(h, u, selector)
        return (e.title, e.markdown, e.method, e.adapter, e.pruned, e.error_code, *(float(e.stats[s]) for s in STATS))

    return _mapped(pages, list(EXTRACTED.fields), [html, url], one)


def extract_with_links(pages: DataFrame, html: str = "html", url: str = "url", selector: str | None = None) -> DataFrame:
    """extract_markdown with one field more, links: array of url, title, pos. A page is parsed once for both."""

    def one(h, u):
        e = C.extract(h, u, selector, links=True)
        return (e.title, e.markdown, e.method, e.adapter, e.pruned, e.error_code, *(float(e.stats[s]) for s in STATS), [dict(zip(("url", "title", "pos"), x)) for x in e.links])

    return _mapped(pages, [*EXTRACTED.fields, T.StructField("links", LINKS)], [html, url], one)


def extract_with_geometry(pages: DataFrame, html: str = "html", url: str = "url", ids: str = "block_ids", chars: str = "text_length") -> DataFrame:
    def one(h, u, i, n):
        e = C.extract(h, u, None, i, n or 0)
        return (e.title, e.markdown, e.method, e.adapter, e.pruned, e.error_code, *(float(e.stats[s]) for s in STATS))

    return _mapped(pages, list(EXTRACTED.fields), [html, url, ids, chars], one)


def page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages (without html) with url, title, pos, source of each of its links, as link_url and so on."""
    told = _mapped(pages, [T.StructField("_links", LINKS)], [html, url], lambda h, u: ([dict(zip(("url", "title", "pos"), x)) for x in C.page_links(h, u)],))
    mine = [c for c in pages.columns if c != html]
    return told.select(*mine, F.explode("_links").alias("_l")).select(*mine, F.col("_l.url").alias("link_url"), F.col("_l.title").alias("link_title"), F.col("_l.pos").alias("link_pos"))


def extract_of_two(captures: DataFrame, http: str = "http_html", browser: str = "browser_html", url: str = "url", ids: str = "block_ids", chars: str = "text_length") -> DataFrame:
    """captures with tier (http or browser), escalation (why the browser's page was taken, or null) and the fields
    of EXTRACTED. The browser's page, where one was captured, is taken if the plain one shows that it needs a
    browser; and if the plain one gives no more than its body while the browser's layout shows a main column."""
    told = spa_statistics(captures, http).withColumn("escalation", F.when(F.col(browser).isNotNull(), spa_reason(*[F.col(c) for c in SPA])))

    def one(h, b, u, i, n, reason):
        tier = "http" if reason is None else "browser"
        e = C.extract(h, u) if reason is None else C.extract(b, u, None, i, n or 0)
        if reason is None and b is not None and e.method == "body-fallback":
            again = C.extract(b, u, None, i, n or 0)
            if again.method == "geometry":
                e, tier = again, "browser"
        return (tier, e.title, e.markdown, e.method, e.adapter, e.pruned, e.error_code, *(float(e.stats[s]) for s in STATS))

    return _mapped(told.drop(*SPA), [T.StructField("tier", _S), *EXTRACTED.fields], [http, browser, url, ids, chars, "escalation"], one)


def page_sources(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """url, feed (that the page names, or null) and links (array of url, title, pos) of every page."""

    def one(h, u):
        return C.feed_link(h, u), [dict(zip(("url", "title", "pos"), x)) for x in C.page_links(h, u)]

    told = _mapped(pages.select(url, html), [T.StructField("feed", _S), T.StructField("links", LINKS)], [html, url], one)
    return told.select(F.col(url).alias("url"), "feed", "links")


def spa_statistics(pages: DataFrame, html: str = "html") -> DataFrame:
    fields = [T.StructField("root_id", _S), T.StructField("root_chars", _L), T.StructField("noscript", _S), T.StructField("html_chars", _L), T.StructField("text_chars", _L)]
    return _mapped(pages, fields, [html], C.spa_statistics)
