"""Queries that render responses as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryloom.functions import markdown as M
from quarryloom.functions.preview import BUDGET_NOTE, handoff_preview
from quarryloom.functions.text import estimate_tokens
from quarryloom.operators import diff as D
from quarryloom.operators import links as L
from quarryloom.operators import render as R
from quarryloom.plans.base import CJ, SP, SQL_BLOCKS, SQL_CONV, conv_md, doc_blocks, query, sql_tokens, table
from quarryloom.plans.policy import _LINKS, page_links
from quarryloom.plans.structure import _DIFF, _EXCERPT, _S


def _page(key: str):
    """A page's header fields, made of a key."""
    k = F.col(key)
    return F.struct(
        F.when(k % 3 > 0, F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.concat(F.lit("https://e/"), k.cast("string")).alias("url"), F.lit("miss").alias("cache"), F.lit("http").alias("tier"),
        (k % 4).alias("pruned"), F.when(k % 5 == 0, "zenn").alias("adapter"), F.when(k % 2 == 0, "geometry").otherwise("readability").alias("extraction"),
        F.when(k % 6 == 0, F.array(F.lit("- a — b"))).otherwise(F.array().cast("array<string>")).alias("hints"),
    )


def _sql_head(k: str) -> str:
    return f"""'title: ' || CASE WHEN {k} % 3 > 0 THEN 'T' || {k} ELSE '(なし)' END || chr(10) || 'url: https://e/' || {k} || chr(10)"""


def _sql_tail(k: str) -> str:
    return f"""CASE WHEN {k} % 5 = 0 THEN chr(10) || 'adapter: zenn' ELSE '' END || CASE WHEN {k} % 2 = 0 THEN chr(10) || 'extraction: geometry' ELSE '' END || CASE WHEN {k} % 7 > 0 THEN chr(10) || 'template_blocks_removed: ' || ({k} % 7) ELSE '' END"""


def _sql_hints(k: str) -> str:
    return f"CASE WHEN {k} % 6 = 0 THEN chr(10) || chr(10) || 'data_sources:' || chr(10) || '- a — b' ELSE '' END"


@query(
    "response_markdown",
    f"""WITH {SQL_BLOCKS}, c AS (SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS content FROM doc_rows GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(content, '') AS content FROM documents LEFT JOIN c USING (doc_id))
    SELECT doc_id, {_sql_head('doc_id')} || 'mode_used: markdown' || chr(10) || 'cache: miss' || chr(10) || 'tokens: ' || {sql_tokens('content')} || chr(10) || 'page: 1 of 1' || chr(10) || 'fetch_tier: http' || chr(10)
      || 'pruned_blocks: ' || (doc_id % 4) || {_sql_tail('doc_id')} || chr(10) || chr(10) || content || {_sql_hints('doc_id')} AS response FROM d""",
)
def response_markdown(spark, sf):
    rows = doc_blocks(spark, sf).withColumn("paged", M.paginate(M.measured(M.blocks(F.col("md"))), 10**9, F.lit(1)))
    return rows.select("doc_id", R.markdown_response(_page("doc_id"), F.col("paged"), F.col("doc_id") % 7).alias("response"))


@query(
    "response_outline",
    f"""WITH {SQL_CONV}, {_S}, x AS (SELECT *, regexp_replace(array_to_string(list_filter(string_split(content, chr(10)), lambda l: NOT regexp_matches(l, '^#{{1,6}}\\s+.*$')), chr(10)), '^{SP}+|{SP}+$', '', 'g') AS b FROM s),
    o AS (SELECT conv_id, string_agg(repeat('  ', level - 1) || '- [' || id || '] ' || repeat('#', level) || ' ' || heading || ' — ' || {_EXCERPT} || ' (~' || {sql_tokens('content')} || ' tok)', chr(10) ORDER BY ord) AS lines FROM x GROUP BY conv_id)
    SELECT m.conv_id, {_sql_head('m.conv_id')} || 'mode_used: outline' || chr(10) || 'cache: miss' || chr(10) || 'total_tokens: ' || {sql_tokens('md')} || chr(10) || 'fetch_tier: http' || {_sql_tail('m.conv_id')} || chr(10) || chr(10)
      || coalesce(lines, '(見出しが見つかりませんでした。mode: markdown で全文を取得してください)') AS response FROM conv_md m LEFT JOIN o USING (conv_id)""",
)
def response_outline(spark, sf):
    docs = conv_md(spark, sf)
    lines = M.outline(docs, "md", "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "level", "heading", "excerpt", "tokens"))).alias("s"))
    none = F.array().cast("array<struct<ord:int,id:string,level:int,heading:string,excerpt:string,tokens:bigint>>")
    text = R.outline_response(_page("conv_id"), F.coalesce("s", none), estimate_tokens(F.col("md")), F.col("conv_id") % 7)
    return docs.join(lines, "conv_id", "left").select("conv_id", text.alias("response"))


@query(
    "response_diff",
    _DIFF
    + f""", rk AS (SELECT conv_id, pos, type, CASE type WHEN 'added' THEN '追加' WHEN 'changed' THEN '変更' ELSE '削除' END AS label, level, heading, content FROM d WHERE type <> 'unchanged'),
    rb AS (SELECT conv_id, pos, type, CASE WHEN type = 'removed' THEN repeat('#', level) || ' ' || heading || ' [' || label || ']'
      ELSE string_split(content, chr(10))[1] || ' [' || label || ']' || substr(content, length(string_split(content, chr(10))[1]) + 1) END AS t FROM rk),
    ra AS (SELECT conv_id, count(*) AS n, count(*) FILTER (type = 'added') AS p, count(*) FILTER (type = 'changed') AS c, count(*) FILTER (type = 'removed') AS r, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS body FROM rb GROUP BY conv_id)
    SELECT conv_id, {_sql_head('conv_id')} || 'mode_used: markdown' || chr(10) || 'cache: diff' || chr(10) || 'changed_sections: ' || n || '(追加' || p || '/変更' || c || '/削除' || r || ')' || chr(10) || 'fetch_tier: http' || {_sql_tail('conv_id')}
      || chr(10) || chr(10) || body || {_sql_hints('conv_id')} AS response FROM ra""",
)
def response_diff(spark, sf):
    d = D.section_diff(conv_md(spark, sf), "prev", "md", "conv_id").filter("type <> 'unchanged'")
    rows = d.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "level", "heading", "content"))).alias("c"))
    return rows.select("conv_id", R.diff_response(_page("conv_id"), F.col("c"), F.col("conv_id") % 7).alias("response"))


@query("response_unchanged", "SELECT page_id, 'url: https://e/' || page_id || chr(10) || 'mode_used: markdown' || chr(10) || 'cache: unchanged' AS response FROM pages")
def response_unchanged(spark, sf):
    return table(spark, sf, "pages").select("page_id", R.unchanged_response(_page("page_id")).alias("response"))


@query(
    "response_links",
    f"""WITH {_LINKS}, m AS (SELECT *, regexp_matches(lower(url), 'the') OR regexp_matches(lower(title), 'the') AS ok FROM one), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, ok ORDER BY pos) AS n FROM m),
    g AS (SELECT page_id, count(*) FILTER (ok AND n <= 2) AS c, count(*) FILTER (ok) > 2 AS cut, count(*) AS b, string_agg('- ' || CASE WHEN title <> '' THEN title || ' — ' ELSE '' END || url, chr(10) ORDER BY pos) FILTER (ok AND n <= 2) AS lines FROM k GROUP BY page_id)
    SELECT page_id, 'url: p' || page_id || chr(10) || 'source: page' || chr(10) || 'count: ' || c || CASE WHEN cut THEN ' (truncated)' ELSE '' END || chr(10) || chr(10)
      || coalesce(lines, '(リンクが見つかりませんでした。フィルタ前 ' || b || ' 件。filterに一致しませんでした)') AS response FROM g""",
)
def response_links(spark, sf):
    done = L.finish(page_links(spark, sf), "page_id", "the", 2)
    url = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    return done.select("page_id", R.links_response(url, F.lit("page"), F.col("links"), F.col("truncated"), F.col("before_filter")).alias("response"))


@query(
    "response_handoff",
    f"""WITH d AS (SELECT doc_id, text, {sql_tokens('text')} > 400 AS over, ['text/plain', 'application/zip', NULL][doc_id % 3 + 1] AS ct, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4) * 100 END AS declared FROM documents),
    c AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, text FROM d WHERE over AND ct = 'text/plain' AND coalesce(declared <= 200, true)), h AS (SELECT doc_id, i, substr(text, CAST(i AS INT), 1) AS ch FROM c),
    r AS (SELECT doc_id, i, sum(CASE WHEN regexp_matches(ch, '{CJ}') THEN 1 ELSE 0 END) OVER w AS cjk, sum(CASE WHEN regexp_matches(ch, '{CJ}') OR regexp_matches(ch, '{SP}') THEN 0 ELSE 1 END) OVER w AS other FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    m AS (SELECT doc_id, CAST(max(i) AS INT) AS most FROM r WHERE ceil(cjk * 0.9::DOUBLE + other / 3.8::DOUBLE) <= 400 GROUP BY doc_id)
    SELECT doc_id, 'content_type: ' || coalesce(ct, '(不明)') || chr(10) || 'size: ' || coalesce(declared || '', strlen(text) || '(取得分。Content-Lengthヘッダ無し)') || chr(10) || 'url: https://e/f''' || doc_id || '.txt' || chr(10) || 'mode_used: handoff'
      || CASE WHEN ct = 'text/plain' AND coalesce(declared <= 200, true) THEN chr(10) || chr(10) || CASE WHEN over THEN left(text, most) || chr(10) || chr(10) || '({BUDGET_NOTE})' ELSE text END ELSE '' END
      || chr(10) || chr(10) || 'hint: このファイルは本文抽出対象外です。全体の取得は curl -L -o f_' || doc_id || '.txt ''https://e/f''\\''''' || doc_id || '.txt'' を推奨します' AS response FROM d LEFT JOIN m USING (doc_id)""",
)
def response_handoff(spark, sf):
    """Of all documents: longer ones are cut to the budget, with its note."""
    return _handoffs(table(spark, sf, "documents"))


def _handoffs(docs):
    k = F.col("doc_id")
    ct = F.element_at(F.array(F.lit("text/plain"), F.lit("application/zip"), F.lit(None).cast("string")), (k % 3 + 1).cast("int"))
    declared = F.when(k % 4 > 0, k % 4 * 100)
    url = F.concat(F.lit("https://e/f'"), k.cast("string"), F.lit(".txt"))
    return docs.select("doc_id", R.handoff_response(url, ct, declared, F.octet_length("text"), handoff_preview(F.col("text"), ct, 400, F.lit(False)), 200).alias("response"))


@query(
    "response_pdf",
    f"""WITH {SQL_CONV} SELECT conv_id, 'title: (なし)' || chr(10) || 'url: u' || conv_id || chr(10) || 'mode_used: markdown' || chr(10) || 'cache: fresh' || chr(10) || 'tokens: ' || {sql_tokens('md')} || chr(10) || 'page: 1 of 1' || chr(10)
      || 'fetch_tier: pdf' || chr(10) || 'pdf_pages: 3' || chr(10) || chr(10) || md AS response FROM conv_md""",
)
def response_pdf(spark, sf):
    paged = M.paginate(M.measured(M.blocks(F.col("md"))), 10**9, F.lit(1))
    url = F.concat(F.lit("u"), F.col("conv_id").cast("string"))
    return conv_md(spark, sf).select("conv_id", R.pdf_response(F.lit(None).cast("string"), url, F.lit("fresh"), F.lit(3), paged).alias("response"))


