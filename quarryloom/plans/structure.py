"""Queries on text and Markdown structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryloom.functions import markdown as M
from quarryloom.functions import text as T
from quarryloom.functions.preview import cap_tokens, tabular_preview
from quarryloom.operators import diff as D
from quarryloom.operators import template as P
from quarryloom.plans.base import CJ, SP, SQL_BLOCKS, SQL_CONV, conv_md, doc_blocks, query, sql_sections, sql_tokens, table


@query("token_estimate", f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("token_by_lang", f"SELECT lang, source, count(*) AS docs, CAST(sum({sql_tokens('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang, source")
def token_by_lang(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


@query("token_rollup", f"SELECT lang, source, CAST(grouping_id(lang, source) AS BIGINT) AS grp, CAST(sum({sql_tokens('text')}) AS BIGINT) AS tokens FROM documents GROUP BY ROLLUP (lang, source)")
def token_rollup(spark, sf):
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.grouping_id().cast("long").alias("grp"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


@query(
    "char_classes",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(t, '{CJ}')) AS BIGINT) AS cjk, CAST(len(regexp_extract_all(t, '{SP}')) AS BIGINT) AS space,
    CAST(length(t) - len(regexp_extract_all(t, '{CJ}')) - len(regexp_extract_all(t, '{SP}')) AS BIGINT) AS other
    FROM (SELECT doc_id, text || '日本語の、テスト　です' AS t FROM documents)""",
)
def char_classes(spark, sf):
    c = T.char_classes(F.concat("text", F.lit("日本語の、テスト　です")))
    docs = table(spark, sf, "documents").select("doc_id", c.alias("c"))
    return docs.select("doc_id", *[F.col(f"c.{x}").cast("long").alias(x) for x in ("cjk", "other", "space")])


_BODY = f"regexp_replace(text, '^{SP}+|{SP}+$', '', 'g')"


@query(
    "block_score",
    f"""SELECT doc_id, m AS punctuation_density, l AS letter_ratio, k AS link_density, m * 40::DOUBLE + l * 1::DOUBLE - k * 5::DOUBLE AS score FROM (
    SELECT doc_id, len(regexp_extract_all(t, '[、。!?！.,]')) / length(t)::DOUBLE AS m, len(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]')) / length(t)::DOUBLE AS l,
    least(length(f) / length(t)::DOUBLE, 1::DOUBLE) AS k FROM (SELECT doc_id, {_BODY} AS t, regexp_replace(string_split(text, chr(10))[1], '^{SP}+|{SP}+$', '', 'g') AS f FROM documents))""",
)
def block_score(spark, sf):
    s = T.block_score(F.col("text"), F.split("text", "\n")[0])
    return table(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(
    "screenshot_key",
    """SELECT page_id, sha256(url || '|w=1280|s=' || CASE WHEN page_id % 2 = 0 THEN '1' ELSE '0.5' END || '|full=' || CASE WHEN page_id % 3 = 0 THEN 'true' ELSE 'false' END) AS cache_key FROM pages""",
)
def screenshot_key(spark, sf):
    scale = F.when(F.col("page_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5))
    return table(spark, sf, "pages").select("page_id", T.screenshot_key(F.col("url"), F.lit(1280), scale, F.col("page_id") % 3 == 0).alias("cache_key"))


@query("md_blocks", f"WITH {SQL_BLOCKS} SELECT doc_id, CAST(pos AS INT) AS pos, block, {sql_tokens('block')} AS tokens, regexp_matches(block, '^#{{1,6}}\\s') AS heading FROM doc_rows")
def md_blocks(spark, sf):
    found = doc_blocks(spark, sf).select("doc_id", F.posexplode(M.measured(M.blocks(F.col("md")))).alias("pos", "b"))
    return found.select("doc_id", "pos", F.col("b.text").alias("block"), "b.tokens", "b.heading")


@query(
    "block_hashes",
    f"""WITH {SQL_BLOCKS}, h AS (SELECT doc_id, pos, sha256(regexp_replace(block, '^{SP}+|{SP}+$', '', 'g')) AS hash FROM doc_rows)
    SELECT doc_id, hash, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS INT) AS pos FROM h GROUP BY doc_id, hash""",
)
def block_hashes(spark, sf):
    return doc_blocks(spark, sf).select("doc_id", F.posexplode(P.block_hashes(M.blocks(F.col("md")))).alias("pos", "hash"))


_PAGES = f"""WITH RECURSIVE {SQL_BLOCKS},
  m AS (SELECT doc_id, pos, block, {sql_tokens('block')} AS tok, regexp_matches(block, '^#{{1,6}}\\s') AS head FROM doc_rows),
  f AS (SELECT doc_id, pos, 1 AS page, tok AS used FROM m WHERE pos = 0
    UNION ALL SELECT m.doc_id, m.pos, CASE WHEN f.used + m.tok > 120 OR (m.head AND f.used >= 72) THEN f.page + 1 ELSE f.page END,
      CASE WHEN f.used + m.tok > 120 OR (m.head AND f.used >= 72) THEN m.tok ELSE f.used + m.tok END
    FROM f JOIN m ON m.doc_id = f.doc_id AND m.pos = f.pos + 1),
  t AS (SELECT doc_id, max(page) AS total FROM f GROUP BY doc_id),
  c AS (SELECT f.doc_id, t.total, least(2, t.total) AS page, string_agg(m.block, chr(10) || chr(10) ORDER BY m.pos) AS content
    FROM f JOIN t USING (doc_id) JOIN m ON m.doc_id = f.doc_id AND m.pos = f.pos WHERE f.page = least(2, t.total) GROUP BY f.doc_id, t.total)
  SELECT d.doc_id, coalesce(content, '') AS content, CAST(coalesce(page, 1) AS INT) AS page, CAST(coalesce(total, 1) AS INT) AS total_pages,
    {sql_tokens("coalesce(content, '')")} AS tokens, {sql_tokens("coalesce(content, '')")} > 120 AS exceeded_budget FROM documents d LEFT JOIN c USING (doc_id)"""


@query("paginate", _PAGES)
def paginate(spark, sf):
    p = M.paginate(M.measured(M.blocks(F.col("md"))), 120, F.lit(2))
    return doc_blocks(spark, sf).select("doc_id", p.alias("p")).select("doc_id", "p.*")


_S = sql_sections("conv_md", "conv_id", "md", "s")


@query("sections", f"WITH {SQL_CONV}, {_S} SELECT conv_id, ord, id, level, heading, content, own AS own_content FROM s")
def sections(spark, sf):
    return M.sections(conv_md(spark, sf), "md", "conv_id").drop("ancestors")


_EXCERPT = f"""left(regexp_replace(CASE WHEN regexp_matches(b, '[。!?]') THEN regexp_extract(b, '[^。!?\\n]*[。!?]') ELSE string_split(b, chr(10))[1] END, '^{SP}+|{SP}+$', '', 'g'), 80)"""


@query(
    "outline",
    f"""WITH {SQL_CONV}, {_S}, x AS (SELECT *, regexp_replace(array_to_string(list_filter(string_split(content, chr(10)), lambda l: NOT regexp_matches(l, '^#{{1,6}}\\s+.*$')), chr(10)), '^{SP}+|{SP}+$', '', 'g') AS b FROM s)
    SELECT conv_id, ord, id, level, heading, {_EXCERPT} AS excerpt, {sql_tokens('content')} AS tokens FROM x""",
)
def outline(spark, sf):
    return M.outline(conv_md(spark, sf), "md", "conv_id")


@query("breadcrumbs", f"WITH {SQL_CONV}, {_S} SELECT conv_id, id, path FROM s")
def breadcrumbs(spark, sf):
    return M.sections(conv_md(spark, sf), "md", "conv_id").select("conv_id", "id", M.breadcrumb(F.col("ancestors")).alias("path"))


@query(
    "section_extract",
    f"WITH {SQL_CONV}, {_S} SELECT m.conv_id, s.content, CASE WHEN s.id IS NULL THEN 'SECTION_NOT_FOUND' END AS error_code FROM conv_md m LEFT JOIN s ON s.conv_id = m.conv_id AND s.id = 's3'",
)
def section_extract(spark, sf):
    docs = conv_md(spark, sf)
    one = M.sections(docs, "md", "conv_id").filter(F.col("id") == "s3").select("conv_id", "content")
    return docs.select("conv_id").join(one, "conv_id", "left").withColumn("error_code", F.when(F.col("content").isNull(), "SECTION_NOT_FOUND"))


_DIFF = f"""WITH {SQL_CONV}, {_S}, {sql_sections("conv_md", "conv_id", "prev", "o")},
  a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, level, heading ORDER BY ord) AS nth FROM o),
  b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, level, heading ORDER BY ord) AS nth FROM s),
  d AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(CAST(b.ord AS BIGINT), a.ord + 4294967296) AS pos,
    CASE WHEN a.ord IS NULL THEN 'added' WHEN b.ord IS NULL THEN 'removed' WHEN a.own <> b.own THEN 'changed' ELSE 'unchanged' END AS type,
    coalesce(a.level, b.level) AS level, coalesce(a.heading, b.heading) AS heading, coalesce(b.content, '') AS content
    FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.level = b.level AND a.heading = b.heading AND a.nth = b.nth)"""


@query("section_diff", _DIFF + " SELECT * FROM d")
def section_diff(spark, sf):
    return D.section_diff(conv_md(spark, sf), "prev", "md", "conv_id")


@query("diff_summary", _DIFF + " SELECT conv_id, count(*) FILTER (type = 'added') AS added, count(*) FILTER (type = 'changed') AS changed, count(*) FILTER (type = 'removed') AS removed, count(*) FILTER (type = 'unchanged') = 0 AS all_changed FROM d GROUP BY conv_id")
def diff_summary(spark, sf):
    return D.diff_summary(section_diff(spark, sf), "conv_id")


@query(
    "answer_kind",
    _DIFF
    + """, g AS (SELECT conv_id, count(*) FILTER (type <> 'unchanged') AS n, count(*) FILTER (type = 'unchanged') = 0 AS every FROM d GROUP BY conv_id)
    SELECT m.conv_id, CASE WHEN m.conv_id % 7 = 0 THEN 'full' WHEN m.md = CASE WHEN m.conv_id % 3 = 0 THEN m.md ELSE m.prev END THEN 'unchanged' WHEN coalesce(n, 0) > 0 AND NOT coalesce(every, false) THEN 'diff' ELSE 'full' END AS answer
    FROM conv_md m LEFT JOIN g USING (conv_id)""",
)
def answer_kind(spark, sf):
    docs = conv_md(spark, sf)
    n = D.diff_summary(D.section_diff(docs, "prev", "md", "conv_id"), "conv_id")
    old = F.when(F.col("conv_id") % 3 == 0, F.col("md")).otherwise(F.col("prev"))
    kind = D.answer_kind(F.col("conv_id") % 7 != 0, old, F.col("md"), F.col("added") + F.col("changed") + F.col("removed"), F.col("all_changed"))
    return docs.join(n, "conv_id", "left").select("conv_id", kind.alias("answer"))


def page_blocks(spark, sf):
    """domain, url, fetched_at, markdown: the texts between tags as blocks."""
    texts = F.filter(F.regexp_extract_all("html", F.lit(">([^<>]+)<"), F.lit(1)), lambda x: T.trim(x) != "")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf, "pages").select(host.alias("domain"), "url", F.col("page_id").alias("fetched_at"), F.array_join(texts, "\n\n").alias("markdown"))


_TEMPLATE = f"""WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS domain, url, page_id AS fetched_at,
    list_filter(regexp_extract_all(html, '>([^<>]+)<', 1), lambda x: regexp_replace(x, '{SP}', '', 'g') <> '') AS b FROM pages),
  r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY fetched_at DESC, url) AS place FROM p),
  e AS (SELECT DISTINCT domain, url, sha256(regexp_replace(u, '^{SP}+|{SP}+$', '', 'g')) AS hash FROM (SELECT domain, url, unnest(b) AS u FROM r WHERE place <= 3)),
  t AS (SELECT domain, hash FROM e GROUP BY domain, hash HAVING count(*) >= 3)"""


@query("template_blocks", _TEMPLATE + " SELECT domain, hash FROM t")
def template_blocks(spark, sf):
    return P.template_hashes(page_blocks(spark, sf).withColumn("block_hashes", P.block_hashes(M.blocks(F.col("markdown")))))


@query(
    "template_removed",
    _TEMPLATE
    + f""", n AS (SELECT domain, list(hash) AS known FROM t GROUP BY domain),
    k AS (SELECT p.url, list_filter(b, lambda x: NOT list_contains(coalesce(known, []), sha256(regexp_replace(x, '^{SP}+|{SP}+$', '', 'g')))) AS kept, b FROM p LEFT JOIN n USING (domain))
    SELECT url, array_to_string(kept, chr(10) || chr(10)) AS shown, CAST(len(b) - len(kept) AS BIGINT) AS removed FROM k""",
)
def template_removed(spark, sf):
    docs = page_blocks(spark, sf)
    known = P.template_hashes(docs.withColumn("block_hashes", P.block_hashes(M.blocks(F.col("markdown")))))
    return P.remove_template(docs, known).select("url", "shown", "removed")


_CSV = "SELECT user_id, 'event_id,type' || chr(10) || string_agg(event_id || ',' || event_type, chr(10) ORDER BY event_id) || chr(10) AS t FROM events GROUP BY user_id"


@query(
    "tabular_preview",
    f"""SELECT user_id, array_to_string(l[1:6], chr(10)) AS body, 'プレビュー範囲内で確認できたデータ行数: ' || (len(l) - 1) || '行中先頭' || least(len(l) - 1, 5) || '行を表示(ファイル全体の行数ではありません。取得範囲の制約による部分プレビューです)' AS note
    FROM (SELECT user_id, string_split(rtrim(t, chr(10)), chr(10)) AS l FROM ({_CSV}))""",
)
def tabular(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.col("event_id").cast("string"), F.lit(","), F.col("event_type")).alias("r"))))
    text = F.concat(F.lit("event_id,type\n"), F.array_join(F.transform(rows, lambda x: x["r"]), "\n"), F.lit("\n"))
    return table(spark, sf, "events").groupBy("user_id").agg(text.alias("t")).select("user_id", tabular_preview(F.col("t")).alias("p")).select("user_id", "p.*")


@query(
    "token_capped_preview",
    f"""WITH c AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, text FROM documents),
    w AS (SELECT doc_id, i, sum(CASE WHEN regexp_matches(substr(text, CAST(i AS INT), 1), '{SP}') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS other FROM c WHERE i <= 400)
    SELECT d.doc_id, CASE WHEN {sql_tokens('text')} <= 25 THEN text ELSE left(text, (SELECT CAST(max(i) AS INT) FROM w WHERE w.doc_id = d.doc_id AND ceil(other / 3.8::DOUBLE) <= 25)) END AS body FROM documents d""",
)
def token_capped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cap_tokens(F.col("text"), 25).alias("body"))


@query("markdown_stats", "SELECT doc_id, CAST(len(regexp_extract_all(m, '(?m)^\\|.*\\|$')) AS BIGINT) AS table_rows, CAST(len(regexp_extract_all(m, '(?m)^```')) // 2 AS BIGINT) AS code_blocks FROM (SELECT doc_id, '| a | b |' || chr(10) || '```' || chr(10) || replace(text, ' ', chr(10) || '```') AS m FROM documents)")
def markdown_stats(spark, sf):
    m = F.concat(F.lit("| a | b |\n```\n"), F.replace("text", F.lit(" "), F.lit("\n```")))
    return table(spark, sf, "documents").select("doc_id", T.table_rows(m).cast("long").alias("table_rows"), T.code_blocks(m).cast("long").alias("code_blocks"))
