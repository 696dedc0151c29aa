"""Structure of Markdown as array expressions: blocks, pages, headings and sections, without a shuffle.

A line that starts with three backticks, blanks before them allowed, opens a fence and the next one
closes it; an open fence runs to the end. Inside, blank lines part no blocks and `#` heads no section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.functions.text import BLANK, SPACE, bound, estimate_tokens, excerpt, strip_links, trim

_FENCED = rf"(?dms)^[{BLANK}]*```.*?(?:^[{BLANK}]*```[^\n]*|\z)"
_CUT = "\x01\x02\x01"
HEADING = rf"\A(#{{1,6}})[{SPACE}]+(.*)\z"
MAX_LEVEL, FILL, NO_HEADING = 4, 0.6, "(見出しなし)"  # fixed values


def _parts(markdown: Column) -> tuple[Column, Column]:
    """What lies around the fences, and the fences; a text without three backticks is not searched for any."""
    some, none = F.contains(markdown, F.lit("```")), ~F.contains(markdown, F.lit("```"))
    around = F.when(some, F.split(markdown, _FENCED, -1)).when(none, F.array(markdown))
    return around, F.when(some, F.regexp_extract_all(markdown, F.lit(_FENCED), F.lit(0))).when(none, F.array().cast("array<string>"))


def _woven(around: Column, fences: Column) -> Column:
    return F.array_join(F.zip_with(around, fences, lambda a, f: F.concat(F.coalesce(a, F.lit("")), F.coalesce(f, F.lit("")))), "")


def blocks(markdown: Column) -> Column:
    """array of the blocks' texts."""
    around, fences = _parts(markdown)

    def parted(parts: Column) -> Column:
        def cut(part: Column, i: Column) -> Column:
            start = F.when(i == 0, F.regexp_replace(part, rf"\A[{SPACE}]*\n", "")).otherwise(part)
            end = F.when(i == F.size(parts) - 1, F.regexp_replace(start, rf"\n[{SPACE}]*\z", "")).otherwise(start)
            return F.regexp_replace(end, rf"\n[{SPACE}]*\n", _CUT)

        return F.transform(parts, cut)

    found = F.split(_woven(bound(around, parted), fences), _CUT)
    return F.filter(F.transform(found, lambda b: F.regexp_replace(b, r"\n+\z", "")), lambda b: trim(b) != "")


def is_heading(block: Column) -> Column:
    return block.rlike(rf"\A#{{1,6}}[{SPACE}]")


def measured(block_texts: Column) -> Column:
    """array<struct<text, tokens, heading>>."""
    return F.transform(block_texts, lambda b: F.struct(b.alias("text"), estimate_tokens(b).alias("tokens"), is_heading(b).alias("heading")))


def paginate(measured_blocks: Column, max_tokens: int, page: Column) -> Column:
    """struct(content, page, total_pages, tokens, exceeded_budget) of the asked page, within 1 and the last.

    A page is closed before a block that would exceed the budget, and before a heading once FILL of it is
    used; a block is never split."""
    return bound(measured_blocks, lambda m: _paginate(m, max(1, max_tokens), page))


def _paginate(measured_blocks: Column, budget: int, page: Column) -> Column:
    zero = F.struct(F.lit(1).alias("page"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("any"))

    def step(a: Column, b: Column) -> Column:
        full = a["any"] & ((a["used"] + b["tokens"] > budget) | (b["heading"] & (a["used"] >= budget * FILL)))
        return F.struct(
            F.when(full, a["page"] + 1).otherwise(a["page"]).alias("page"),
            F.when(full, b["tokens"]).otherwise(a["used"] + b["tokens"]).alias("used"),
            F.lit(True).alias("any"),
        )

    total = F.aggregate(measured_blocks, zero, step, lambda a: a["page"])
    # the asked page goes in with the start, where it is computed once
    start = F.struct(zero.alias("at"), F.lit(None).cast("string").alias("text"), total.alias("total"), F.greatest(F.lit(1), F.least(page, total)).alias("shown"))

    def collect(a: Column, b: Column) -> Column:
        at = step(a["at"], b)
        text = F.when(at["page"] != a["shown"], a["text"]).when(a["text"].isNull(), b["text"]).otherwise(F.concat(a["text"], F.lit("\n\n"), b["text"]))
        return F.struct(at.alias("at"), text.alias("text"), a["total"].alias("total"), a["shown"].alias("shown"))

    def told(a: Column) -> Column:
        content = F.coalesce(a["text"], F.lit(""))
        return bound(
            estimate_tokens(content),
            lambda tokens: F.struct(content.alias("content"), a["shown"].alias("page"), a["total"].alias("total_pages"), tokens.alias("tokens"), (tokens > budget).alias("exceeded_budget")),
        )

    return F.aggregate(measured_blocks, start, collect, told)


def headings(markdown: Column) -> Column:
    """array<struct<line (from 0), level, text>> of the headings outside fences."""
    around, fences = _parts(markdown)
    blank = F.transform(fences, lambda f: F.repeat(F.lit("\n"), F.length(f) - F.length(F.replace(f, F.lit("\n"), F.lit("")))))
    lines = F.split(_woven(around, blank), "\n")
    found = F.transform(
        lines,
        lambda x, i: F.when(x.rlike(HEADING), F.struct(i.alias("line"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), trim(F.regexp_extract(x, HEADING, 2)).alias("text"))),
    )
    return F.filter(found, lambda h: h.isNotNull())


def sections(df: DataFrame, markdown: str, *keys: str) -> DataFrame:
    """keys, ord, id, level, heading, ancestors, content, own_content: a row for each section of levels 1
    to MAX_LEVEL. Ids count all headings, so they may have gaps; text before the first heading is in none."""
    md = F.col(markdown)
    base = df.select(*keys, md.alias("_md"), F.split(md, "\n").alias("_lines"), headings(md).alias("_h"))
    one = F.array(F.struct(F.lit(0).alias("line"), F.lit(0).alias("level"), F.lit(NO_HEADING).alias("text")))
    rows = base.withColumn("_each", F.when(F.size("_h") > 0, F.col("_h")).when(trim(F.col("_md")) != "", one)).select(
        "*", F.posexplode("_each").alias("_i", "_s")
    )
    h, s, i = F.col("_h"), F.col("_s"), F.col("_i")
    whole = s["level"] == 0
    after = F.slice(h, i + 2, F.size(h))
    end_of = lambda level: F.coalesce(F.try_element_at(F.filter(after, lambda x: x["level"] <= level), F.lit(1))["line"], F.size("_lines"))
    text_to = lambda end: F.array_join(F.slice("_lines", s["line"] + 1, F.greatest(end - s["line"], F.lit(0))), "\n")
    before = F.slice(h, 1, i)

    def above(level: int) -> Column:
        last = F.try_element_at(F.filter(before, lambda x: x["level"] <= level), F.lit(-1))
        return F.when((s["level"] > level) & (last["level"] == level), F.struct(last["level"].alias("level"), last["text"].alias("heading")))

    ancestors = F.filter(F.array(*[above(k) for k in range(1, 6)]), lambda x: x.isNotNull())
    return rows.filter(whole | (s["level"] <= MAX_LEVEL)).select(
        *keys,
        i.alias("ord"),
        F.concat(F.lit("s"), (i + 1).cast("string")).alias("id"),
        F.when(whole, 1).otherwise(s["level"]).alias("level"),
        s["text"].alias("heading"),
        F.when(whole, F.array().cast("array<struct<level:int,heading:string>>")).otherwise(ancestors).alias("ancestors"),
        F.when(whole, F.col("_md")).otherwise(text_to(end_of(s["level"]))).alias("content"),
        F.when(whole, F.col("_md")).otherwise(trim(text_to(end_of(F.lit(MAX_LEVEL))))).alias("own_content"),
    )


def outline(df: DataFrame, markdown: str, *keys: str) -> DataFrame:
    """keys, ord, id, level, heading, excerpt, tokens (nested headings included) of every section."""
    return sections(df, markdown, *keys).select(
        *keys, "ord", "id", "level", "heading", excerpt(F.col("content")).alias("excerpt"), estimate_tokens(F.col("content")).alias("tokens")
    )


def breadcrumb(ancestors: Column) -> Column:
    """Headings above, links stripped, joined by ' › '; null at the top."""
    return F.when(F.size(ancestors) > 0, F.array_join(F.transform(ancestors, lambda a: trim(strip_links(a["heading"]))), " › "))
