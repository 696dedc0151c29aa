"""Previews of responses that are not HTML."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryloom.functions.text import CJK, CJK_TOKENS, OTHER_CHARS, SPACE, bound, estimate_tokens
from quarryloom.functions.urls import is_text_type, mime

ROWS = 5
# fixed values: notes
ROWS_NOTE = "プレビュー範囲内で確認できたデータ行数: %d行中先頭%d行を表示(ファイル全体の行数ではありません。取得範囲の制約による部分プレビューです)"
BUDGET_NOTE = "プレビューはmax_tokens予算に達したため打ち切りました(取得範囲内でのさらなる切り詰めです)"
SOURCE_NOTE = "取得範囲の上限に達したため、ファイル先頭部分のみのプレビューです(ファイル全体はさらに続きがあります)"


def tabular_preview(text: Column) -> Column:
    """struct(body, note): the header and ROWS rows of delimited text."""
    lines = F.split(text, r"\r\n|\r|\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    rows = F.greatest(F.size(lines) - 1, F.lit(0))
    return F.struct(
        F.array_join(F.slice(lines, 1, ROWS + 1), "\n").alias("body"), F.format_string(ROWS_NOTE, rows, F.least(rows, F.lit(ROWS))).alias("note")
    )


def most_chars(max_tokens: int) -> int:
    """Characters other than white space and CJK that max_tokens allows."""
    n = max(0, int(max_tokens * OTHER_CHARS) + 2)
    while n > 0 and math.ceil(n / OTHER_CHARS) > max_tokens:
        n -= 1
    return n


def cap_tokens(text: Column, max_tokens: int) -> Column:
    """The longest prefix within max_tokens: the estimate never falls as a prefix grows, so the prefix ends
    before the first code point at which the running cost would round up beyond the budget.

    A CJK character costs more than another, so a prefix within the budget holds most_chars() that are no white space at
    most: no more of a text is looked at. Without CJK in it that is the prefix; else its characters are counted."""
    step = lambda a, c: F.struct(
        (a["cjk"] + F.when(c.rlike(f"[{CJK}]"), 1).otherwise(0)).alias("cjk"),
        (a["other"] + F.when(c.rlike(f"[{CJK}{SPACE}]"), 0).otherwise(1)).alias("other"),
        a["n"].alias("n"),
    )
    cost = lambda a: F.ceil(a["cjk"] * F.lit(CJK_TOKENS) + a["other"] / F.lit(OTHER_CHARS))

    def grow(a: Column, c: Column) -> Column:
        b = step(a, c)
        more = cost(b) <= max_tokens
        return F.struct(b["cjk"].alias("cjk"), b["other"].alias("other"), F.when(more, a["n"] + 1).otherwise(a["n"]).alias("n"))

    zero = F.struct(F.lit(0).alias("cjk"), F.lit(0).alias("other"), F.lit(0).alias("n"))

    def cut(head: Column) -> Column:
        n = F.aggregate(F.filter(F.split(head, ""), lambda c: c != ""), zero, grow, lambda a: a["n"])
        return F.when((F.octet_length(head) == F.length(head)) | ~head.rlike(f"[{CJK}]"), head).otherwise(F.substring(head, F.lit(1), n))

    if max_tokens < 0:
        return F.when(text.isNotNull(), "")
    # possessive throughout: such a group is matched in a loop, and takes no stack
    return bound(F.regexp_extract(text, rf"\A(?:[{SPACE}]*+[^{SPACE}]){{0,{most_chars(max_tokens)}}}+[{SPACE}]*+", 0), cut)


def handoff_preview(text: Column, content_type: Column, max_tokens: int, source_cut: Column) -> Column:
    """struct(body, note), null for types that are not text."""
    delimited = mime(content_type).isin("text/csv", "text/tab-separated-values")
    capped = cap_tokens(text, max_tokens)
    note = F.when(estimate_tokens(text) > max_tokens, BUDGET_NOTE).when(source_cut, SOURCE_NOTE)
    return F.when(is_text_type(content_type), F.when(delimited, tabular_preview(text)).otherwise(F.struct(capped.alias("body"), note.alias("note"))))
