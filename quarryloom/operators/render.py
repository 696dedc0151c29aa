"""Responses as text: header lines, a blank line, the content. Optional lines are left out by null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.functions.urls import guess_filename
from quarryloom.functions.text import quote_shell

# fixed values: labels and messages
NO_TITLE, UNKNOWN = "(なし)", "(不明)"
LABELS = {"added": "追加", "changed": "変更", "removed": "削除"}
NO_HEADINGS = "(見出しが見つかりませんでした。mode: markdown で全文を取得してください)"
NO_LINKS = "(リンクが見つかりませんでした)"
OVER_BUDGET = "budget_exceeded: true(単一ブロックがmax_tokensを超過しています)"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _title(page: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(page["title"], F.lit(NO_TITLE)))


def _optional(page: Column, removed: Column | None) -> list[Column]:
    method = page["extraction"]
    out = [_line("adapter", page["adapter"]), F.when(method.isin("geometry", "body-fallback"), _line("extraction", method))]
    return out if removed is None else [*out, F.when(removed > 0, _line("template_blocks_removed", removed))]


def _sources(hints: Column) -> Column:
    return F.when(F.size(F.coalesce(hints, F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n\ndata_sources:\n"), F.array_join(hints, "\n"))).otherwise("")


def markdown_response(page: Column, paged: Column, removed: Column, section: Column | None = None, path: Column | None = None) -> Column:
    """page: struct(title, url, cache, tier, pruned, adapter, extraction, hints); paged: as paginate gives it."""
    none = F.lit(None).cast("string")
    header = F.concat_ws(
        "\n",
        _title(page),
        _line("url", page["url"]),
        F.lit("mode_used: markdown"),
        none if section is None else _line("section", section),
        none if path is None else _line("section_path", path),
        _line("cache", page["cache"]),
        _line("tokens", paged["tokens"]),
        F.concat(F.lit("page: "), paged["page"].cast("string"), F.lit(" of "), paged["total_pages"].cast("string")),
        _line("fetch_tier", page["tier"]),
        _line("pruned_blocks", page["pruned"]),
        *_optional(page, removed),
        F.when(paged["exceeded_budget"], OVER_BUDGET),
    )
    return F.concat(header, F.lit("\n\n"), paged["content"], _sources(page["hints"]))


def unchanged_response(page: Column) -> Column:
    return F.concat_ws("\n", _line("url", page["url"]), F.lit("mode_used: markdown"), F.lit("cache: unchanged"))


def diff_block(kind: Column, level: Column, heading: Column, content: Column) -> Column:
    label = F.concat(F.lit(" ["), *[F.when(kind == k, v).otherwise("") for k, v in LABELS.items()], F.lit("]"))
    title = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), heading, label)
    headed = content.rlike(r"\A#{1,6}\s")
    first = F.concat(F.regexp_extract(content, r"\A([^\n]*)", 1), label, F.regexp_extract(content, r"(?s)\A[^\n]*(.*)", 1))
    return F.when(kind == "removed", title).when(headed, first).otherwise(F.concat(title, F.lit("\n\n"), content))


def diff_response(page: Column, changes: Column, removed: Column) -> Column:
    """changes: array<struct<type, level, heading, content>> in order."""
    n = lambda t: F.size(F.filter(changes, lambda c: c["type"] == t)).cast("string")
    counts = F.concat(F.lit("changed_sections: "), F.size(changes).cast("string"), F.lit("(追加"), n("added"), F.lit("/変更"), n("changed"), F.lit("/削除"), n("removed"), F.lit(")"))
    header = F.concat_ws("\n", _title(page), _line("url", page["url"]), F.lit("mode_used: markdown"), F.lit("cache: diff"), counts, _line("fetch_tier", page["tier"]), *_optional(page, removed))
    body = F.array_join(F.transform(changes, lambda c: diff_block(c["type"], c["level"], c["heading"], c["content"])), "\n\n")
    return F.concat(header, F.lit("\n\n"), body, _sources(page["hints"]))


def outline_response(page: Column, sections: Column, total_tokens: Column, removed: Column) -> Column:
    """sections: array<struct<id, level, heading, excerpt, tokens>> in order."""
    header = F.concat_ws(
        "\n", _title(page), _line("url", page["url"]), F.lit("mode_used: outline"), _line("cache", page["cache"]), _line("total_tokens", total_tokens), _line("fetch_tier", page["tier"]), *_optional(page, removed)
    )
    line = lambda s: F.concat(
        F.repeat(F.lit("  "), s["level"] - 1), F.lit("- ["), s["id"], F.lit("] "), F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["heading"], F.lit(" — "), s["excerpt"], F.lit(" (~"), s["tokens"].cast("string"), F.lit(" tok)")
    )
    body = F.array_join(F.transform(sections, line), "\n")
    return F.concat(header, F.lit("\n\n"), F.when(body == "", NO_HEADINGS).otherwise(body))


def links_response(url: Column, source: Column, links: Column, truncated: Column, before_filter: Column) -> Column:
    count = F.concat(F.lit("count: "), F.size(links).cast("string"), F.when(truncated, " (truncated)").otherwise(""))
    line = lambda x: F.concat(F.lit("- "), F.when(F.coalesce(x["title"], F.lit("")) != "", F.concat(x["title"], F.lit(" — "))).otherwise(""), x["url"])
    empty = F.when(before_filter > 0, F.concat(F.lit("(リンクが見つかりませんでした。フィルタ前 "), before_filter.cast("string"), F.lit(" 件。filterに一致しませんでした)"))).otherwise(NO_LINKS)
    body = F.when(F.size(links) > 0, F.array_join(F.transform(links, line), "\n")).otherwise(empty)
    return F.concat(F.concat_ws("\n", _line("url", url), _line("source", source), count), F.lit("\n\n"), body)


def handoff_response(url: Column, content_type: Column, declared: Column, got: Column, preview: Column, cap: int) -> Column:
    """preview: struct(body, note) or null; left out where the declared size is beyond the cap."""
    size = F.coalesce(declared.cast("string"), F.concat(got.cast("string"), F.lit("(取得分。Content-Lengthヘッダ無し)")))
    header = F.concat_ws("\n", _line("content_type", F.coalesce(content_type, F.lit(UNKNOWN))), _line("size", size), _line("url", url), F.lit("mode_used: handoff"))
    shown = F.when(F.coalesce(declared <= cap, F.lit(True)), F.concat(F.lit("\n\n"), preview["body"], F.coalesce(F.concat(F.lit("\n\n("), preview["note"], F.lit(")")), F.lit(""))))
    hint = F.concat(F.lit("\n\nhint: このファイルは本文抽出対象外です。全体の取得は curl -L -o "), guess_filename(url), F.lit(" "), quote_shell(url), F.lit(" を推奨します"))
    return F.concat(header, F.coalesce(shown, F.lit("")), hint)


def pdf_response(title: Column, url: Column, cache: Column, pages: Column, paged: Column) -> Column:
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("title: "), F.coalesce(title, F.lit(NO_TITLE))),
        _line("url", url),
        F.lit("mode_used: markdown"),
        _line("cache", cache),
        _line("tokens", paged["tokens"]),
        F.concat(F.lit("page: "), paged["page"].cast("string"), F.lit(" of "), paged["total_pages"].cast("string")),
        F.lit("fetch_tier: pdf"),
        _line("pdf_pages", pages),
        F.when(paged["exceeded_budget"], OVER_BUDGET),
    )
    return F.concat(header, F.lit("\n\n"), paged["content"])


def write_responses(responses: DataFrame, path: str, response: str = "response") -> None:
    """Responses as text files, each followed by a newline; rows without one (errors) are left out."""
    responses.filter(F.col(response).isNotNull()).select(F.col(response).alias("value")).write.mode("errorifexists").text(path)
