"""Token estimates, pages, sections, excerpts and diffs."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarryloom.functions import markdown as M
from quarryloom.functions import text as T
from quarryloom.functions.cjk import normalise_cjk
from quarryloom.functions.preview import cap_tokens, handoff_preview, most_chars
from quarryloom.operators import diff as D
from quarryloom.operators import template as P


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,tokens", [("", 0), ("a" * 38, 10), ("あ" * 10, 9), ("あ" * 10 + "a" * 38, 19), (" \n\t　", 0)])
def test_tokens(spark, text, tokens):
    assert one(spark, T.estimate_tokens(F.col("t")), t=text) == tokens


def blocks_by_hand(md):
    out, now, fenced = [], [], False

    def flush():
        text = "\n".join(now).rstrip("\n")
        if text.strip():
            out.append(text)
        now.clear()

    for line in md.split("\n"):
        if re.match(r"\s*```", line):
            fenced = not fenced
            now.append(line)
        elif not fenced and not line.strip():
            flush()
        else:
            now.append(line)
    flush()
    return out


def test_blocks_against_a_line_scan(spark):
    rng = random.Random(3)
    lines = ["", "  ", "text", "  indented", "```", "```py", "# head", "code  ", "　"]
    docs = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(docs)), "i int, md string").select("i", M.blocks(F.col("md")).alias("b")).collect()
    for r in got:
        assert list(r["b"]) == blocks_by_hand(docs[r["i"]]), repr(docs[r["i"]])


def pages(spark, md, budget, page):
    return one(spark, M.paginate(M.measured(M.blocks(F.col("md"))), budget, F.col("p")), md=md, p=page)


def test_pages(spark):
    short = "# 見出し\n\n本文です。"
    p = pages(spark, short, 1000, 99)
    assert (p.content, p.page, p.total_pages, p.exceeded_budget) == (short, 1, 1, False)
    many = "\n\n".join(["これは繰り返される段落です。" * 2] * 20)
    whole = [pages(spark, many, 50, i + 1) for i in range(pages(spark, many, 50, 1).total_pages)]
    assert len(whole) > 1 and "\n\n".join(p.content for p in whole) == many
    fence = "```\n" + "line of code\n\n" * 200 + "```"
    p = pages(spark, "before\n\n" + fence, 20, 2)
    assert p.content == fence and p.exceeded_budget
    assert "次のセクション" not in pages(spark, "\n\n".join(["段落1です。"] * 5 + ["# 次のセクション", "段落2です。"]), 15, 1).content
    p = pages(spark, "", 10, 3)
    assert (p.content, p.page, p.total_pages, p.tokens, p.exceeded_budget) == ("", 1, 1, 0, False)


SAMPLE = "# 大見出し\n\n導入部の文章です。続きます。\n\n## 小見出し1\n\n内容1です。\n\n### さらに深い見出し\n\n深い内容です。\n\n## 小見出し2\n\n内容2です。"


def sections_by_stack(md):
    lines, heads, fenced = md.split("\n"), [], False
    for i, line in enumerate(lines):
        if re.match(r"\s*```", line):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.*)$", line)):
            heads.append((i, len(m[1]), m[2].strip()))
    if not heads:
        return [("s1", 1, "(見出しなし)", [], md, md)] if md.strip() else []
    out, stack = [], []
    for n, (i, level, text) in enumerate(heads):
        while stack and stack[-1]["level"] >= level:
            stack.pop()
        s = {"id": f"s{n + 1}", "level": level, "h": text, "above": [a["h"] for a in stack], "lines": [], "own": []}
        stack.append(s)
        part = lines[i : heads[n + 1][0] if n + 1 < len(heads) else len(lines)]
        for a in stack:
            a["lines"] += part
        owner = next((a for a in reversed(stack) if a["level"] <= 4), None)
        if owner:
            owner["own"] += part
        if level <= 4:
            out.append(s)
    return [(s["id"], s["level"], s["h"], s["above"], "\n".join(s["lines"]), "\n".join(s["own"]).strip()) for s in out]


def test_sections_against_a_stack(spark):
    rng = random.Random(4)
    lines = ["# a", "## b", "### c", "#### d", "##### e", "###### f", "text", "", "```", "not # a head"]
    docs = [SAMPLE, "", "  ", "no heads"] + ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = M.sections(spark.createDataFrame(list(enumerate(docs)), "i int, md string"), "md", "i").orderBy("i", "ord").collect()
    got = {}
    for r in rows:
        got.setdefault(r["i"], []).append((r["id"], r["level"], r["heading"], [a["heading"] for a in r["ancestors"]], r["content"], r["own_content"]))
    for i, md in enumerate(docs):
        want = sections_by_stack(md)
        assert [x[:5] for x in got.get(i, [])] == [x[:5] for x in want], repr(md)
        # h5 and h6 outside any outlined section belong to none
        assert [x[5] for x in got.get(i, [])] == [x[5] for x in want], repr(md)


def test_outline_and_breadcrumbs(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "## A\n\n[臭腺](http://x)から分泌される。次。\n\n### [Types of caches](u)\n\n![説明図](i.png)を参照。")], "i int, md string")
    rows = {(r["i"], r["id"]): r for r in M.outline(df, "md", "i").collect()}
    assert rows[1, "s1"].excerpt == "導入部の文章です。" and rows[1, "s2"].tokens > rows[1, "s3"].tokens
    assert rows[2, "s1"].excerpt == "臭腺から分泌される。" and rows[2, "s2"].excerpt == "説明図を参照。"
    paths = {(r["i"], r["id"]): r["p"] for r in M.sections(df, "md", "i").select("i", "id", M.breadcrumb(F.col("ancestors")).alias("p")).collect()}
    assert paths[1, "s1"] is None and paths[1, "s3"] == "大見出し › 小見出し1"


BASE = "# A\n\nあ\n\n## B\n\nい\n\n## C\n\nう"


@pytest.mark.parametrize(
    "old,new,want,every",
    [
        (BASE, BASE, [], False),
        (BASE, BASE.replace("い", "い2"), [("changed", "B")], False),
        (BASE, BASE + "\n\n## D\n\nえ", [("added", "D")], False),
        (BASE, "# A\n\nあ\n\n## B\n\nい", [("removed", "C")], False),
        (BASE, "# A\n\nあ\n\n## C\n\nう\n\n## B\n\nい", [], False),
        (BASE, "# X\n\ny", [("added", "X"), ("removed", "A"), ("removed", "B"), ("removed", "C")], True),
        ("a", "b", [("changed", "(見出しなし)")], True),
        ("## お知らせ\n\n1\n\n## お知らせ\n\n2\n\n## お知らせ\n\n3", "## お知らせ\n\n1x\n\n## お知らせ\n\n2x\n\n## お知らせ\n\n3", [("changed", "お知らせ")] * 2, False),
    ],
)
def test_diff(spark, old, new, want, every):
    df = spark.createDataFrame([(1, old, new)], "i int, old string, new string")
    d = D.section_diff(df, "old", "new", "i")
    rows = d.filter("type <> 'unchanged'").orderBy("pos").collect()
    assert [(r["type"], r["heading"]) for r in rows] == want
    assert all(r["content"] == "" for r in rows if r["type"] == "removed")
    assert D.diff_summary(d, "i").first()["all_changed"] is every


def test_template(spark):
    page = lambda d, u, t, *b: (d, u, t, list(b))
    rows = [page("a", "1", 1, "Nav", "Foot", "A"), page("a", "2", 2, "Nav", "Foot", "B"), page("a", "3", 3, "Nav", "Foot", "C"), page("b", "1", 1, "Nav", "X"), page("b", "2", 2, "Nav", "X")]
    rows += [page("c", str(i), i, *(["Common"] if i else ["Odd"])) for i in range(4)]
    got = P.template_hashes(spark.createDataFrame(rows, "domain string, url string, fetched_at long, block_hashes array<string>"))
    assert {tuple(r) for r in got.collect()} == {("a", "Nav"), ("a", "Foot"), ("c", "Common")}
    h = lambda s: T.content_hash(F.lit(s))
    docs = spark.createDataFrame([("a", "Nav\n\nBody\n\nFoot"), ("z", "x\n\n\n\ny")], "domain string, markdown string")
    known = docs.limit(1).select("domain", F.explode(F.array(h("Nav"), h("Foot"))).alias("hash"))
    shown = {r["domain"]: (r["shown"], r["removed"]) for r in P.remove_template(docs, known).collect()}
    assert shown == {"a": ("Body", 2), "z": ("x\n\n\n\ny", 0)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("ABCＡＢＣ１２３", "ABCABC123"), ("これは テスト です。", "これはテストです。"), ("とても **重要** です。", "とても**重要**です。"), ("一行\n二行\n\n三行", "一行二行\n\n三行"),
        ("英語の **bold** です。", "英語の **bold** です。"), ("`全角 ＡＢＣ` です", "`全角 ＡＢＣ` です"), ("This is **bold** text.", "This is **bold** text."),
    ],
)
def test_cjk(text, want):
    assert normalise_cjk(text) == want


def test_previews(spark):
    assert one(spark, cap_tokens(F.col("t"), 10), t="a" * 10000) == "a" * 38
    csv = "h\n" + "\n".join(map(str, range(20))) + "\n"
    p = one(spark, handoff_preview(F.col("t"), F.lit("text/csv; charset=x"), 10, F.lit(False)), t=csv)
    assert p.body == "h\n0\n1\n2\n3\n4" and "20行中先頭5行" in p.note
    assert one(spark, handoff_preview(F.col("t"), F.lit("application/zip"), 10, F.lit(False)), t="x") is None
    assert "先頭部分" in one(spark, handoff_preview(F.col("t"), F.lit("text/plain"), 100, F.lit(True)), t="x").note


def test_capped_texts_are_read_no_further_than_the_budget(spark):
    """The prefix is that of counting every character, and what lies beyond most_chars() is not counted."""
    assert [most_chars(n) for n in (0, 1, 10, 25, 400)] == [0, 3, 38, 95, 1520]
    rng = random.Random(6)
    alphabet = "abcd ,\n\t\u00a0\u3000漢字かな。é😀"
    texts = [None, "", "  ", "a" * 95, "a" * 96, "a" * 95 + " \n b", "漢" * 27, "漢" * 28] + ["".join(rng.choices(alphabet[: rng.choice([6, len(alphabet)])], k=rng.randint(0, 300))) for _ in range(200)]

    def want(t):
        cjk = other = n = 0
        for c in t:
            wide = bool(re.match(r"[\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff01-\uffef]", c))
            cjk, other = cjk + wide, other + (not wide and not c.isspace())
            if math.ceil(cjk * 0.9 + other / 3.8) > 25:
                break
            n += 1
        return t[:n]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cap_tokens(F.col("t"), 25).alias("got")).collect()
    assert {r["i"]: r["got"] for r in rows} == {i: t if t is None else want(t) for i, t in enumerate(texts)}


def test_block_score_signs(spark):
    score = lambda t, links: one(spark, T.block_score(F.col("t"), F.col("l"))["score"], t=t, l=links)
    assert score("これは本文です。句読点があります、はい。", "") > 0 and score("Prose reads like this, with marks.", "") > 0
    assert score("ホーム 会社概要 お問い合わせ", "ホーム 会社概要 お問い合わせ") < 0 and score("", "") == 0
