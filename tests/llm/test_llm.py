"""The corpus operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarryloom.llm import ann, chat, common, decontaminate, graph, html_extract, line_dedup, mixing, simhash_dedup, suffix_dedup, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows], DOC)


WORDS = [a + b for a in "ba ke lo mi nu pa re so ti vu".split() for b in "da fe gi ho ju ka le mo ni pu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(None, "a text without an id"), (90, None), (91, ""), (92, " \n\n "), (93, "x"), (93, "x"), (94, "x " * 5000)]


# 1
def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 40)), rng.choice(["a", "b", "c", None])) for i in range(300)] + [(1000, "w " * 3000, "a"), *[(*r, "odd") for r in ODD], (95, None, "empty"), (96, "q", "Z")]
    df = docs_of(spark, rows).withColumn("taken", F.lit("clash")).withColumn("block", F.lit(1))
    sized = mixing._sized(df, "doc_id", "text", "source")
    plans = [mixing.plan(sized, block_words=64, shard_words=500) for _ in range(2)]
    got = [mixing.drawn(sized, p).collect() for p in plans]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and plans[0].shards > 3
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = collections.defaultdict(lambda: [0, 0, set()])
    for r in got[0]:
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2].add(r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sum(size(t) for _, t, s in rows if s == r["source"])
    order = sorted((s for s in by if s is not None)) + [None]
    goal = mixing.targets([by[s][0] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert abs(sum(goal) - 1.5 * sum(by[s][0] for s in order)) < 1e-6
    for s, g in zip(order, goal):
        assert by[s][2] == {g} and abs(by[s][1] - g) < 4 and g <= 2 * by[s][0]
    mixed = mixing.mix(df, block_words=64, shard_words=500)
    assert set(df.columns) < set(mixed.columns) and mixed.agg(F.sum("_words")).first()[0] == sum(r["taken"] for r in got[0])
    assert mixing.mix(df.limit(0)).count() == 0


def test_splitting_tree():
    q = np.array([100, 7, 0, 33])
    parts = mixing.split_quotas(q, 6)
    assert (parts.sum(axis=0) == q).all() and set(parts.sum(axis=1)) <= {23, 24} and (mixing.split_quotas(q, 6) == parts).all()


# 2
def segments_by_hand(scores, a, b):
    """All maximal segments by their definition: the best one, then the same on both sides of it."""
    sums = [(sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
    total, i, j = max(sums, default=(0.0, 0, 0))
    return [] if total <= 0 else [*segments_by_hand(scores, a, i), (i, j, round(total, 6)), *segments_by_hand(scores, j, b)]


def test_segments():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 25)
        hits = [(i, rng.uniform(0.1, 4.5)) for i in range(n) if rng.random() < 0.3]  # no two sums are equal
        scores = [-0.5] * n
        for i, s in hits:
            scores[i] = s
        got = [(s.start, s.end, round(s.score, 6)) for s in toxicity.maximal_segments(n, hits)]
        assert got == segments_by_hand(scores, 0, n)


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["vlimex", "grontul", "skarp"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    df = docs_of(spark, rows + ODD).withColumns({c: F.lit("clash") for c in ("score", "_score", "n_passages", "passages")})
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (2, 0, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(df, lab)
    assert set(bad) <= set(model.lexicon)
    scored = toxicity.score(df, model, passages=True).collect()
    assert {r["score"] for r in scored} == {"clash"}
    got = {r["doc_id"]: {"score": r["score_1"], "passages": r["passages_1"]} for r in scored}
    held = [r["id"] for r in spark.range(600).filter(toxicity.held_out(F.col("id"))).collect()]
    assert 90 < len(held) < 150 and np.mean([(got[i]["score"] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[91]["score"] < 0.5
    assert any(set(p["words"].split()) & set(bad) for p in got[0]["passages"])
    kept = toxicity.reject(df, lab)
    assert kept.columns == df.columns and kept.filter(F.col("doc_id") % 4 == 0).filter("doc_id < 90").count() == 0
    none = toxicity.train(df, lab.limit(0))
    assert toxicity.score(df.limit(5), none).filter("score_1 < 0.001").count() == 5
    assert toxicity.score(df.limit(0), model).count() == 0


# 3
def removed_by_hand(texts):
    n = collections.Counter(b[p : p + 200] for b in texts for p in range(len(b) - 199))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if n[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("hot,batch", [(1000, 4 << 20), (1, 3000)])
def test_suffix_dedup(spark, monkeypatch, hot, batch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(4)
    base = prose(rng, 500)
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(2000)
            t += base[a : a + rng.randint(1, 600)] + prose(rng, rng.randint(0, 12))
        rows.append((i, t))
    rows += [*ODD, (200, "é" * 150), (201, "é" * 150), (202, "a" * 900), (203, base), (203, base), (204, "\x00" * 450)]
    df = docs_of(spark, rows).withColumn("spans", F.lit(1))
    got = suffix_dedup.remove(df, suffix_dedup.repeated(df, batch_bytes=batch)).collect()
    want = removed_by_hand([(t or "").encode() for _, t in rows])
    assert collections.Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == collections.Counter((i, *w) for (i, _), w in zip(rows, want))
    empty = df.limit(0)
    assert suffix_dedup.remove(empty, suffix_dedup.repeated(empty)).count() == 0


def test_suffix_family():
    rng = random.Random(5)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(200, 420))) * rng.randint(1, 2) for _ in range(6)]
        texts += [texts[0][50:300], texts[1][:230] + texts[2][:230]]
        family, told, seen = suffix_dedup.SuffixFamily(), set(), {}
        for i, t in enumerate(texts):
            n = len(t) - 199
            if n > 0:
                refs = (i << 21) + np.arange(n)
                seen |= {int(r): t[p : p + 200] for p, r in enumerate(refs)}
                told |= set(family.add(np.frombuffer(t, np.uint8), np.arange(n), refs).tolist())
        count = collections.Counter(seen.values())
        assert told == {r for r, w in seen.items() if count[w] > 1}
        for level in family.levels:
            ordered = [level.buffer[s : s + 200].tobytes() for s in level.starts]
            assert ordered == sorted(set(ordered))


# 4
def contamination_by_hand(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - 7, 1) if w else 0):
            wins[tuple(w[s : s + 8])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[k]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return out


def test_decontaminate(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([20, 30]))) for i in range(10)] + [(10, "Short ITEM here"), (11, None), (12, "..."), (13, "solo"), (None, prose(rng, 12)), (9, "another text of item nine has more words than eight")]
    docs = []
    for i in range(80):
        t = prose(rng, rng.randint(0, 60)).split()
        if i % 3 == 0:
            w = (rng.choice(items)[1] or "").upper().split()
            a = rng.randrange(max(len(w), 1))
            at = rng.randrange(len(t) + 1)
            t[at:at] = w[a : a + rng.randint(5, 25)]
        docs.append((i, " ".join(t)))
    docs += [*ODD, (95, "a short item, HERE! And solo; É end"), (96, items[0][1] + " " + items[1][1])]
    clash = ("items", "hits", "_bad", "_bad_id", "_bad_hash", "_bad_hits", "_text_hash")
    df, bench = docs_of(spark, docs).withColumns({c: F.lit("clash") for c in clash}), spark.createDataFrame(items, "item_id long, text string")
    want = contamination_by_hand(docs, items)
    for limit in (10**6, 0):
        found = decontaminate.contamination(df, bench, broadcast_windows=limit)
        got = [(r["id"], r["n_words"], len(r["hits"]), tuple(r["items"])) for r in found.collect() for _ in range(r["copies"])]
        assert collections.Counter(got) == collections.Counter(want)
    kept = decontaminate.decontaminate(df, bench, "documents", min_hit=10**6)
    assert kept.columns == df.columns and kept.count() == sum(len(w[3]) < 2 for w in want)
    cut = decontaminate.decontaminate(df, bench, "spans").filter("doc_id = 95").first()["text"]
    assert cut == "a! And; É end"
    again = decontaminate.contamination(decontaminate.decontaminate(df, bench), bench)
    assert again.filter(F.size("items") >= 2).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).filter(F.size("hits") > 0).count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


# 5
def test_html(spark):
    page = """<html><head><title>T</title><script>x</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies. OK.</div>
    <div id=content><h1>My  title</h1><p>First &amp; para, with text.<p>Short.<ul><li>one item</li></ul></div><div class="sidebar"><p>Side text is long enough to matter, maybe.</p></div>
    <div class="user-comments"><p>I disagree, totally. Because of reasons.</p></div><form><p>name</p></form><footer>&copy;</footer></body></html>"""
    want = "My title\nFirst & para, with text.\nShort.\none item"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>a &lt;b&gt;\n\t c"), (4, "u", "<div>" * 30000 + "deep"), (1, "u", page), (5, "u", "<nav>only menus</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("a b", F.lit(1))
    assert html_extract.extract(df.withColumn("text", F.lit("mine"))).select("text", "text_1").first()[:] == ("mine", want)
    got = html_extract.extract(df).collect()
    assert [r["text"] for r in got] == [want, "", "", "a <b> c", "deep", want, ""] and got[3]["page_id"] is None and "a b" in got[0]
    assert html_extract.extract(df.limit(0)).count() == 0


LONG = "This paragraph is long enough to count, with commas, and a full stop. It goes on for a while, too."
#: Shapes of pages and their exact text.
PAGES = [
    (f"<article><h1>Title</h1><div class=body><p>{LONG}<p>{LONG}</div></article>", f"Title\n{LONG}\n{LONG}"),
    (f"<article><h1>Title</h1><section><p>{LONG}<p>{LONG}</section></article><section><a href=/>More</a></section>", f"Title\n{LONG}\n{LONG}"),
    (f"<main><section class=intro><p>Short, sweet.</section><section class=long><p>{LONG}<p>{LONG}<p>{LONG}</section><section class=end><p>The end.</section></main>", f"Short, sweet.\n{LONG}\n{LONG}\n{LONG}\nThe end."),
    (f"<article><p>{LONG}<ul><li><a href=1>One link</a><li><a href=2>Two</a></ul></article>", f"{LONG}\nOne link\nTwo"),
    (f'<div class="social-science"><p>{LONG}<p>{LONG}</div>', f"{LONG}\n{LONG}"),
    (f'<div class="footer-less header-image"><p>{LONG}</div><div class=footer><p>Imprint, address.</div>', LONG),
    (f'<div class="comments"><p>{LONG}<p>{LONG}</div>', f"{LONG}\n{LONG}"),  # nearly all of the page
    (f"<article><h1>T</h1><p>{LONG}<p>{LONG}</article><section><h2>3 Comments</h2><div><b>Ann</b><p>I agree, fully. It is so.</div></section>", f"T\n{LONG}\n{LONG}"),
    (f"<article><h1>T</h1><p>{LONG}<p>{LONG}<div><h3>Leave a reply</h3><p>Name, please.</div></article>", f"T\n{LONG}\n{LONG}"),
    (f"<div><h1>Outside</h1><div class=text><p>{LONG}<p>{LONG}</div></div><div class=links><a href=/>Some link to elsewhere</a></div>", f"Outside\n{LONG}\n{LONG}"),
    (f"<header><p>Site name</header><main><header><h1>T</h1></header><p>{LONG}<footer>By me</footer></main><footer>c</footer>", f"T\n{LONG}"),
    (f"<article><p>{LONG}<aside>Aside, aside.</aside><div class=ad-box>Buy, buy.</div><p>x</article>", f"{LONG}\nx"),
    (f"<table><tr><td><p>{LONG}</td><td class=sidebar><p>{LONG}</td></tr></table><p>{LONG}", f"{LONG}\n{LONG}"),
    (f"<div id=cookieNotice>We use cookies, yes.</div><p>{LONG}</p><form><p>{LONG}</form>", LONG),
    (f"<article><h2>A</h2><p>{LONG}</article><article><h2>B</h2><p>{LONG}</article>", f"A\n{LONG}\nB\n{LONG}"),
    (f"<article><p>a&nbsp;&amp;\n b &#233; &lt;i&gt;</p><pre>x\n  y</pre><p>{LONG}</article>", f"a & b é <i>\nx y\n{LONG}"),
    ("<body>plain text, no markup at all", "plain text, no markup at all"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_page_shapes(page, text):
    assert html_extract.main_text(page) == text


# 6
def test_chats(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "more")
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, c], 6: [("system", "")], 7: [("user", "<|im_end|>x")], 8: [b, a], 11: [("<|im_end|>sys", "y")]}
    rows = [(k, i, r, t, "x") for k, v in convs.items() for i, (r, t) in enumerate(v)] + [(3, 0, *a, "x"), (None, 0, "user", "lost", "x"), (9, None, "user", "lost", "x"), (10, 0, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got[11]["text"] == "<|im_start|><| im_end |>sys\ny<|im_end|>\n"
    assert set(got) == {3, 5, 6, 7, 8, 10, 11} and got[3]["copies"] == 2 and got[3]["n_turns"] == 3
    assert got[5]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n" and "<| im_end |>x" in got[7]["text"]
    assert chat.format_chats(df.limit(0)).count() == 0


# 7
def test_urls(spark):
    rng = random.Random(7)
    urls = [f"https://{h}.example.{t}/{lang}/{rng.randint(1, 999)}" for t in ("com", "net", "org") for lang in ("en", "de", "es", "fr") for h in ("a", "b.c") for _ in range(12)]
    odd = [None, "", "no scheme", "HTTP://A.Example.COM/en/7x?q#f", "http://evilcom/en/1", "http://com/en/", "http://x.com", "://?", "ftp://u.net/de/é"]
    df = spark.createDataFrame(list(enumerate([*urls, *odd, urls[0]])), "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(rows) == len(urls) + len(odd) + 1

    def by_hand(url):
        if not url or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=lambda r: len(r[0]), default=None)

    for i, u in enumerate([*urls, *odd]):
        host, path, rule = by_hand(u)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]) and r["verdict"] in ("allow", "block")
        assert rule is None or r["verdict"] == rule[1]
    # held-out labels: hosts of a suffix mostly agree, which the trees learn without the rule's path
    held = url_filter.judge(df, hold_out=True, keep=("page_id", "url")).withColumn("fold", url_filter.fold(F.col("url"))).filter("fold = 0 and rule is not null").collect()
    assert held and np.mean([(r["score"] > 0.5) == (r["verdict"] == "block") for r in held]) > 0.8
    undecided = [r["verdict"] for r in rows.values() if r["rule"] is None and r["host"].endswith(".net")]
    assert undecided.count("allow") > 0.8 * len(undecided) > 0
    assert rows[len(urls) + 7]["verdict"] == "allow"  # nothing learnt of its suffix
    assert {r["verdict"] for r in url_filter.judge(df.filter("url is null or url = ''")).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0)).count() == 0


# 8
def lines_by_hand(rows):
    """Groups of occurrences (doc_id, text, line number), by the edit similarity of every pair of lines."""
    occurrences = collections.defaultdict(list)
    keyed = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0]))
    for i, t in keyed:
        for n, line in enumerate(t.split("\n")):
            norm = re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", re.sub("[1-9]", "0", line.lower())).strip(" ")
            if norm:
                occurrences[norm].append((i, t, n))

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    norms, root = list(occurrences), list(range(len(occurrences)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def alike(a, b):
        m = max(len(a), len(b))
        if min(len(a), len(b)) < max(line_dedup.FUZZY_CHARS, m * 0.8):
            return False
        x, y = a.split(" "), b.split(" ")
        share = lev(x, y) / max(len(x), len(y))
        return share <= 0.1 or (share <= 0.2 if m > line_dedup.LONG else share <= 0.6 and lev(a, b) <= m * 0.2 + 1e-9)

    for i in range(len(norms)):
        for j in range(i):
            if alike(norms[i], norms[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = collections.defaultdict(list)
    for i, n in enumerate(norms):
        groups[find(i)] += occurrences[n]
    return groups


def test_lines(spark):
    rng = random.Random(8)
    stock = [prose(rng, rng.randint(5, 40)) for _ in range(12)]
    long = prose(rng, 120)
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = rng.choice([*stock, prose(rng, rng.randint(1, 12))])
            if rng.random() < 0.4:
                line = line.upper() + "!"
            if rng.random() < 0.3:
                line += f" {rng.randint(1, 99)}"
            lines.append(line)
        w = long.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, "\n".join([*lines, " ".join(w)])))
    rows += ODD + [(95, "one two three four\n\none two three four"), (96, "a " * 20000)]
    df = docs_of(spark, rows).withColumns({c: F.lit("clash") for c in ("gone", "_gone", "_gone_id", "_gone_hash", "_text_hash")})
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "_lines_removed"] and got.count() == len(rows)
    kept = collections.defaultdict(set)
    for r in got.collect():
        kept[r["doc_id"]].add(r["text"])
    groups = lines_by_hand(rows)
    # of every group one line stays: what goes is all others
    removed = sum(len(v) - 1 for v in groups.values())
    assert sum(r["_lines_removed"] for r in got.dropDuplicates(["doc_id", "text"]).collect()) == removed
    assert kept[90] == {None} and kept[91] == {""} and kept[95] == {"one two three four\n"}
    again = line_dedup.dedup_lines(got.drop("_lines_removed"))
    assert again.agg(F.sum("_lines_removed")).first()[0] == 0
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_edited_lines_are_linked(spark):
    """Recall against edit similarity alone: a copy with one letter changed is above 0.8, and goes."""
    rng = random.Random(88)
    rows = []
    for i in range(120):
        line = prose(rng, rng.randint(5, 40))
        at = rng.randrange(len(line))
        rows += [(2 * i, line), (2 * i + 1, line[:at] + "x" + line[at + 1 :])]
    gone = line_dedup.dedup_lines(docs_of(spark, rows)).filter("_lines_removed > 0").collect()
    assert {r["doc_id"] % 2 for r in gone} == {1} and len(gone) >= 0.95 * 120


def test_short_lines(spark):
    """Equal lines of few words, or of a script without spaces, go whatever their length; near ones only if long."""
    chinese = "这是一个没有空格的句子它应该被去重因为它出现了两次"
    rows = [(0, f"all rights reserved\n\n{chinese}\nletzte"), (1, f"All rights reserved.\n\n{chinese}"), (2, "Letzte\nietzte"), (3, f"{chinese[:-1]}回\n!!")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {0: rows[0][1], 1: "", 2: "ietzte", 3: "!!"}


def test_lines_that_share_one_crowded_place(spark):
    """Near lines that meet at one place only are linked, even if neither is its first or last line."""
    rng = random.Random(80)
    near = prose(rng, 20)
    rows = [(i, prose(rng, 20)) for i in range(4)] + [(4, near), (5, near[:-1] + "x")] + [(i, prose(rng, 20)) for i in range(6, 10)]
    found = line_dedup.lines(docs_of(spark, rows))
    reps = line_dedup.representatives(found).withColumns({"no": F.col("keep.id"), "at": F.array(F.lit(7).cast("long"))})
    assert {(r["node"], r["root"]) for r in line_dedup.groups(found, reps).collect()} == {(4, 4), (5, 4)}


def test_texts_of_lines_that_meet_none_are_not_kept(spark, monkeypatch):
    """Only lines that meet another have their texts written, also where joins are not broadcast; the result is the same."""
    rng = random.Random(82)
    near = [prose(rng, 20) for _ in range(3)]
    rows = [(None, near[0]), (1, f"{near[0][:-1]}x\n{near[1]}"), (2, f"{near[1]} 1"), (2, f"{near[1]} 1"), (3, near[2].upper())] + [(i, f"{prose(rng, 20)}\n{near[2]} {i % 3}") for i in range(4, 30)]
    tables = []

    def kept(df, name, *more, **options):
        out = common.written(df, name, *more, **options)
        tables.append((name, [c for c, kind in out.dtypes if kind == "string" and c in ("norm", "line")], out.count()))
        return out

    monkeypatch.setattr(line_dedup, "written", kept)
    got = [sorted(map(str, line_dedup.dedup_lines(docs_of(spark, rows)).collect()))]
    assert [name for name, texts, _ in tables if texts] == ["line-norms"]
    # two of each of the first two, and the third as it is and with 0
    assert sum(n for _, texts, n in tables if texts) == 6
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 1)
    monkeypatch.setattr(graph, "BROADCAST_PLACES", 0)
    got.append(sorted(map(str, line_dedup.dedup_lines(docs_of(spark, rows)).collect())))
    assert got[0] == got[1] and sum(name == "line-norms" for name, *_ in tables) == 1 + line_dedup.PARTS


# 9
def test_nearest(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:180] = x[100]  # copies
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [float("inf")] + [1.0] * 15, 0), (1200, [1.0], 0), (None, [1.0] * 16, 0), (1250, [], 0), (1300, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame([*rows, *odd, rows[0]], "vec_id long, embedding array<float>, rank int")
    queries = df.filter("vec_id % 50 = 0")
    unit = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))

    def by_hand(q, k):
        s = unit @ unit[q]
        return [i for i in np.lexsort((np.arange(700), -np.round(s, 12))) if i != q][:k]

    exact = ann.nearest(df, queries, share=1.0).collect()
    found = collections.defaultdict(list)
    for r in sorted(exact, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
        assert abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-12
    assert set(found) == set(range(0, 700, 50)) and all(found[q] == by_hand(q, 5) for q in found)
    assert found[100] == [101, 102, 103, 104, 105] and found[150] == [100, 101, 102, 103, 104]
    near = ann.nearest(df, queries).collect()
    assert np.mean([r["vec_id"] in by_hand(r["query_id"], 5) for r in near]) >= 0.9
    few = df.filter("vec_id in (0, 50, 60)")
    assert sorted((r["query_id"], r["rank"]) for r in ann.nearest(few, few.filter("vec_id % 50 = 0")).collect()) == [(0, 1), (0, 2), (50, 1), (50, 2)]
    assert ann.nearest(df.limit(0), queries.limit(0)).count() == 0


def test_footrule():
    rng = np.random.default_rng(1)
    pre = np.array([rng.permutation(20)[:6] for _ in range(50)], np.int32)
    block = ann.PermutationBlock(np.ones((50, 3)), pre, 20)
    for q in pre[:10]:
        want = []
        for p in pre:
            a, b = ({int(v): i for i, v in enumerate(z)} for z in (q, p))
            want.append(sum(abs(a.get(v, 6) - b.get(v, 6)) for v in set(a) | set(b)))
        assert block.footrule(q).tolist() == want


# 10
def test_near_copies(spark):
    rng = random.Random(10)
    base = [prose(rng, 400) for _ in range(8)]
    rows = []
    for i in range(70):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((500 - i, " ".join(w)))
    rows += [*ODD, (97, "Two Words"), (98, "two\twords")]
    df = docs_of(spark, rows).withColumn("component", F.lit("clash")).withColumn("fp", F.lit(1))

    def by_hand(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [by_hand(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
        if len(set(label)) == len({label[i] for i in label}):
            break
    ids = collections.defaultdict(list)
    for (i, _), c in zip(rows, label):
        ids[c].append(i)
    want = collections.Counter((i, f, min((x for x in ids[c] if x is not None), default=None)) for (i, _), f, c in zip(rows, fps, label))
    got = collections.Counter((r["id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash_dedup.groups(df).collect())
    assert got == want
    assert simhash_dedup.groups(df.limit(0)).count() == 0


def near_by_hand(rows, n=5, similarity=0.8):
    """Groups of texts by the Jaccard similarity of their n-word shingles, every pair compared."""
    texts = sorted({t or "" for _, t in rows})

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set()

    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        before = list(label)
        for i in range(len(texts)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and (sets[i] or not sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return dict(zip(texts, label))


def test_one_of_each_group_stays(spark):
    rng = random.Random(14)
    rows = []
    for i in range(60):
        w = prose(rng, rng.randint(60, 300)).split()
        rows.append((i, " ".join(w)))
        for k in range(rng.choice([0, 0, 1, 3])):
            for _ in range(len(w) // 100):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((rng.choice([1000 + i, i, 100 * k + i, None]), " ".join(w)))
    a, b = prose(rng, 80), prose(rng, 80)
    rows += [*ODD, (2001, a), (2002, a), (2002, b), (2007, prose(rng, 70)), (2007, prose(rng, 70)), (None, b)]
    clash = ("least", "no", "fp", "_h1", "_h2", "_keep_id", "_keep_h1", "h1", "root")
    df = docs_of(spark, rows).withColumns({c: F.lit("clash") for c in clash})
    kept = simhash_dedup.dedup(df)
    assert kept.columns == df.columns
    label = near_by_hand(rows)
    want, got = collections.defaultdict(list), collections.Counter()
    for i, t in rows:
        want[label[t or ""]].append((i is None, i or 0, t or ""))
    for r in kept.collect():
        got[label[r["text"] or ""]] += 1
        assert (r["doc_id"] is None, r["doc_id"] or 0) == min(want[label[r["text"] or ""]])[:2]
    assert got == collections.Counter(dict.fromkeys(want, 1))
    assert simhash_dedup.dedup(df.limit(0)).count() == 0


def test_similar_texts_that_share_one_crowded_place(spark):
    """Similar texts that meet at one place only are linked, even if neither is its first or last text."""
    rng = random.Random(81)
    near = prose(rng, 100)
    df = docs_of(spark, [(i, prose(rng, 100)) for i in range(4)] + [(4, near), (5, near + " end")] + [(i, prose(rng, 100)) for i in range(6, 10)])
    texts = simhash_dedup._sketches(df, "doc_id", "text", 5, 0.8).withColumns({"no": F.col("keep.id"), "fp": F.col("keep.id") * 0x0123456789ABCD, "least": F.array(F.lit(7).cast("long"))})
    assert {(r["a"], r["b"]) for r in simhash_dedup.similar(df, texts).collect()} == {(4, 5)}


def test_all_similar_texts_meet(spark):
    """Of every two texts of a similarity of 0.8 the sketches share a shingle, whichever are common."""
    rng = random.Random(82)
    passage, texts = prose(rng, 60), []
    for i in range(40):
        words = f"{prose(rng, rng.randint(20, 300))} {passage if i % 2 else ''}".split()
        texts += [" ".join(words), " ".join(words[len(words) // 12 :] + ["more"] * (len(words) // 12))]
    least = {r["keep"]["id"]: set(r["least"]) for r in simhash_dedup._sketches(docs_of(spark, list(enumerate(texts))), "doc_id", "text", 5, 0.8).collect()}
    sets = {i: set(simhash_dedup.shingles(texts[i].encode(), 5).tolist()) for i in least}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 10 and all(least[i] & least[j] for i, j in pairs)


def test_anchors_cover(spark):
    """Every pair within two bits is linked, wherever the bits are."""
    rng = random.Random(11)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        fps |= {x, x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), x ^ 0b111 << rng.randrange(61)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r["a"], r["b"]) for r in simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# the pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    item = prose(rng, 30)
    rows, labels = [], []
    for i in range(240):
        t = prose(rng, 40)
        if i % 6 == 0:
            w = t.split()
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["vlimex", "grontul"]))
            t = " ".join(w)
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(1000, rows[1][1], "en", "s0", 1), (1001, f"{prose(rng, 20)} {item}", "en", "s1", 1), (1002, None, None, None, None)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, left = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == names
        left.append(docs.count())
    ids = {r["doc_id"] for r in docs.collect()}
    assert left[1] <= left[0] - 38 and left[2] == left[1] - 1 and 1001 not in ids and {1, 2, 3, 4, 5} <= ids and 1000 not in ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} <= ids and out.count() > len(ids)
    # chained without being written in between, with columns that clash; and over an empty table
    clash = ["score", "_score", "_gone", "_gone_id", "_bad", "_bad_hits", "_row", "_h1", "least", "place"]
    chained = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.lit("clash") for c in clash})
    empty = chained.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        chained, empty = stage(spark, chained, str(tmp_path)), stage(spark, empty, str(tmp_path))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert set(clash) <= set(chained.columns) and ids(chained) == ids(out) and ids(empty) == []
