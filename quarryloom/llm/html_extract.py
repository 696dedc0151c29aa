"""Main text of web pages by tag-path ratios.

Every text node belongs to a block and the block to a container; both are known by their root-to-leaf
tag paths (element names with their classes, formatting elements left out). For each path the text
length, the punctuation and the length of link texts are summed over its nodes. A path's ratio is its
plain text per node; it is smoothed with the ratio of its container, so that a heading or a one-word
paragraph counts as what surrounds it, and fused with punctuation per node. Containers whose fused mass
reaches THRESHOLD of the best one's, and all that lies inside them, are content. So is

- all of an article or main element that directly holds such a container (its title, a short introduction,
  lists of links);
- what stands beside a content container, under one parent, and has BESIDE of the best ratio;
- a heading right before content, in an element around it.

Elements that say what they are take no part: menus, footers, asides, forms and the like by their tag or
role; adverts, notices, comments and the like by a class or id. A class says so as a whole word, or by the
last of its words that is not a mere "box" or "list"; a comment section also by its first heading. Neither
class nor heading counts for an element that holds over HALF of the page's text.

Nulls and odd rows: null, empty or textless html gives an empty text; any malformed markup gives a tree;
repeated rows are each extracted; columns of any name pass through, and where there is one of the name
asked for, the text's gets a number at its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.dom.tree import BLOCK, Node, body_of, parse
from quarryloom.llm.common import fresh, table

THRESHOLD, BESIDE, HALF = 0.15, 0.2, 0.5
OUT = frozenset(
    "nav footer aside form script style noscript template iframe object embed svg canvas audio video select"
    " option button input textarea label fieldset dialog menu head title map xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: What a class or id may say an element is, and words after it that say nothing.
SAYS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner"
    " cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login"
    " menu menus nav navbar navigation navi breadcrumb breadcrumbs crumbs pagination pager sidebar side aside footer foot masthead"
    " topbar toolbar header share sharing social related recommended recommendations comment comments commentlist replies reply"
    " disqus respond discussion widget widgets search skip copyright tags taglist".split()
)
MERE = frozenset(
    "a area bar block body bottom box col column container content desktop fixed group holder inner item items left link links list main"
    " mobile module outer panel right row section side slot small sticky text thread title top unit wrap wrapper".split()
)
_HEADS = frozenset(["header", "masthead", "banner"])  # inside an article these hold its title
_COMMENTS = re.compile(
    r"\W*(?:\d+\s+|(?:all|reader|readers|user|leave|post|add|write|join)\s+(?:a\s+|your\s+|the\s+)?|['’]\s+)*"
    r"(?:comments?|replies|reply|responses|discussion|conversation|kommentare?|commentaires?|comentarios?|commenti)\b\W*(?:\(?\d+\)?)?\W*",
    re.I,
)
_WORDS = re.compile(r"[^\W_\d]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…¿¡、。！，？]")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _said(node: Node) -> set[str]:
    """Which of SAYS the classes and the id of an element say."""
    found = set()
    for name in f"{node.get('class')} {node.get('id')}".split():
        words = [w.lower() for w in _WORDS.findall(_CAMEL.sub("-", name))]
        while len(words) > 1 and words[-1] in MERE and not (len(words) == 2 and words[0] not in SAYS):
            words.pop()
        if words and words[-1] in SAYS:
            found.add(words[-1])
    return found


def _sizes(body: Node) -> dict[int, int]:
    """Characters of text, but for white space at their ends, in every element."""
    sizes: dict[int, int] = {}
    stack: list[tuple[Node, bool]] = [(body, False)]
    while stack:
        node, done = stack.pop()
        if node.tag in ("script", "style", "noscript", "template"):
            sizes[id(node)] = 0
        elif done:
            sizes[id(node)] = sum(len(c.strip()) if isinstance(c, str) else sizes[id(c)] for c in node.children)
        else:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if not isinstance(c, str))
    return sizes


def _first_heading(node: Node) -> str:
    """Text of the heading that an element begins with; empty if it begins with something else."""
    while True:
        inner = next((c for c in node.children if not isinstance(c, str) or c.strip()), None)
        if inner is None or isinstance(inner, str):
            return ""
        if inner.tag in _HEADING:
            parts, stack = [], [inner]
            while stack:
                item = stack.pop()
                if isinstance(item, str):
                    parts.append(item)
                else:
                    stack.extend(reversed(item.children))
            return " ".join("".join(parts).split())
        node = inner


def _boilerplate(node: Node, in_article: bool, large: bool) -> bool:
    """large: the element holds most of the page's text."""
    if node.tag in OUT or node.tag == "header" and not in_article:
        return True
    if node.attrs and ("hidden" in node.attrs or node.get("aria-hidden") == "true" or node.get("role") in ROLES):
        return True
    if large or node.tag in ("main", "body"):
        return False
    said = _said(node) if node.attrs else set()
    if node.tag == "article":
        return bool(said & {"comment", "comments", "reply", "replies"})
    if said - _HEADS if in_article else said:
        return True
    return node.tag in ("section", "div", "ol", "ul") and bool((head := _first_heading(node)) and _COMMENTS.fullmatch(head))


class _Paths:
    """Root-to-leaf tag paths as numbers, so that depth costs nothing: each knows its parent's."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parent: list[int] = []

    def of(self, parent: int, name: str) -> int:
        n = self.known.setdefault((parent, name), len(self.parent))
        if n == len(self.parent):
            self.parent.append(parent)
        return n


class _Block(NamedTuple):
    container: int  # path
    path: int
    text: str
    linked: int  # characters in links
    region: int  # the article or main element around it, -1 if none
    heading: bool
    parents: tuple  # chain of the elements around it, innermost first: (number, chain)


def _blocks(body: Node, paths: _Paths) -> list[_Block]:
    """Every block with text, in page order."""
    out: list[_Block] = []
    sizes = _sizes(body)
    most = HALF * sizes[id(body)]
    top = paths.of(-1, "body")
    # (node, path of its block, path of its container, in a link, region, heading, chain), or None where a block ends
    stack: list = [(body, top, top, False, -1, False, (0, None))]
    begun: tuple = ()
    texts: list[tuple[str, bool]] = []
    n = 0

    def close() -> None:
        if text := " ".join("".join(t for t, _ in texts).split()):
            out.append(_Block(begun[0], begun[1], text, sum(len(" ".join(t.split())) for t, link in texts if link), *begun[2:]))
        texts.clear()

    while stack:
        item = stack.pop()
        if item is None:
            close()
            continue
        node, its_block, its_container, link, region, heading, chain = item
        if isinstance(node, str):
            if not texts:
                begun = (its_container, its_block, region, heading, chain)
            texts.append((node, link))
            continue
        if node.tag == "br" or node.tag == "hr":
            texts.append((" ", False)) if texts else None
            continue
        if node.tag != "body" and _boilerplate(node, region >= 0, sizes[id(node)] > most):
            continue
        n += 1
        if node.tag in ("article", "main"):
            region = n
        if node.tag in BLOCK and node.tag != "body":
            its_container, its_block = its_block, paths.of(its_block, ".".join([node.tag, *sorted(node.get("class").split())]))
            heading = node.tag in _HEADING
            chain = (n, chain)
            close()
            stack.append(None)
        elif node.tag == "a":
            link = True
        stack.extend((c, its_block, its_container, link, region, heading, chain) for c in reversed(node.children))
    close()
    return out


def _fused(s: list[int]) -> float:
    """Plain text a node (links count against it), with punctuation a node. s: nodes, length, punctuation, links."""
    return max(0, s[1] - 2 * s[3]) / s[0] * (1 + s[2] / s[0]) ** 0.5


def main_text(html: str | None) -> str:
    paths = _Paths()
    blocks = _blocks(body_of(parse(html)), paths)
    if not blocks:
        return ""
    by_path: dict[int, list[int]] = {}
    by_container: dict[int, list[int]] = {}
    for b in blocks:
        marks = len(_PUNCT.findall(b.text))
        for key, sums in ((b.path, by_path), (b.container, by_container)):
            s = sums.setdefault(key, [0, 0, 0, 0])
            for i, x in enumerate((1, len(b.text), marks, b.linked)):
                s[i] += x
    score = {p: _fused(s) for p, s in by_path.items()}
    around = {c: _fused(s) for c, s in by_container.items()}
    ratio = [(score[b.path] + around[b.container]) / 2 for b in blocks]
    mass: dict[int, float] = {}
    for b, r in zip(blocks, ratio):
        mass[b.container] = mass.get(b.container, 0) + max(0, len(b.text) - 2 * b.linked) * r
    best = max(mass.values())
    if best <= 0:
        return ""
    content = {c for c, m in mass.items() if m >= THRESHOLD * best}
    inside: list[bool] = []  # of each path: is it, or lies it in, a content container other than the body itself
    for n, parent in enumerate(paths.parent):
        inside.append(n in content and parent >= 0 or parent >= 0 and inside[parent])
    regions = {b.region for b in blocks if b.container in content and b.region >= 0}
    beside = {b.parents[1][1][0] for b in blocks if b.container in content and b.parents[1] and b.parents[1][1]}
    dense = max(r for b, r in zip(blocks, ratio) if b.container in content)

    def kept(b: _Block, r: float) -> bool:
        if b.region in regions:
            return True
        if b.container in content:
            return r > 0
        if inside[b.container]:
            return by_path[b.path][3] <= 0.5 * by_path[b.path][1]
        near = b.parents[1] and b.parents[1][1] and b.parents[1][1][0] in beside
        return bool(near) and r >= BESIDE * dense and 2 * b.linked <= len(b.text)

    keep = [kept(b, r) for b, r in zip(blocks, ratio)]
    for i in range(len(blocks) - 2, -1, -1):  # headings right before content, in an element around it
        if not keep[i] and keep[i + 1] and blocks[i].heading and blocks[i].parents[1]:
            chain, holder = blocks[i + 1].parents, blocks[i].parents[1][0]
            while chain is not None and chain[0] != holder:
                chain = chain[1]
            keep[i] = chain is not None
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages, all columns but html, with the main text of each in a column more."""
    keep = [c for c in pages.columns if c != html]
    into = fresh(pages.drop(html), into)
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(into, T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, into])

    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html)).mapInArrow(of, schema)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
