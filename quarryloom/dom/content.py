"""From a page's HTML to the Markdown of its main content, with what quality is judged by."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit

from quarryloom.dom import clean, tables
from quarryloom.dom.select import select
from quarryloom.dom.to_markdown import to_markdown
from quarryloom.dom.tree import BLOCK, Node, body_of, parse
from quarryloom.functions.cjk import normalise_cjk

# fixed values: sites whose content has a known place
ADAPTERS = [
    ("qiita", r"(^|\.)qiita\.com$", [".it-MdContent", "article"], []),
    ("zenn", r"(^|\.)zenn\.dev$", [".znc", "article"], []),
    ("note", r"(^|\.)note\.com$", [".note-common-styles__textnote-body", ".p-article__body", "article"], []),
    ("hatenablog", r"(^|\.)hatenablog\.com$|(^|\.)hateblo\.jp$", [".entry-content", "article"], [".hatena-module-ad", ".advertisement-unit"]),
    ("yahoo-news", r"(^|\.)news\.yahoo\.co\.jp$", [".article_body", "article#uamods", "article"], []),
    ("prtimes", r"(^|\.)prtimes\.jp$", ["#press-release-body", "article"], []),
]
MIN_CHARS, IMAGE_PAGE = 200, 1280 * 1080  # fixed values
_UNLIKELY = re.compile(r"\b(ad|ads|banner|breadcrumb|combx|comment|community|cookie|disqus|extra|foot|footer|header|menu|nav|pager|pagination|popup|related|remark|rss|share|shoutbox|sidebar|skyscraper|social|sponsor|subscribe)\b", re.I)


def adapter_for(host: str):
    return next((a for a in ADAPTERS if re.search(a[1], host or "", re.I)), None)


def _readable(body: Node) -> Node | None:
    """The element whose paragraphs hold the most prose: each paragraph scores by length and commas for its
    parent, and half for its grandparent; link density scales an element down."""
    scores: dict[int, list] = {}
    for p in body.below():
        if p.tag not in ("p", "pre", "td", "blockquote", "li", "dd") and not (p.tag == "div" and not any(c.tag in BLOCK for c in p.elements())):
            continue
        text = tables.squeeze(p.text())
        if len(text) < 25:
            continue
        value = 1 + len(re.findall("[,、，。.]", text)) + min(len(text) // 100, 3)
        for n, share in ((p.parent, 1.0), (p.parent.parent if p.parent else None, 0.5)):
            if n is not None and n.tag != "html":
                scores.setdefault(id(n), [n, 0.0])[1] += value * share
    best, top = None, 0.0
    for n, value in scores.values():
        text = n.text()
        linked = sum(len(a.text()) for a in n.find_all("a"))
        value *= 1 - min(linked / max(len(text), 1), 1.0)
        if n.tag in ("article", "main") or re.search(r"\b(article|body|content|entry|main|post|text)\b", f"{n.get('class')} {n.get('id')}", re.I):
            value *= 1.25
        if value > top:
            best, top = n, value
    return best


def readable(body: Node) -> Node | None:
    """A copy of the main content with MIN_CHARS of text at least; headings and tables that the choice lost
    are put back."""
    lost, heads = tables.collect(body), tables.collect_headings(body)
    work = copy_tree(body)
    for n in list(work.below()):
        if n.parent is not None and n.tag not in ("article", "main", "body") and _UNLIKELY.search(f"{n.get('class')} {n.get('id')}".replace("-", " ").replace("_", " ")):
            n.remove()
    clean.prune(work)
    found = _readable(work)
    if found is None or len(found.text().strip()) < MIN_CHARS:
        return None
    found = copy_tree(found)
    tables.reinsert_headings(found, heads)
    if tables.reinsert(found, lost):
        tables.reinsert_headings(found, heads)
    return found


def copy_tree(node: Node) -> Node:
    top = Node(node.tag, dict(node.attrs))
    stack = [(node, top)]
    while stack:
        old, new = stack.pop()
        for c in old.children:
            if isinstance(c, str):
                new.children.append(c)
            else:
                twin = Node(c.tag, dict(c.attrs), new)
                new.children.append(twin)
                stack.append((c, twin))
    return top


def _number(text: str) -> float:
    m = re.match(r"\s*(\d+(?:\.\d+)?)", text)
    return float(m[1]) if m else 0.0


def statistics(body: Node) -> dict[str, float]:
    """What quality is judged by, over the whole body."""
    visible = leaves = 0
    counts = {"table_cells": 0, "canvases": 0, "svgs": 0, "images": 0, "images_without_alt": 0}
    area = 0.0
    stack: list = [body]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            visible += len("".join(n.split()))
            continue
        if n.tag in ("script", "style", "noscript"):
            continue
        kids = n.elements()
        if not kids:
            leaves += 1
        if n.tag in ("td", "th"):
            counts["table_cells"] += 1
        elif n.tag == "canvas":
            counts["canvases"] += 1
        elif n.tag == "svg":
            counts["svgs"] += 1
            continue
        elif n.tag == "img":
            counts["images"] += 1
            counts["images_without_alt"] += "alt" not in n.attrs
            area += _number(n.get("width")) * _number(n.get("height"))
        stack.extend(n.children)
    return {"visible_chars": visible, "leaves": leaves, **counts, "image_area": min(area / IMAGE_PAGE, 1.0)}


class Extracted(NamedTuple):
    title: str | None
    markdown: str | None
    method: str | None
    adapter: str | None
    pruned: int
    stats: dict[str, float]
    error_code: str | None
    links: list[tuple[str, str | None, int]] = []


def extract(html: str | None, url: str | None, selector: str | None = None, geometry_ids: list[str] | None = None, geometry_chars: int = 0, links: bool = False) -> Extracted:
    """geometry_ids: data-gid values of a rendered page's main column, geometry_chars its text length;
    links: of the whole page, too."""
    root = parse(html)
    body = body_of(root)
    listed = links_below(root, url) if links else []
    titles = root.find_all("title")
    title = tables.squeeze(titles[0].text()) if titles else ""
    clean.strip_styles(root)
    clean.strip_ruby(root)
    clean.strip_banners(root)
    stats = statistics(body)
    method = adapter = None
    pruned, holder = 0, Node("div")
    if selector:
        found = select(root, selector)
        if not found:
            return Extracted(title or None, None, None, None, 0, stats, "EXTRACTION_FAILED", listed)
        for n in found:
            holder.append(copy_tree(n))
            holder.append("\n")
        method = "selector"
    site = None if method else adapter_for(urlsplit(url or "").hostname or "")
    if site:
        for s in site[2]:
            if hits := select(root, s):
                holder.append(copy_tree(hits[0]))
                for r in site[3]:
                    for n in select(holder, r):
                        n.remove()
                pruned, method, adapter = clean.prune(holder), "adapter", site[0]
                break
    if not method and (best := readable(body)) is not None:
        holder.append(best)
        pruned, method = clean.prune(copy_tree(body)), "readability"
    if not method and geometry_ids and geometry_chars >= MIN_CHARS:
        wanted = set(geometry_ids)
        for n in [n for n in body.below() if n.get("data-gid") in wanted]:
            if not any(a.get("data-gid") in wanted for a in n.ancestors()):
                holder.append(copy_tree(n))
        method = "geometry" if holder.children else None
    if not method:
        holder.append(copy_tree(body))
        pruned, method = clean.prune(holder), "body-fallback"
    tables.normalise_all(holder)
    clean.strip_noscript(holder)
    return Extracted(title or None, normalise_cjk(to_markdown(holder)), method, adapter, pruned, stats, None, listed)


def spa_statistics(html: str | None) -> tuple[str | None, int, str, int, int]:
    """root id, characters in it, noscript text, characters of html and of visible text."""
    root = parse(html)
    body = body_of(root)
    mount = next((n for n in body.below() if n.get("id") in ("root", "app", "__next", "__nuxt")), None)
    said = " ".join(n.text() for n in root.find_all("noscript"))
    for n in root.find_all("script", "style", "noscript"):
        n.remove()
    inside = "".join(mount.text().split()) if mount is not None else ""
    return (mount.get("id") if mount is not None else None, len(inside), said, len(html or ""), len("".join(body.text().split())))


def page_links(html: str | None, base: str | None) -> list[tuple[str, str | None, int]]:
    """url, title, position of the links in a page: http(s) only, first of each url."""
    return links_below(parse(html), base)


def feed_link(html: str | None, base: str | None) -> str | None:
    """The first feed that a page's head names, RSS or Atom."""
    for n in parse(html).find_all("link"):
        if n.get("rel").lower() == "alternate" and n.get("type").lower() in ("application/rss+xml", "application/atom+xml") and n.get("href"):
            try:
                return urljoin(base or "", n.get("href").strip())
            except ValueError:
                return None
    return None


def links_below(root: Node, base: str | None) -> list[tuple[str, str | None, int]]:
    out: dict[str, tuple[str, str | None, int]] = {}
    for a in root.find_all("a"):
        href = a.get("href").strip()
        if not href or href.startswith("#") or href.lower().startswith("javascript:"):
            continue
        try:
            url = urljoin(base or "", href)
            parts = urlsplit(url)
        except ValueError:
            continue
        if parts.scheme not in ("http", "https") or not parts.netloc:
            continue
        out.setdefault(url, (url, tables.squeeze(a.text()) or None, len(out)))
    return list(out.values())
