"""What is cut out of a tree before its content is read."""

from __future__ import annotations

import re
import unicodedata

from quarryloom.dom.tree import Node
from quarryloom.functions.text import LETTER_WEIGHT, LINK_WEIGHT, PUNCTUATION_WEIGHT

# fixed values: texts and names of consent banners
BANNER_TEXTS = [
    r"同意して閉じる", r"同意する", r"(?i)Cookie.{0,10}(の使用に|に)?同意", r"このサイトはCookieを使用", r"アプリで(開く|見る|読む)", r"アプリをダウンロード",
    r"アプリ内で開く", r"ストアで見る", r"(?i)App Store|Google Play.{0,10}(で|から)開く",
]
BANNER_NAMES = r"cookie|consent|cmp[-_]|gdpr|app[-_]?banner|interstitial|smart-?banner"
BANNER_CHARS, PRUNE_CHARS = 400, 20
_BANNER = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in BANNER_TEXTS))
_NAMES = re.compile(BANNER_NAMES, re.I)
_MARKS = re.compile("[、。!?！.,]")


def strip_styles(root: Node) -> int:
    """style and script outside pre and code."""
    gone = [n for n in root.find_all("style", "script") if not n.within(("pre", "code"))]
    for n in gone:
        n.remove()
    return len(gone)


def strip_noscript(root: Node) -> int:
    gone = [n for n in root.find_all("noscript") if not n.within(("pre", "code"))]
    for n in gone:
        n.remove()
    return len(gone)


def strip_ruby(root: Node) -> int:
    """Readings above characters."""
    gone = root.find_all("rt", "rp")
    for n in gone:
        n.remove()
    return len(gone)


def strip_banners(root: Node) -> int:
    """Short elements that both are named like a consent banner and read like one."""
    gone = 0
    for n in root.find_all("div", "section", "aside", "dialog"):
        if n.parent is None:
            continue
        text = n.text()
        if 0 < len(text) <= BANNER_CHARS and _NAMES.search(f"{n.get('id')} {n.get('class')}") and _BANNER.search(text):
            n.remove()
            gone += 1
    return gone


def score_block(text: str, link_text: str) -> float:
    body = text.strip()
    n = len(body)
    if not n:
        return 0.0
    letters = sum(unicodedata.category(c)[0] in "LM" for c in body)
    return len(_MARKS.findall(body)) / n * PUNCTUATION_WEIGHT + letters / n * LETTER_WEIGHT - min(len(link_text.strip()) / n, 1.0) * LINK_WEIGHT


def prune(root: Node) -> int:
    """Drops menus and blocks that read like link lists; how many, without those inside a dropped one.

    nav, footer and form always go; header and aside unless in an article, section or main, where they stay as
    they are with all that is in them; then, children before parents, div, section, ul and ol of PRUNE_CHARS or
    more whose score is negative."""
    dropped: dict[int, int] = {}  # element -> drops below it, which its own drop replaces
    count = 0
    spared = {id(n) for n in root.below() if n.tag in ("header", "aside") and n.within(("article", "section", "main"))}
    apart = {id(n) for n in root.below() if any(id(a) in spared for a in n.ancestors())} | spared
    for n in list(root.below()):
        if id(n) in apart:
            continue
        if n.tag in ("nav", "footer", "form") or (n.tag in ("header", "aside") and not n.within(("article", "section", "main"))):
            if all(id(a) not in dropped for a in n.ancestors()):
                dropped[id(n)] = 0
                count += 1
    for n in list(root.below()):
        if id(n) in dropped:
            n.remove()
    below: dict[int, int] = {}
    for n in reversed(list(root.below())):
        if n.parent is None:
            continue
        inner = below.pop(id(n), 0)
        parent = id(n.parent)
        bad = False
        if id(n) not in apart and n.tag in ("div", "section", "ul", "ol"):
            text = n.text()
            bad = len(text.strip()) >= PRUNE_CHARS and score_block(text, "".join(a.text() for a in n.find_all("a"))) < 0
        below[parent] = below.get(parent, 0) + (1 if bad else inner)
        count += 1 - inner if bad else 0
        if bad:
            n.remove()
    return count
