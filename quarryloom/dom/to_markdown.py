"""A tree as Markdown: ATX headings, fenced code, tables with pipes."""

from __future__ import annotations

import re

from quarryloom.dom.tables import cells_of, rows_of
from quarryloom.dom.tree import BLOCK, HEADINGS, Node

_SKIP = frozenset("script style noscript template head iframe object embed svg canvas audio video select option button input textarea".split())
_SPECIAL = re.compile(r"([\\`*_\[\]])")


def _inline(node: Node, pre: bool = False) -> str:
    out: list[str] = []
    for c in node.children:
        if isinstance(c, str):
            out.append(_SPECIAL.sub(r"\\\1", re.sub(r"\s+", " ", c)))
        elif c.tag in _SKIP:
            continue
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "img":
            if c.get("src"):
                out.append(f"![{c.get('alt')}]({c.get('src')})")
        elif c.tag in ("code", "kbd", "samp", "tt"):
            code = re.sub(r"\s+", " ", c.text())
            fence = "`" * (max((len(m) for m in re.findall("`+", code)), default=0) + 1)
            out.append(f"{fence}{code}{fence}" if code.strip() else "")
        else:
            inner = _inline(c)
            text = inner.strip()
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}.get(c.tag)
            if mark and text:
                lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
                out.append(f"{lead}{mark}{text}{mark}{tail}")
            elif c.tag == "a" and c.get("href") and text:
                out.append(f"[{text}]({c.get('href')})")
            else:
                out.append(inner)
    return "".join(out)


def _tidy(text: str) -> str:
    return re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", text.replace("  \n", "\x00"))).replace("\x00", "  \n").strip()


def _code(node: Node) -> str:
    code = node.text().strip("\n")
    lang = next((m[1] for n in [node, *node.elements()] if (m := re.search(r"(?:language|lang)-([\w+#-]+)", n.get("class")))), "")
    fence = "`" * max(3, max((len(m) for m in re.findall("`+", code)), default=0) + 1)
    return f"{fence}{lang}\n{code}\n{fence}"


def _table(node: Node) -> str:
    rows = [[re.sub(r"\s+", " ", _inline(c)).strip().replace("|", "\\|") for c in cells_of(r)] for r in rows_of(node)]
    rows = [r for r in rows if r]
    caption = next((_tidy(_inline(c)) for c in node.elements() if c.tag == "caption"), "")
    if not rows:
        return caption
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n".join([caption, ""] * bool(caption) + lines)


def _list(node: Node, depth: int) -> str:
    out, n = [], int(node.get("start")) if node.get("start").isdigit() else 1
    for item in node.elements():
        if item.tag != "li":
            continue
        mark = f"{n}." if node.tag == "ol" else "-"
        n += 1
        body = "\n\n".join(_blocks(item, depth + 1)) if any(c.tag in BLOCK for c in item.elements()) else _tidy(_inline(item))
        body = re.sub(r"\n\n(?=\s*(?:-|\d+\.) )", "\n", body)
        out.append(f"{mark} " + body.replace("\n", "\n" + " " * (len(mark) + 1)))
    return "\n".join(out)


def _blocks(node: Node, depth: int = 0) -> list[str]:
    out: list[str] = []
    loose = Node("span")

    def flush() -> None:
        text = _tidy(_inline(loose))
        if text:
            out.append(text)
        loose.children = []

    for c in node.children:
        if isinstance(c, str) or (c.tag not in BLOCK and (depth > 200 or not any(d.tag in BLOCK for d in c.below()))):
            loose.children.append(c)
            continue
        flush()
        if c.tag in _SKIP:
            continue
        if c.tag in HEADINGS:
            text = re.sub(r"\s+", " ", _inline(c)).strip()
            if text:
                out.append(f"{'#' * int(c.tag[1])} {text}")
        elif c.tag == "pre":
            out.append(_code(c))
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag in ("ul", "ol"):
            out.append(_list(c, depth))
        elif c.tag == "blockquote":
            out.append("\n".join(f"> {x}".rstrip() for x in "\n\n".join(_blocks(c, depth + 1)).split("\n")))
        elif c.tag == "hr":
            out.append("* * *")
        else:
            out.extend(_blocks(c, depth + 1))
    flush()
    return [b for b in out if b.strip()]


def to_markdown(node: Node) -> str:
    return "\n\n".join(_blocks(node))
