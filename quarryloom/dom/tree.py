"""A tolerant HTML tree builder.

One regular expression cuts the source into comments, raw elements, tags and text, in linear time; end
tags that HTML lets authors leave out are implied. Text nodes are plain strings with their character
references decoded. Nothing here recurses, so depth is bounded by memory only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
BLOCK = CLOSES_P | frozenset("li dt dd tr td th thead tbody tfoot caption body html option optgroup summary legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends the nearest open element of these names, unless a fence is nearer.
_ROWS, _CELLS = frozenset(["thead", "tbody", "tfoot"]), frozenset(["td", "th"])
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "td": (_CELLS, frozenset(["tr", "table"])),
    "th": (_CELLS, frozenset(["tr", "table"])),
    "thead": (_ROWS | {"caption"}, frozenset(["table"])),
    "tbody": (_ROWS | {"caption"}, frozenset(["table"])),
    "tfoot": (_ROWS | {"caption"}, frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["optgroup"]), frozenset(["select"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
P_FENCE = frozenset("td th table button object applet marquee caption html".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/><]*)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/><]*)(?P<attrs2>[^<>]*+)>?",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in RAW | RCDATA}


class Node:
    """An element. children holds Nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def append(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def index(self, child: Node) -> int:
        return next(i for i, c in enumerate(self.children) if c is child)

    def remove(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.parent.index(self)]
            self.parent = None

    def iter(self) -> Iterator[Node]:
        """This element and those below it, in document order. Children may be changed once they came."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def below(self) -> Iterator[Node]:
        found = self.iter()
        next(found)
        return found

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.below() if n.tag in tags]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def within(self, tags) -> bool:
        return any(a.tag in tags for a in self.ancestors())

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack.extend(reversed(node.children))

    def text(self) -> str:
        return "".join(self.strings())

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def html(self, outer: bool = True) -> str:
        out: list[str] = []
        stack: list[Node | str | tuple[str]] = [self] if outer else list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, str):
                out.append(escape(node, quote=False))
            else:
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
                out.append(f"<{node.tag}{attrs}>")
                if node.tag in RAW:
                    out.append(f"{node.text()}</{node.tag}>")
                elif node.tag not in VOID:
                    stack.append((f"</{node.tag}>",))
                    stack.extend(reversed(node.children))
        return "".join(out)


def attributes(source: str) -> dict[str, str]:
    if not source or source.isspace() or source == "/":
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        value = a or b or c
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def parse(source: str | None) -> Node:
    """The html element; it has a head and a body, empty ones where the source has none."""
    root = Node("html")
    head, body = Node("head"), Node("body")
    root.append(head)
    root.append(body)
    if not source:
        return root
    stack: list[Node] = [root, body]
    opened: Counter[str] = Counter()  # how many elements of a name are open, so that most searches need no walk
    in_head = False

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            if "&" in text:
                text = unescape(text)
            if in_head and not text.isspace():
                in_head = False
                pop_to(1)
                stack.append(body)
            if len(stack) > 1 or not text.isspace():
                stack[-1].children.append(text)
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in ("html", "body"):
                continue
            if tag == "head":
                if in_head:
                    in_head = False
                    pop_to(1)
                    stack.append(body)
                continue
            if tag == "br":
                stack[-1].append(Node("br"))
                continue
            if opened[tag] <= 0:
                if tag == "p":
                    stack[-1].append(Node("p"))
                continue
            for depth in range(len(stack) - 1, 1, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
                if stack[depth].tag in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        attrs = attributes(m["attrs"] if m["tag"] else m["attrs2"])
        if tag in ("html", "body", "head"):
            mine = {"html": root, "body": body, "head": head}[tag]
            for k, v in attrs.items():
                mine.attrs.setdefault(k, v)
            if tag == "head" and not body.children:
                in_head = True
                pop_to(1)
                stack.append(head)
            elif tag == "body" and in_head:
                in_head = False
                pop_to(1)
                stack.append(body)
            continue
        if in_head and tag not in HEAD_ONLY and stack[-1] is head:
            in_head = False
            pop_to(1)
            stack.append(body)
        if tag in CLOSES_P and opened["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag in P_FENCE:
                    break
        if tag in IMPLIED:
            ends, fence = IMPLIED[tag]
            if any(opened[t] > 0 for t in ends):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in ends:
                        pop_to(depth)
                        break
                    if stack[depth].tag in fence:
                        break
        elif tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop_to(len(stack) - 1)
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW or tag in RCDATA:
            end = _RAW_END[tag].search(source, at)
            inside = source[at : end.start()] if end else source[at:]
            at = end.end() if end else n
            if inside:
                node.children.append(inside if tag in RAW else unescape(inside))
        elif tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    return root


def body_of(root: Node) -> Node:
    return next(c for c in root.children if isinstance(c, Node) and c.tag == "body")
