"""A small selector engine: tag, #id, .class, [attr], [attr=value], descendant, child and comma."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from quarryloom.dom.tree import Node

_SIMPLE = re.compile(r"""([#.]?)([\w*-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]""")


class Part(NamedTuple):
    child: bool  # of the part before, not any descendant
    tag: str
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attrs: tuple[tuple[str, str, str], ...]


@lru_cache(maxsize=256)
def compiled(selector: str) -> tuple[tuple[Part, ...], ...]:
    out = []
    for one in selector.split(","):
        parts, child = [], False
        for token in re.findall(r">|[^\s>]*\[[^\]]*\][^\s>]*|[^\s>]+", one.strip()):
            if token == ">":
                child = True
                continue
            tag, ids, classes, attrs, at = "*", [], [], [], 0
            while at < len(token):
                m = _SIMPLE.match(token, at)
                if not m:
                    raise ValueError(f"selector not understood: {selector}")
                at = m.end()
                if m[3]:
                    attrs.append((m[3].lower(), m[4] or "", m[5] or m[6] or m[7] or ""))
                elif m[1] == "#":
                    ids.append(m[2])
                elif m[1] == ".":
                    classes.append(m[2])
                else:
                    tag = m[2].lower()
            parts.append(Part(child, tag, tuple(ids), tuple(classes), tuple(attrs)))
            child = False
        if not parts:
            raise ValueError(f"selector not understood: {selector}")
        out.append(tuple(parts))
    return tuple(out)


def _fits(node: Node, p: Part) -> bool:
    if p.tag not in ("*", node.tag):
        return False
    if any(node.get("id") != i for i in p.ids):
        return False
    if p.classes and not set(p.classes) <= set(node.get("class").split()):
        return False
    for name, how, value in p.attrs:
        if name not in node.attrs:
            return False
        have = node.attrs[name]
        ok = {"": True, "=": have == value, "~=": value in have.split(), "^=": have.startswith(value), "$=": have.endswith(value), "*=": value in have, "|=": have == value or have.startswith(f"{value}-")}
        if not ok[how]:
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    def from_part(n: Node, parts: tuple[Part, ...]) -> bool:
        if not _fits(n, parts[-1]):
            return False
        if len(parts) == 1:
            return True
        if parts[-1].child:
            return n.parent is not None and from_part(n.parent, parts[:-1])
        return any(from_part(a, parts[:-1]) for a in n.ancestors())

    return any(from_part(node, parts) for parts in compiled(selector))


def select(root: Node, selector: str) -> list[Node]:
    return [n for n in root.below() if matches(n, selector)]
