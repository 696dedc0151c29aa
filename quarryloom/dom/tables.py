"""Tables: one plain grid for Markdown, and those that content extraction lost put back."""

from __future__ import annotations

import re
from html import escape
from typing import NamedTuple

from quarryloom.dom.tree import BLOCK, HEADINGS, Node, body_of, parse

MAX_SPAN, PROBES, PROBE_CHARS, PROBE_CUT, ANCHOR_CHARS = 1000, 3, 8, 60, 30  # fixed values


def squeeze(text: str) -> str:
    return " ".join(text.split())


def rows_of(table: Node) -> list[Node]:
    """Its own rows, not those of tables inside."""
    return [r for r in table.find_all("tr") if next(a for a in r.ancestors() if a.tag == "table") is table]


def cells_of(row: Node) -> list[Node]:
    return [c for c in row.elements() if c.tag in ("td", "th")]


def _span(cell: Node, name: str) -> int:
    found = re.match(r"\s*(\d+)", cell.get(name))
    return max(1, min(int(found[1]), MAX_SPAN)) if found else 1


class Cell(NamedTuple):
    html: str
    header: bool
    row: int
    col: int


def grid_of(table: Node) -> list[list[Cell | None]]:
    """Cells by row and column, spans filled in with the cell they come from."""
    rows = rows_of(table)
    at: dict[tuple[int, int], Cell] = {}
    for r, row in enumerate(rows):
        c = 0
        for cell in cells_of(row):
            while (r, c) in at:
                c += 1
            held = Cell(cell.html(outer=False).strip(), cell.tag == "th", r, c)
            for dr in range(min(_span(cell, "rowspan"), len(rows) - r)):
                for dc in range(_span(cell, "colspan")):
                    at.setdefault((r + dr, c + dc), held)
            c += _span(cell, "colspan")
    width = max((c for _, c in at), default=-1) + 1
    return [[at.get((r, c)) for c in range(width)] for r in range(len(rows))]


def normalise(table: Node) -> None:
    """The table becomes a caption, one header row and data rows of equal length, without spans.

    Leading rows of one full-width header cell are the caption. Following rows of header cells only, two at
    least, are one header: what stands above each other is joined by a space, repeats left out. That needs
    data rows below; a data cell's content stands at its first place only."""
    grid = grid_of(table)
    if not grid or not grid[0]:
        return
    width = len(grid[0])
    captions = [c.html(outer=False).strip() for c in table.elements() if c.tag == "caption"]
    whole = lambda row: all(c is not None and c == row[0] for c in row)
    start = 0
    while start < len(grid) and width > 1 and whole(grid[start]) and grid[start][0].header:
        start += 1
    labels, start = ([row[0].html for row in grid[:start]], start) if start < len(grid) else ([], 0)
    head = start
    header_row = lambda row: all(c is not None and c.header for c in row) and len({(c.row, c.col) for c in row}) >= 2
    while head < len(grid) and header_row(grid[head]):
        head += 1
    if head >= len(grid):  # nothing but headers: the first one heads the rest
        head = min(start + 1, len(grid)) if head > start else start
    out = ["<table>"]
    if captions or labels:
        out.append(f"<caption>{' '.join(dict.fromkeys([*captions, *labels]))}</caption>")
    if head > start:
        names = []
        for c in range(width):
            above = [grid[r][c] for r in range(start, head)]
            names.append(" ".join(dict.fromkeys(x.html for x in above if x is not None and x.html)))
        out.append("<thead><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr></thead>")
    body = []
    for r in range(head, len(grid)):
        body.append("<tr>" + "".join(f"<td>{x.html if x is not None and (x.row, x.col) == (r, c) else ''}</td>" for c, x in enumerate(grid[r])) + "</tr>")
    if body:
        out.append("<tbody>" + "".join(body) + "</tbody>")
    fresh = body_of(parse("".join([*out, "</table>"]))).elements()[0]
    table.children = []
    for child in fresh.children:
        table.append(child)
    table.attrs = {}


def _inline_blocks(cell: Node) -> None:
    """Block elements in a cell become their content, a space after each."""
    for n in sorted(cell.below(), key=lambda n: -sum(1 for _ in n.ancestors())):
        if n.parent is None or n.tag not in BLOCK or n.tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"):
            continue
        at = n.parent.index(n)
        for c in n.children:
            if isinstance(c, Node):
                c.parent = n.parent
        n.parent.children[at : at + 1] = [*n.children, " "]


def normalise_all(root: Node) -> int:
    """Inlines blocks in cells everywhere, and normalises outermost tables that need it: with spans, or more
    than one header row."""
    done = 0
    for cell in root.find_all("td", "th"):
        _inline_blocks(cell)
    for table in root.find_all("table"):
        if table.within(("table",)) or table.parent is None:
            continue
        rows = rows_of(table)
        spans = any("colspan" in c.attrs or "rowspan" in c.attrs for r in rows for c in cells_of(r))
        heads = sum(bool(cells_of(r)) and all(c.tag == "th" for c in cells_of(r)) for r in rows)
        if spans or heads > 1:
            normalise(table)
            done += 1
    return done


class Lost(NamedTuple):
    html: str
    probes: list[str]
    anchor: str | None
    anchor_is_heading: bool


def collect(root: Node) -> list[Lost]:
    """Outermost data tables (two rows and columns at least) with probes of their longest cells and the
    nearest heading before them, else the nearest paragraph."""
    seq = [n for n in root.below() if n.tag in HEADINGS or n.tag in ("p", "table")]
    out = []
    for i, n in enumerate(seq):
        if n.tag != "table" or n.within(("table",)):
            continue
        rows = rows_of(n)
        if len(rows) < 2 or max((len(cells_of(r)) for r in rows), default=0) < 2:
            continue
        texts = list(dict.fromkeys(t for r in rows for c in cells_of(r) if (t := squeeze(c.text()))))
        long = [t for t in texts if len(t) >= PROBE_CHARS]
        picked = sorted(long or texts, key=lambda t: -len(t))[: PROBES if long else 1]
        heading = paragraph = None
        for b in reversed(seq[:i]):
            text = squeeze(b.text())
            if b.tag in HEADINGS and text:
                heading = text
                break
            if b.tag == "p" and paragraph is None and len(text) >= ANCHOR_CHARS:
                paragraph = text
        out.append(Lost(n.html(), [t[:PROBE_CUT] for t in picked], heading or paragraph, heading is not None))
    return out


def is_present(lost: Lost, text: str) -> bool:
    """Does most of its probes stand in the text? A table without probes counts as present."""
    n = len(lost.probes)
    return not n or sum(p in text for p in lost.probes) >= n // 2 + 1


def reinsert(content: Node, lost: list[Lost]) -> int:
    """Puts absent tables after their anchor, else at the end; how many."""
    text, done = squeeze(content.text()), 0
    for t in lost:
        if is_present(t, text):
            continue
        node = body_of(parse(t.html)).elements()[0]
        anchor = None
        if t.anchor:
            for n in content.below():
                own = squeeze(n.text()) if n.tag in HEADINGS or n.tag == "p" else ""
                if own and (n.tag in HEADINGS and own == t.anchor if t.anchor_is_heading else n.tag == "p" and t.anchor in own):
                    anchor = n
                    break
        if anchor is None:
            content.append(node)
        else:
            node.parent = anchor.parent
            anchor.parent.children.insert(anchor.parent.index(anchor) + 1, node)
        done += 1
    return done


class LostHeading(NamedTuple):
    level: int
    text: str
    anchors: list[tuple[str, bool]]  # text, is it a paragraph


HEADING_ANCHORS, ANCHOR_CUT = 4, 80  # fixed values


def collect_headings(root: Node) -> list[LostHeading]:
    """h2 to h6 with texts that follow, up to the next heading that is not below: paragraphs or other blocks
    of ANCHOR_CHARS at least, the first paragraph last."""
    kinds = HEADINGS | {"p", "div", "li", "td", "dd", "blockquote", "pre", "figcaption"}
    seq = [n for n in root.below() if n.tag in kinds]
    out = []
    for i, n in enumerate(seq):
        text = squeeze(n.text())
        if n.tag not in HEADINGS or n.tag == "h1" or not text:
            continue
        level, anchors = int(n.tag[1]), []
        for b in seq[i + 1 :]:
            if b.tag in HEADINGS:
                if int(b.tag[1]) <= level:
                    break
                continue
            if any(c.tag in kinds for c in b.below()):
                continue
            own = squeeze(b.text())
            if len(own) >= ANCHOR_CHARS:
                anchors.append((own[:ANCHOR_CUT], b.tag == "p"))
                if b.tag == "p" or len(anchors) >= HEADING_ANCHORS:
                    break
        out.append(LostHeading(level, text, anchors))
    return out


def reinsert_headings(content: Node, lost: list[LostHeading]) -> int:
    """Puts headings whose text is in no heading before the first of their anchors that is there; how many.
    Of equal texts the first counts; of headings with one anchor the earlier stands first."""
    have = {squeeze(h.text()) for h in content.find_all(*HEADINGS)}
    done = 0
    for h in lost:
        if h.text in have:
            continue
        target = None
        for text, paragraph in h.anchors:
            for n in content.below():
                if n.tag in HEADINGS:
                    continue
                if paragraph:
                    hit = n.tag == "p" and squeeze(n.text()).startswith(text)
                else:
                    hit = n.tag in BLOCK and n.tag != "body" and "".join(text.split()) in "".join(n.text().split()) and not any("".join(text.split()) in "".join(c.text().split()) for c in n.elements())
                if hit:
                    target = n
                    break
            if target is not None:
                break
        have.add(h.text)
        if target is None:
            continue
        node = body_of(parse(f"<h{h.level}>{escape(h.text, quote=False)}</h{h.level}>")).elements()[0]
        node.parent = target.parent
        target.parent.children.insert(target.parent.index(target), node)
        done += 1
    return done
