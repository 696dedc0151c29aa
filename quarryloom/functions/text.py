"""Text measures as Column functions: token estimates, block scores, excerpts, hashes.

Lengths are code points throughout. White space is the class of ECMAScript, spelled out, since Java's
`\\s` knows ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space other than the newline, and what counts as CJK for token estimates
BEYOND = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANK = r"\t\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = BLANK + r"\n"
CJK = (
    r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3001}-\x{303F}\x{FF01}-\x{FFEF}"
)
CJK_TOKENS, OTHER_CHARS = 0.9, 3.8  # tokens a CJK character; other characters a token
PUNCTUATION = r"[、。!?！.,]"
PUNCTUATION_WEIGHT, LETTER_WEIGHT, LINK_WEIGHT = 40.0, 1.0, 5.0
EXCERPT_CHARS = 80


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: an expression is computed as often as it is named, an element of
    an array is not."""
    return F.transform(F.array(value), then)[0]


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def trim(text: Column) -> Column:
    """Only a text that begins or ends with white space is searched."""
    edge = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1)).rlike(f"[{SPACE}]")
    return F.when(edge, F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")).otherwise(text)


def _cjk(text: Column) -> Column:
    """How many; a text of ASCII has none, which its length in bytes tells."""
    return F.when(F.octet_length(text) == F.length(text), 0).otherwise(count(text, f"[{CJK}]"))


def _blanks(text: Column) -> Column:
    """How many; the ASCII ones by what a text loses without them, which costs no regular expression."""
    without = text
    for c in " \n\t\r\f\x0b":
        without = F.replace(without, F.lit(c), F.lit(""))
    beyond = F.when(F.octet_length(text) == F.length(text), 0).otherwise(count(text, f"[{BEYOND}]"))
    return F.octet_length(text) - F.octet_length(without) + beyond


def char_classes(text: Column) -> Column:
    """struct(cjk, other, space): code points of each class."""
    cjk, space = _cjk(text), _blanks(text)
    return F.struct(cjk.alias("cjk"), (F.length(text) - cjk - space).alias("other"), space.alias("space"))


def estimate_tokens(text: Column) -> Column:
    cjk, space = _cjk(text), _blanks(text)
    other = F.length(text) - cjk - space
    return F.ceil(cjk * F.lit(CJK_TOKENS) + other / F.lit(OTHER_CHARS)).cast("long")


def block_score(text: Column, link_text: Column) -> Column:
    """struct(punctuation_density, letter_ratio, link_density, score): prose scores 0 or more, menus less."""

    def shares(b: Column) -> Column:
        body, n = b["body"], F.length(b["body"]).cast("double")
        some = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
        linked = F.least(some(F.length(b["links"])), F.lit(1.0))
        return F.struct(some(count(body, PUNCTUATION)).alias("m"), some(count(body, r"[\p{L}\p{M}]")).alias("l"), linked.alias("k"))

    def scored(s: Column) -> Column:
        score = s["m"] * PUNCTUATION_WEIGHT + s["l"] * LETTER_WEIGHT - s["k"] * LINK_WEIGHT
        return F.struct(s["m"].alias("punctuation_density"), s["l"].alias("letter_ratio"), s["k"].alias("link_density"), score.alias("score"))

    return bound(bound(F.struct(trim(text).alias("body"), trim(link_text).alias("links")), shares), scored)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def screenshot_key(url: Column, width: Column, scale: Column, full_page: Column) -> Column:
    """Numbers are written as JavaScript does: 1.0 as 1."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.sha2(F.concat(url, F.lit("|w="), number(width), F.lit("|s="), number(scale), F.lit("|full="), full_page.cast("string")), 256)


def strip_links(text: Column) -> Column:
    """Markdown images and links become their text."""
    images = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(images, r"\[([^\]]*)\]\([^)]*\)", "$1")


def excerpt(section: Column) -> Column:
    """First sentence of a section's text without headings, else its first line; EXCERPT_CHARS at most."""
    prose = F.array_join(F.filter(F.split(section, "\n"), lambda x: ~x.rlike(r"\A#{1,6}[" + SPACE + r"]+[^\n]*\z")), "\n")

    def of(body: Column) -> Column:
        sentence = F.regexp_extract(body, r"[^。!?\n]*[。!?]", 0)
        lines = F.filter(F.split(body, "\n"), lambda x: trim(x) != "")
        first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
        return F.when(body.rlike("[。!?]"), sentence).otherwise(first)

    short = lambda x: bound(x, lambda y: F.substring(trim(y), 1, EXCERPT_CHARS))
    return short(bound(bound(strip_links(prose), trim), of))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quote_shell(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def table_rows(markdown: Column) -> Column:
    return count(markdown, r"(?m)^\|.*\|$")


def code_blocks(markdown: Column) -> Column:
    return F.floor(count(markdown, r"(?m)^```") / 2)
