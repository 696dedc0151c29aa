"""Decoding of response bodies: the header's charset, else the page's, else what the bytes look like."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: names of charsets
ALIASES = {
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "ms932": "cp932", "cp932": "cp932",
    "euc-jp": "euc_jp", "x-euc-jp": "euc_jp", "eucjp": "euc_jp", "iso-2022-jp": "iso2022_jp", "jis": "iso2022_jp", "utf-8": "utf-8", "utf8": "utf-8",
}
META_BYTES = 2048
_NAME = re.compile(r"""charset\s*=\s*["']?\s*([A-Za-z0-9_:.\-]+)""", re.I)


def _codec(name: str) -> str | None:
    name = name.strip().lower()
    try:
        return codecs.lookup(ALIASES.get(name, name)).name
    except LookupError:
        return None


def detect(body: bytes, content_type: str | None) -> str:
    for text in (content_type or "", body[:META_BYTES].decode("latin-1")):
        found = _NAME.search(text)
        if found and (codec := _codec(found[1])):
            return codec
    if b"\x1b$" in body or b"\x1b(" in body:
        return "iso2022_jp"
    best = "utf-8"
    try:
        body.decode("utf-8")
        return best
    except UnicodeDecodeError as e:
        if e.start >= len(body) - 3:  # a character cut off at the end
            return best
    fewest = body.decode("utf-8", "replace").count("�")
    for codec in ("euc_jp", "cp932"):
        bad = body.decode(codec, "replace").count("�")
        if bad < fewest:
            best, fewest = codec, bad
    return best


def decode_body(body: bytes | None, content_type: str | None) -> tuple[str | None, str | None]:
    if body is None:
        return None, None
    codec = detect(body, content_type)
    return codec, body.decode(codec, "replace").removeprefix("﻿")


@F.pandas_udf(StructType([StructField("encoding", StringType()), StructField("text", StringType())]))
def decoded(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_body(b, c) for b, c in zip(body, content_type)], columns=["encoding", "text"])
