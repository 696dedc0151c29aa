"""Normalisation of CJK prose: NFKC, and no blanks or single newlines between CJK characters."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_C = "[぀-ゟ゠-ヿ㐀-䶿一-鿿豈-﫿、-〿！-￯]"
_CODE = re.compile(r"(```.*?```|`[^`\n]*`)", re.S)
_NEWLINE = re.compile(rf"(?<={_C})[ \t　]*\n[ \t　]*(?={_C})")
_BLANKS = re.compile(rf"(?<={_C})[ \t　]+(?={_C})")
_BEFORE_MARK = re.compile(rf"(?<={_C})[ \t　]+(?=[*_~]+{_C})")
_AFTER_MARK = re.compile(rf"(?<={_C})([*_~]+)[ \t　]+(?={_C})")


def normalise_cjk(text: str | None) -> str | None:
    """Code in backticks stays as it is."""
    if text is None:
        return None
    parts = _CODE.split(text)
    for i in range(0, len(parts), 2):
        p = unicodedata.normalize("NFKC", parts[i])
        for pattern in (_NEWLINE, _BLANKS, _BEFORE_MARK):
            p = pattern.sub("", p)
        parts[i] = _AFTER_MARK.sub(r"\1", p)
    return "".join(parts)


#: Texts that are Python objects at a time. A batch of Spark's holds up to 64 MB of them.
SLICE_ROWS = 64


@F.arrow_udf(StringType())
def cjk_normalised(text: pa.Array) -> pa.Array:
    parts = [pa.array([normalise_cjk(t) for t in text.slice(at, SLICE_ROWS).to_pylist()], pa.string()) for at in range(0, len(text), SLICE_ROWS)]
    return pa.concat_arrays(parts or [pa.array([], pa.string())])
