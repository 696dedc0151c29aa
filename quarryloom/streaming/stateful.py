"""Stateful rules as streams: cache freshness, turns per host, templates per domain, versions of a page.

Each is a StatefulProcessor for transformWithStateInPandas, which needs the RocksDB state store. Events of
one batch are taken in order of time; state lives per key and never leaves the executors. In append mode
they give what the batch operators give, if a key's events arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarryloom.operators.policy import MIN_INTERVAL_MS, TTL_MS
from quarryloom.operators.template import RECENT_PAGES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_L, _S = T.LongType(), T.StringType()
_LONG = T.StructType([T.StructField("v", _L)])
_TEXT = T.StructType([T.StructField("v", _S)])


def _ordered(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


class CacheMachine(StatefulProcessor):
    """url, at, tie -> url, at, tie, status: fresh within ttl of the last fetch, else miss."""

    output = T.StructType([T.StructField("url", _S), T.StructField("at", _L), T.StructField("tie", _L), T.StructField("status", _S)])

    def __init__(self, ttl: int = TTL_MS):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _LONG)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        events, out = _ordered(rows, "at", "tie"), []
        for at in events["at"]:
            fresh = last is not None and at - last < self.ttl
            last = last if fresh else int(at)
            out.append("fresh" if fresh else "miss")
        self.last.update((last,))
        yield pd.DataFrame({"url": key[0], "at": events["at"], "tie": events["tie"], "status": out})

    def close(self) -> None:
        pass


class TurnQueue(StatefulProcessor):
    """host, at, tie -> host, at, tie, granted: an interval at least after the host's last grant."""

    output = T.StructType([T.StructField("host", _S), T.StructField("at", _L), T.StructField("tie", _L), T.StructField("granted", _L)])

    def __init__(self, interval: int = MIN_INTERVAL_MS):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _LONG)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        events, out = _ordered(rows, "at", "tie"), []
        for at in events["at"]:
            last = int(at) if last is None else max(int(at), last + self.interval)
            out.append(last)
        self.last.update((last,))
        yield pd.DataFrame({"host": key[0], "at": events["at"], "tie": events["tie"], "granted": out})

    def close(self) -> None:
        pass


class TemplateLearner(StatefulProcessor):
    """domain, url, fetched_at, block_hashes -> domain, url, hashes: what is a template once the page is in.

    State is the latest pages of the domain, one list entry each; a page fetched again replaces its entry."""

    output = T.StructType([T.StructField("domain", _S), T.StructField("url", _S), T.StructField("hashes", T.ArrayType(_S))])
    page = T.StructType([T.StructField("url", _S), T.StructField("fetched_at", _L), T.StructField("hashes", T.ArrayType(_S))])

    def __init__(self, recent: int = RECENT_PAGES):
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getListState("pages", self.page)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [(p[0], p[1], list(p[2])) for p in self.pages.get()]
        out = []
        for r in _ordered(rows, "fetched_at", "url").itertuples():
            held = [p for p in held if p[0] != r.url] + [(r.url, int(r.fetched_at), [str(h) for h in dict.fromkeys(r.block_hashes)])]
            held = sorted(held, key=lambda p: (-p[1], p[0]))[: self.recent]
            shared = set(held[0][2]).intersection(*(p[2] for p in held)) if len(held) == self.recent else set()
            out.append((key[0], r.url, sorted(shared)))
        self.pages.put(held)
        yield pd.DataFrame(out, columns=["domain", "url", "hashes"])

    def close(self) -> None:
        pass


class VersionDiffer(StatefulProcessor):
    """url, fetched_at, markdown -> url, fetched_at, previous, markdown: each version with the one before."""

    output = T.StructType([T.StructField("url", _S), T.StructField("fetched_at", _L), T.StructField("previous", _S), T.StructField("markdown", _S)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", _TEXT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.before.get()[0] if self.before.exists() else None
        out = []
        for r in _ordered(rows, "fetched_at").itertuples():
            out.append((key[0], int(r.fetched_at), before, r.markdown))
            before = r.markdown
        self.before.update((before,))
        yield pd.DataFrame(out, columns=["url", "fetched_at", "previous", "markdown"])

    def close(self) -> None:
        pass


def apply(stream: DataFrame, key: str, processor: StatefulProcessor) -> DataFrame:
    """The processor's output over a stream, or over a table."""
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="None")
