"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH = 200 bytes that covers it also starts anywhere else in the corpus.
Such strings, windows, are dealt to suffix arrays so that equal ones meet:

1. Each window has an anchor, the leftmost GRAM-byte substring of least hash in it. Consecutive windows
   of one anchor form a run, whose content (its windows' bytes) is fixed by the text alone. Runs move as
   hashes of anchor and content.
2. An anchor that is met once has no repeated window. If all runs of an anchor have one content, all
   their windows are repeated, and so are those of any content met twice.
3. Only contents met once whose anchor is met again are left open, at the edges of repeated passages. Their
   bytes, and those of one run for each repeated content of such an anchor, go to the index, dealt by
   anchor. An anchor of over HOT contents is dealt in pieces of PIECE windows, by the hash of the bytes
   that all windows of a piece share, so that no anchor fills a task.
4. The index is a family of levels, each the suffix array of its windows. A batch of contents gets its own
   suffix array by prefix doubling, is scanned in order against the existing levels for equal windows, and
   levels of equal size merge, so a window is merged a logarithmic number of times. A window that is met
   again is reported on both sides.

All comparisons of windows in the index are of bytes; contents are told apart by 128 bits of hash.

Nulls and odd rows: null texts are empty; texts under 200 bytes lose nothing by themselves; rows equal in
id and text are copies of each other; overlapping occurrences within one text count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm.common import table, written

LENGTH, GRAM = 200, 32
HOT, PIECE = 1000, 8
BATCH_BYTES, TASK_BYTES = 1 << 20, 8 << 20
_SPAN = 1 << 20  # windows handled at a time; positions fit 21 bits
_MIX, _BASE = np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


_tables: list[np.ndarray] = []


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes at every position."""
    if not _tables:
        n = _SPAN + 2 * LENGTH
        _tables.extend((_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)))
    up, down = _tables
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(x) - GRAM + 1]
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= _MIX
    return h ^ (h >> np.uint64(29))


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, number of windows, anchor and lead (bytes from start to the anchor) of every run."""
    starts, counts, anchors, leads = [], [], [], []
    wide = LENGTH - GRAM + 1
    for at in range(0, len(text) - LENGTH + 1, _SPAN):
        x = np.frombuffer(text, np.uint8, min(_SPAN + LENGTH - 1, len(text) - at), at)
        h = _gram_hashes(x)
        # least hash, leftmost: the upper 42 bits and the position
        least = (h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= wide:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        least = np.minimum(least[: len(least) - (wide - k)], least[wide - k :])
        cut = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
        starts.append(cut + at)
        counts.append(np.diff(np.append(cut, len(least))))
        anchor_at = (least[cut] & np.uint64((1 << 22) - 1)).astype(np.int64)
        anchors.append(h[anchor_at])
        leads.append(anchor_at - cut)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors), np.concatenate(leads)


def pieces(text: bytes, start: int, n: int, anchor: int, lead: int) -> list[tuple[int, int, int]]:
    """start, number of windows and key of the pieces of a run. Windows whose distance to the anchor
    has the same quotient by PIECE share all but PIECE - 1 bytes: these make the key, so only windows
    that could be equal meet."""
    out, p, at = [], start, start + lead
    while p < start + n:
        block = (at - p) // PIECE
        q = min(start + n, at - block * PIECE + 1)
        core = at - block * PIECE
        key = xxhash.xxh3_64_intdigest(text[core : core + LENGTH - PIECE + 1], (anchor + block) & 0xFFFFFFFFFFFFFFFF)
        out.append((p, q - p, key - (1 << 64) if key >> 63 else key))
        p = q
    return out


def suffix_array(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts in the order of the LENGTH bytes there, and the class (number of different ones before) of
    each in that order. Prefix doubling: names of 8, 16, ... 128 bytes; two of 128 that overlap make 200."""
    n = len(buffer)
    name = np.zeros(n, np.uint64)
    for i in range(8):
        name[: n - i] |= buffer[i:].astype(np.uint64) << np.uint64(56 - 8 * i)

    def ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], (ordered[1:] != ordered[:-1]).cumsum()])
        out = np.empty(len(key), np.int64)
        out[order] = fresh
        return out

    rank, width = ranks(name), 8
    while width < 128:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        rank = ranks(rank * (n + 1) + after)
        width *= 2
    key = rank[starts] * (n + 1) + rank[starts + LENGTH - width]
    order = np.argsort(key, kind="stable")
    key = key[order]
    return starts[order], np.concatenate([[0], (key[1:] != key[:-1]).cumsum()]) if len(key) else np.zeros(0, np.int64)


def _windows(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bytes at starts as rows of 25 big-endian numbers: they compare as the bytes do."""
    return np.lib.stride_tricks.sliding_window_view(buffer, LENGTH)[starts].view(">u8").astype(np.uint64)


class Level:
    """Different windows in order: buffer, starts, first 8 bytes, what they refer to, met again or not."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, refs: np.ndarray, again: np.ndarray):
        self.buffer, self.starts, self.refs, self.again = buffer, starts, refs, again
        self.head = self._heads(starts)

    def __len__(self) -> int:
        return len(self.starts)

    def _heads(self, starts: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.buffer, 8)[starts].view(">u8").ravel().astype(np.uint64)

    def place(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of other: where it belongs here, and whether it is here."""
        low = np.searchsorted(self.head, other.head, "left")
        high = np.searchsorted(self.head, other.head, "right")
        equal = np.zeros(len(other), bool)
        todo = np.nonzero(low < high)[0]
        while len(todo):
            left = []
            for part in np.array_split(todo, -(-len(todo) // 65536)):
                mid = (low[part] + high[part]) // 2
                a, b = _windows(self.buffer, self.starts[mid]), _windows(other.buffer, other.starts[part])
                differ = a != b
                first = differ.argmax(axis=1)
                row = np.arange(len(part))
                same = ~differ[row, first]
                less = a[row, first] < b[row, first]
                equal[part[same]] = True
                low[part[same]] = high[part[same]] = mid[same]
                low[part[less]] = mid[less] + 1
                high[part[~less & ~same]] = mid[~less & ~same]
                left.append(part[low[part] < high[part]])
            todo = np.concatenate(left)
        return low, equal


def _merged(a: Level, b: Level) -> Level:
    at, equal = a.place(b)
    keep = ~equal
    put = lambda x, y: np.insert(x, at[keep], y[keep])
    return Level(np.concatenate([a.buffer, b.buffer]), put(a.starts, b.starts + len(a.buffer)), put(a.refs, b.refs), put(a.again, b.again))


class SuffixFamily:
    """The logarithmic family: add() takes a batch and returns refs of windows that are known to repeat."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, buffer: np.ndarray, starts: np.ndarray, refs: np.ndarray) -> np.ndarray:
        """starts: of all windows in buffer; refs: what is reported for each. A ref may be reported again."""
        if not len(starts):
            return refs[:0]
        by_start = np.full(len(buffer), -1, refs.dtype)
        by_start[starts] = refs
        ordered, classes = suffix_array(buffer, starts)
        sizes = np.bincount(classes)
        first = np.concatenate([[0], sizes.cumsum()[:-1]])
        again = sizes > 1
        new = Level(buffer, ordered[first], by_start[ordered[first]], again.copy())
        told = []
        for level in self.levels:
            at, equal = level.place(new)
            hit = at[equal]
            told.append(level.refs[hit[~level.again[hit]]])
            level.again[hit] = True
            again |= equal
        new.again = again
        told.append(by_start[ordered[again[classes]]])
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1]) >= len(self.levels[-2]) / 2:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(_merged(a, b))
        return np.concatenate(told)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("th"), whole.cast("binary").alias("text"))


def _open_runs(keyed: DataFrame) -> DataFrame:
    """id, th, start, n, lead, anchor, repeated (all its windows are), index (its content is to be indexed), hot."""
    kind = keyed.schema["id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, contents = [], [], []
            for i, t in enumerate(batch.column(2)):
                b = t.as_py()
                if len(b) < LENGTH:
                    continue
                s, n, a, lead = runs(b)
                ends = (s + n + LENGTH - 1).tolist()
                contents.append(np.fromiter((xxhash.xxh3_64_intdigest(b[x:y]) for x, y in zip(s.tolist(), ends)), np.uint64, len(s)))
                rows.append(np.full(len(s), i))
                found.append((s, n, lead, a.view(np.int64)))
            if rows:
                at = pa.array(np.concatenate(rows))
                cols = [*map(np.concatenate, zip(*found)), np.concatenate(contents).view(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, cols)], ["id", "th", "start", "n", "lead", "anchor", "content"])

    found = written(keyed.mapInArrow(emit, f"id {kind}, th bigint, start bigint, n bigint, lead bigint, anchor bigint, content bigint"), "runs")
    # what is counted by anchor is written before it is joined: a join with no aggregation in its tasks can
    # split an anchor that many runs share
    per_anchor = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("met"), (F.min("content") != F.max("content")).alias("mixed")).filter("met > 1"), "anchors")
    met = written(found.join(per_anchor.select("anchor", "mixed"), "anchor"), "met-runs")
    mixed = met.filter("mixed")
    per_content = written(mixed.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("id", "th", "start")).alias("first")), "contents")
    hot = written(per_content.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter(F.col("contents") > HOT).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    told = mixed.join(per_content, ["anchor", "content"]).join(hot, "anchor", "left")
    cols = ["id", "th", "start", "n", "lead", "anchor"]
    return met.filter("not mixed").select(*cols, F.lit(True).alias("repeated"), F.lit(False).alias("index"), F.lit(False).alias("hot")).unionByName(
        told.select(*cols, (F.col("met") > 1).alias("repeated"), ((F.col("met") == 1) | F.struct("id", "th", "start").eqNullSafe(F.col("first"))).alias("index"), F.coalesce("hot", F.lit(False)).alias("hot"))
    )


def _contents(keyed: DataFrame, open_runs: DataFrame) -> DataFrame:
    """key, id, th, start, want (to be reported), bytes of what is indexed; equal windows have equal keys."""
    run = F.struct("start", "n", "lead", "anchor", "hot", (~F.col("repeated")).alias("want"))
    lists = open_runs.filter("index").groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(run).alias("runs"))
    met = keyed.join(lists, keyed["id"].eqNullSafe(F.col("_id")) & (keyed["th"] == F.col("_th")))
    kind = keyed.schema["id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cut = [], []
            for i, (t, own) in enumerate(zip(batch.column(2), batch.column(3))):
                b = t.as_py()
                for r in own.as_py():
                    parts = pieces(b, r["start"], r["n"], r["anchor"], r["lead"]) if r["hot"] else [(r["start"], r["n"], r["anchor"])]
                    rows += [i] * len(parts)
                    cut += [(key, p, r["want"], b[p : p + n + LENGTH - 1]) for p, n, key in parts]
            if rows:
                at = pa.array(rows)
                keys, starts, wants, parts = zip(*cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int64()), pa.array(wants, pa.bool_()), pa.array(parts, pa.binary())],
                    ["key", "id", "th", "start", "want", "bytes"],
                )

    return met.select("id", "th", "text", "runs").mapInArrow(emit, f"key bigint, id {kind}, th bigint, start bigint, want boolean, bytes binary")


def _indexed(contents: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """id, th, first, last (exclusive) of bytes that windows cover which the index found repeated."""
    kind = contents.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, tables, held, size, base = SuffixFamily(), [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, base
            buffer = np.frombuffer(b"".join(held), np.uint8)
            lengths = np.array([len(x) for x in held])
            windows = lengths - LENGTH + 1
            row = np.repeat(np.arange(len(held)), windows)
            offset = np.arange(windows.sum()) - np.repeat(windows.cumsum() - windows, windows)
            told = np.unique(family.add(buffer, (lengths.cumsum() - lengths)[row] + offset, (base + row) << 21 | offset))
            base, held, size = base + len(held), [], 0
            if not len(told):
                return
            # neighbours join into one interval
            cut = np.nonzero(np.diff(told) != 1)[0]
            begins, ends = told[np.concatenate([[0], cut + 1])], told[np.concatenate([cut, [len(told) - 1]])]
            known = pa.Table.from_batches(tables).combine_chunks()
            rows = known.take(pa.array(begins >> 21))
            want = rows.column("want").to_numpy(zero_copy_only=False)
            start = rows.column("start").to_numpy()
            low, high = start + (begins & (1 << 21) - 1), start + (ends & (1 << 21) - 1) + LENGTH
            out = pa.table([rows.column("id"), rows.column("th"), pa.array(low), pa.array(high)], ["id", "th", "first", "last"])
            yield from out.filter(pa.array(want)).combine_chunks().to_batches()

        for batch in batches:
            tables.append(batch.select(["id", "th", "start", "want"]))
            for part in batch.column(batch.schema.get_field_index("bytes")):
                held.append(part.as_py())
                size += len(held[-1])
                if size >= batch_bytes:
                    yield from flush()
        if held:
            yield from flush()

    return contents.mapInArrow(scan, f"id {kind}, th bigint, first bigint, last bigint")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """id, th (hash of the text), spans (array of first, last; bytes that go, last exclusive; they may touch
    and overlap) of every text that loses any."""
    keyed = _keyed(docs, doc_id, text)
    found = written(_open_runs(keyed), "open-runs")
    edge = F.col("n") + LENGTH - 1
    volume = found.filter("index").agg(F.sum(F.when(F.col("hot"), F.col("n") * LENGTH / 2).otherwise(edge))).first()[0] or 0
    contents = _contents(keyed, found).repartition(max(1, int(volume // TASK_BYTES) + 1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "key")
    edges = written(_indexed(contents, batch_bytes), "repeated-edges")
    whole = found.filter("repeated").select("id", "th", F.col("start").alias("first"), (F.col("start") + edge).alias("last"))
    return whole.unionByName(edges).groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def remove(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the bytes that stay) of every row."""
    keyed = _keyed(docs, doc_id, text)
    met = keyed.join(spans.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "spans"), keyed["id"].eqNullSafe(F.col("_id")) & (keyed["th"] == F.col("_th")), "left")
    kind = keyed.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(1), batch.column(2)):
                b = t.as_py()
                if not spans.is_valid:
                    out.append((len(b), 0, 0, b))
                    continue
                ends = spans.values
                first, last = (ends.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                fresh = np.concatenate([[True], first[1:] > last[:-1]])
                low, high = first[fresh], np.append(last[:-1][fresh[1:]], last[-1])
                kept, at = [], 0
                for x, y in zip(low.tolist(), high.tolist()):
                    kept.append(b[at:x])
                    at = y
                kept.append(b[at:])
                out.append((len(b), int((high - low).sum()), len(low), b"".join(kept)))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return met.select("id", "text", "spans").mapInArrow(cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return remove(docs, repeated(docs)).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
