"""SimHash near-dedup by anchor-point covering.

A fingerprint is the bitwise majority of the XXH64 of a document's 3-word shingles. Fingerprints of at
most THRESHOLD = 2 differing bits are linked, and linked documents form components.

Of two such fingerprints one half (32 bits) differs in at most one bit. The anchors of a half are the
words of the [31,26] Hamming code over its upper 31 bits: a perfect covering code, every word is within
radius 1 of exactly one anchor. A fingerprint goes as itself to its own anchor, and as a candidate to
every anchor within the radius plus one (16 at most); so any linked pair meets at the anchor of either,
and is compared in full there. Only distinct fingerprints are dealt out, so copies cost one row.

dedup() removes documents, so it takes NEAR = 5 words a shingle and asks for a Jaccard similarity of 0.8 of
the sets of shingles, counted exactly. Two documents just as similar differ in about ten bits, far beyond
what anchors can cover, so next to the pairs of the covering code it compares documents that share one of
the first shingles of a common order: of n different ones the first n - ceil(0.8 n) + 1, of which two sets of
that similarity always share one. Shingles that are common in a sample come last in the order, so that few
documents meet at a passage; the order decides no result. Each document is compared with the first and the
last one at a place, then every two of different groups there. Pairs whose first shingles differ in more than
the similarity allows for the whole sets are left out before texts move. So no similar pair is lost.

Nulls and odd rows: a null or wordless text has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows are each reported; a null doc_id takes part, and
is never a component's id unless the component has no other. dedup() judges rows by doc_id and text, so rows
that share a doc_id but not the text are told apart, rows without a doc_id go as others do, and of rows
equal in both one stays; columns of any name pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm.common import fresh, table, written
from quarryloom.llm.graph import components, meetings, mixed, stars

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Of dedup(): words of a shingle, similarity.
NEAR, SIMILARITY = 5, 0.8
#: Documents of the sample (about), how often a shingle is common there, and how many of the commonest come last.
SAMPLE, COMMON, LAST = 20_000, 8, 200_000


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Hashes of the shingles of UTF-8 bytes. bytes.lower and bytes.split know ASCII only, as asked."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    return majority(shingles(text, n))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    cut = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = cut.schema["id"].dataType.simpleString()
    return cut.mapInArrow(of, f"id {kind}, fp bigint")


def _syndrome(half: Column) -> Column:
    """Which of the 31 bits (1 to 31) lies between the word and its anchor; 0 if it is one itself."""
    masks = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
    bits = [F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(m))).cast("long") % 2, k) for k, m in enumerate(masks)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("int")


def _flip(word: Column, at: Column) -> Column:
    return word.bitwiseXOR(F.when(at > 0, F.call_function("shiftleft", F.lit(1).cast("long"), at - 1)).otherwise(F.lit(0).cast("long")))


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """fps: distinct fp. Pairs (a, b) of fingerprints within threshold (2 at most), in both orders."""
    if not 0 <= threshold <= 2:
        raise ValueError("the code's halves are made for a threshold of 0 to 2")
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("part")).select(
        "fp",
        "part",
        F.when(F.col("part") == 0, F.shiftrightunsigned("fp", 33)).otherwise(F.shiftright("fp", 1).bitwiseAND(F.lit(0x7FFFFFFF))).alias("w"),
    )
    told = halves.select("fp", "part", "w", _syndrome(F.col("w")).alias("s"))
    own = told.select(F.col("fp").alias("a"), "part", _flip(F.col("w"), F.col("s")).alias("anchor"))
    # within two flips: the one bit s, or any two bits whose positions XOR to s
    s = F.col("s")
    two = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (s > 0) & (i < i.bitwiseXOR(s)))
    around = F.concat(
        F.array(_flip(F.col("w"), s)), F.transform(two, lambda i: _flip(_flip(F.col("w"), i), i.bitwiseXOR(s)))
    )
    near = told.select(F.col("fp").alias("b"), "part", F.explode(around).alias("anchor"))
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    met = own.alias("x").join(near.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.anchor") == F.col("y.anchor")) & close)
    return met.select("a", "b")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp, component (the smallest id reachable) of every row."""
    all_fps = written(fingerprints(docs, doc_id, text), "fingerprints")
    least = all_fps.groupBy("fp").agg(F.min("id").alias("least"))
    comp = components(links(least.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = least.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component")
    return all_fps.join(named, "fp").select("id", "fp", "component")


def _keys(text: bytes | None, n: int) -> np.ndarray:
    """62 bits of the hashes of the different shingles, in order."""
    return np.unique(shingles(text, n) >> np.uint64(2)).view(np.int64)


def _common(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Keys of shingles that are common in a sample of documents, sorted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(t.as_py(), shingle))], ["key"])

    whole = docs.select(F.col(f"`{text}`").cast("binary").alias("text")).filter(F.col("text").isNotNull())
    some = whole.filter(F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(max(1, whole.count() // SAMPLE))) == 0).distinct()
    found = some.mapInArrow(of, "key bigint").groupBy("key").count().filter(F.col("count") >= COMMON)
    return np.sort(np.array([r["key"] for r in found.orderBy(F.desc("count"), "key").limit(LAST).collect()], np.int64))


def _sketches(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """no (a number), h1 and h2 (hash of the text), keep (no id or not, least id), fp, size (different shingles) and
    least (the first of them) of each different text."""
    last = docs.sparkSession.sparkContext.broadcast(_common(docs, text, shingle))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, least = [], [], []
            for t in batch.column(3):
                h = shingles(t.as_py(), shingle)
                fps.append(majority(h))
                keys = np.unique(h >> np.uint64(2)).view(np.int64)
                keys = np.sort(keys | (np.isin(keys, last.value, assume_unique=True).astype(np.int64) << 62))
                sizes.append(len(keys))
                least.append(keys[: len(keys) - math.ceil(similarity * len(keys) - 1e-9) + 1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(least, pa.list_(pa.int64()))],
                ["id", "h1", "h2", "fp", "size", "least"],
            )

    cut = _hashed(docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text")), "text").select("id", "h1", "h2", "text")
    kind = cut.schema["id"].dataType.simpleString()
    rows = cut.mapInArrow(of, f"id {kind}, h1 bigint, h2 bigint, fp bigint, size bigint, least array<bigint>")
    one = rows.groupBy("h1", "h2").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("keep"), *[F.first(c).alias(c) for c in ("fp", "size", "least")]
    )
    return one.withColumn("no", F.monotonically_increasing_id())


def _hashed(rows: DataFrame, text: str, h1: str = "h1", h2: str = "h2") -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit("").cast("binary"))
    return rows.withColumns({h1: F.xxhash64(whole), h2: F.xxhash64(F.lit(1), whole)})


def _verified(docs: DataFrame, texts: DataFrame, pairs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """pairs (a, b) of numbers of texts -> those whose similarity suffices."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sketch = texts.select("no", "size", "least", F.array_max("least").alias("last"))
    both = pairs.join(sketch.toDF("a", "m", "x", "p"), "a").join(sketch.toDF("b", "n", "y", "q"), "b")
    # up to where both are known, the sets may differ in no more than all of them may
    apart = lambda x, y: F.size(F.filter(F.array_except(x, y), lambda k: k <= F.least("p", "q")))
    most = (F.col("m") + F.col("n")) * (1 - similarity) / (1 + similarity) + 1e-6
    likely = written(both.filter(apart("x", "y") + apart("y", "x") <= most).select("a", "b"), "near-pairs")
    known = texts.select("no", "h1", "h2").join(likely.select(F.explode(F.array("a", "b")).alias("no")).distinct(), "no")
    whole = _hashed(docs.select(F.col(f"`{text}`").cast("binary").alias("text")), "text").join(known, ["h1", "h2"]).groupBy("no").agg(F.first("text").alias("text"))
    whole = written(whole, "near-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = (np.unique(shingles(v.as_py(), shingle)) for v in (x, y))
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(common >= similarity * (len(s) + len(t) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    met = likely.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return written(met.mapInArrow(verify, "a bigint, b bigint"), "near-links")


def similar(docs: DataFrame, texts: DataFrame, text: str = "text", shingle: int = NEAR, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of numbers of texts (as _sketches gives them) that are similar enough; of similar pairs within a group,
    as many as connect it."""
    heads = written(texts.groupBy("fp").agg(F.min("no").alias("head")), "near-heads")
    alike = texts.join(heads, "fp").select(F.col("no").alias("a"), F.col("head").alias("b"))
    near = links(heads.select("fp")).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    met = meetings(texts.select("no", F.explode("least").alias("place")), "near-met")
    first = _verified(docs, texts, alike.unionByName(near).unionByName(stars(met)).filter(F.col("a") != F.col("b")), text, shingle, similarity)
    rest = mixed(met, components(first), "near")
    rest = written(rest.join(texts.select("no", "size"), "no"), "near-sized")
    sized = F.least("m", "n") >= F.greatest("m", "n") * similarity - 1e-6
    cross = rest.select("place", F.col("root").alias("ra"), F.col("no").alias("a"), F.col("size").alias("m")).join(
        rest.select(F.col("place").alias("there"), F.col("root").alias("rb"), F.col("no").alias("b"), F.col("size").alias("n")),
        (F.col("place") == F.col("there")) & (F.col("ra") < F.col("rb")) & sized,
    )
    cross = written(cross.select("a", "b"), "near-cross")
    return first if cross.isEmpty() else first.unionByName(_verified(docs, texts, cross, text, shingle, similarity))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = NEAR, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns kept, with one row of each group of near copies: that of the smallest id."""
    texts = written(_sketches(docs, doc_id, text, shingle, similarity), "near-sketches")
    comp = components(similar(docs, texts, text, shingle, similarity)).withColumnRenamed("node", "no")
    rooted = texts.join(comp, "no", "left").withColumn("root", F.coalesce("root", "no"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("keep", "h1", "h2")).alias("first")).select("first.h1", "first.h2")
    # one row of each text, picked before texts are dealt: copies do not travel, however many there are
    k1, k2, row = (fresh(docs, c) for c in ("_h1", "_h2", "_row"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id))
    rows = _hashed(docs, text, k1, k2).groupBy(k1, k2).agg(F.min_by(whole, order).alias(row))
    met = rows.join(kept.toDF("h1", "h2"), (F.col(k1) == F.col("h1")) & (F.col(k2) == F.col("h2")), "left_semi")
    return met.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
