"""Toxicity by maximum-scoring segments.

Training: words of labelled documents get log-odds of the toxic against the clean class, with a
Dirichlet prior (the corpus frequency of the word, PRIOR words in all, and half a word), as z-scores.
A word is counted by the distinct pairs of neighbours it was seen between, not by its occurrences, so
that a passage copied into many documents counts about once; the distinct pairs are estimated by one
HyperLogLog sketch a word and class, however frequent the word is. All words with z >= LEAST_Z and log-odds
>= LEAST_ODDS score their log-odds; every other word scores -DRIFT.

Scoring: one linear scan finds all maximal-scoring segments of a text (Ruzzo and Tompa). A segment of
score s in n words has the expected number E = K n exp(-lambda s) of chance segments as good in a clean
text: lambda solves the clean words' equation sum p exp(lambda s) = 1, K is fitted on clean documents.
The best segment's -ln P, with P = 1 - exp(-E) the chance of one as good, goes through a logistic curve
fitted on labelled documents that gave no words; segments with E <= SIGNIFICANT are its toxic passages.

Training reads at most SAMPLE documents of each class, those of the smallest hash of doc_id, as the
labels' bounded sample; class weights restore their proportion. So the model, words of the sample, is bounded.

Nulls and odd rows: a null or empty text has no words and the score of a clean text; labels that are
null are ignored, and a doc_id with several labels is toxic if one says so; without labels of both
classes the score is the share of toxic labels, 0 if there are none; a null doc_id is held out; new columns
get a number at the end of their name where docs has one of that name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.llm.common import fresh, table, written

SAMPLE, LEAST_Z, LEAST_ODDS, PRIOR, DRIFT, SIGNIFICANT = 20_000, 3.0, 1.0, 500.0, 0.5, 0.01
MOST_SURPRISE = 40.0
_WORD = re.compile(r"[^\W_]+")
#: Relative error of the sketches of distinct neighbours.
_ERROR = 0.05


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Segment(NamedTuple):
    start: int  # of words
    end: int
    score: float


def maximal_segments(n: int, hits: list[tuple[int, float]], drift: float = DRIFT) -> list[Segment]:
    """All maximal-scoring segments of n words of which those in hits (position, score > 0) score so and
    all others -drift. Linear in the number of hits: each kept segment knows the last one before it that
    starts lower, so no search walks a segment twice."""
    found: list[list] = []  # sum before, sum after, start, end, index of the last one that starts lower
    total, at = 0.0, 0
    for pos, score in hits:
        total -= drift * (pos - at)
        left, total, at = total, total + score, pos + 1
        new = [left, total, pos, pos + 1, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = found[j][4]
            new[4] = j
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [Segment(s, e, r - le) for le, r, s, e, _ in found]


def surprises(n: np.ndarray, best: np.ndarray, lam: float, k: float) -> np.ndarray:
    expected = k * np.maximum(n, 1.0) * np.exp(-lam * best)
    chance = -np.expm1(-expected)
    return np.where(best > 0, np.minimum(-np.log(np.maximum(chance, 1e-300)), MOST_SURPRISE), 0.0)


class Model(NamedTuple):
    lexicon: dict[str, float]
    lam: float
    k: float
    bias: float
    slope: float

    def surprise(self, n: int, best: float) -> float:
        """-ln of the probability 1 - exp(-E) that a clean text's best segment is as good; 0 without one."""
        return float(surprises(np.array([n]), np.array([best]), self.lam, self.k)[0])

    def expected(self, n: int, score: float) -> float:
        return self.k * max(n, 1) * math.exp(-self.lam * score)

    def segments(self, toks: list[str]) -> list[Segment]:
        if self.lexicon.keys().isdisjoint(toks):
            return []
        get = self.lexicon.get
        return maximal_segments(len(toks), [(i, s) for i, s in enumerate(map(get, toks)) if s is not None])

    def score(self, n: int, found: list[Segment]) -> float:
        best = max((s.score for s in found), default=0.0)
        return 1.0 / (1.0 + math.exp(-(self.bias + self.slope * self.surprise(n, best))))


def _word_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, text -> word, toxic, near: each different pair of neighbours (its hash), a batch at a time."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for label in (0, 1):
            lists = [words(t.as_py()) for t, y in zip(batch.column(1), toxic) if y == label]
            flat = [w for ws in lists for w in ("", *ws)]  # "" stands between documents
            if len(flat) <= len(lists):
                continue
            codes, uniques = pd.factorize(np.array([*flat, ""], dtype=object))
            crc = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in uniques], np.uint64)
            near = (crc[codes[:-2]] * np.uint64(0x9E3779B97F4A7C15)) ^ (crc[codes[2:]] * np.uint64(0xC2B2AE3D27D4EB4F))
            mid = codes[1:-1]
            real = mid != codes[0]
            seen = pd.DataFrame({"word": mid[real], "near": near[real].view(np.int64)}).drop_duplicates()
            cols = [pa.array(uniques[seen["word"].to_numpy()], pa.string()), pa.array(np.full(len(seen), label, np.int32)), pa.array(seen["near"].to_numpy())]
            yield pa.RecordBatch.from_arrays(cols, ["word", "toxic", "near"])


def _lexicon(train: DataFrame) -> tuple[dict[str, tuple[float, float]], float]:
    """word -> (log-odds, share among clean words); the clean share of all other words."""
    pairs = train.select("toxic", "text").mapInArrow(_word_maps, "word string, toxic int, near bigint")
    counts = [F.approx_count_distinct(F.when(F.col("toxic") == y, F.col("near")), _ERROR).cast("double").alias(f"c{y}") for y in (0, 1)]
    counted = written(pairs.groupBy("word").agg(*counts), "toxic-words")
    sums = counted.agg(F.sum("c0"), F.sum("c1")).first()
    n0, n1 = sums[0] or 0.0, sums[1] or 0.0
    if not n0 or not n1:
        return {}, 1.0
    prior = PRIOR * (F.col("c0") + F.col("c1")) / (n0 + n1) + 0.5
    a, b = F.col("c1") + prior, F.col("c0") + prior
    odds = F.log(a / (n1 + PRIOR - a)) - F.log(b / (n0 + PRIOR - b))
    scored = counted.select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"), (b / (n0 + PRIOR)).alias("p"))
    best = scored.filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).collect()
    lexicon = {r["word"]: (r["odds"], r["p"]) for r in best}
    return lexicon, max(1e-9, 1.0 - sum(p for _, p in lexicon.values()))


def _lambda(lexicon: dict[str, tuple[float, float]], other: float) -> float:
    """The positive root of sum p exp(lambda s) = 1; the sum is convex, below 1 just above 0."""
    s = np.array([-DRIFT, *(o for o, _ in lexicon.values())])
    p = np.array([other, *(x for _, x in lexicon.values())])
    p /= p.sum()
    value = lambda lam: float((p * np.exp(np.minimum(lam * s, 600.0))).sum()) - 1.0
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Bias and slope (not negative) by Newton's method with a light ridge."""
    beta = np.zeros(2)
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - 1e-3 * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from the labelled rows that are not held out; only their text and label are used."""
    told = (
        labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic"))
        .filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = dict(told.groupBy("toxic").count().collect())
    everything = sum(sizes.values())
    base = sizes.get(1, 0) / everything if everything else 0.0
    constant = Model({}, 1.0, 1.0, math.log(min(max(base, 1e-6), 1 - 1e-6) / (1 - min(max(base, 1e-6), 1 - 1e-6))), 0.0)
    if len(sizes) < 2:
        return constant
    # smallest hashes of each class; fold 4 (of crc32 mod 5) calibrates, the others give words
    picked = [told.filter(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).withColumn("calibrates", F.crc32(F.col("id").cast("string")) % 5 == 4)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = written(rows.select("toxic", "calibrates", "text"), "toxic-sample")
    weights, other = _lexicon(rows.filter(~F.col("calibrates")))
    if not weights:
        return constant
    lam = _lambda(weights, other)
    lexicon = {w: o for w, (o, _) in weights.items()}
    raw = Model(lexicon, lam, 1.0, 0.0, 0.0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = [words(t.as_py()) for t in batch.column(1)]
            top = [max((s.score for s in raw.segments(t)), default=0.0) for t in toks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in toks], pa.int64()), pa.array(top, pa.float64())], ["toxic", "n", "best"])

    # as counts of a grid, so that what the driver gets is bounded too
    grid = (
        rows.filter("calibrates").select("toxic", "text").mapInArrow(best, "toxic int, n bigint, best double")
        .groupBy("toxic", F.round(F.log(F.greatest("n", F.lit(1))), 1).alias("log_n"), F.round("best", 1).alias("best"))
        .count()
        .toPandas()
    )
    share = {y: sizes[y] / max(1, min(sizes[y], sample)) for y in (0, 1)}
    w = grid["count"].to_numpy(float) * grid["toxic"].map(share).to_numpy(float)
    y, log_n, top = (grid[c].to_numpy(float) for c in ("toxic", "log_n", "best"))
    clean = y == 0
    if not clean.any() or clean.all():
        return constant
    k = float(w[clean].sum() / (w[clean] * np.exp(log_n[clean] - lam * top[clean])).sum())
    bias, slope = _logistic(surprises(np.exp(log_n), top, lam, k), y, w / w.sum() * len(w))
    return Model(lexicon, lam, k, bias, slope)


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False, passages: bool = False) -> DataFrame:
    """docs (without text, unless asked for) with score and n_passages (significant segments); passages=True
    adds passages: array of start, end (words), score, expected and the words themselves."""
    at = docs.columns.index(text)
    keep = [i for i in range(len(docs.columns)) if i != at or keep_text]
    names = [fresh(docs, n) for n in ("score", "n_passages", "passages")]
    long, double = T.LongType(), T.DoubleType()
    passage = T.StructType([T.StructField("start", long), T.StructField("end", long), T.StructField("score", double), T.StructField("expected", double), T.StructField("words", T.StringType())])
    new = [T.StructField(names[0], double), T.StructField(names[1], long), *([T.StructField(names[2], T.ArrayType(passage))] if passages else [])]
    fields = [*(docs.schema.fields[i] for i in keep), *new]
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64()), ("words", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, counts, lists = [], [], []
            for t in batch.column(at):
                toks = words(t.as_py())
                found = m.segments(toks)
                strong = [s for s in found if m.expected(len(toks), s.score) <= SIGNIFICANT]
                scores.append(m.score(len(toks), found))
                counts.append(len(strong))
                if passages:
                    lists.append([{"start": s.start, "end": s.end, "score": s.score, "expected": m.expected(len(toks), s.score), "words": " ".join(toks[s.start : s.end])} for s in strong])
            cols = [*(batch.column(i) for i in keep), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())]
            if passages:
                cols.append(pa.array(lists, arrow))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return docs.mapInArrow(of, T.StructType(fields))


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, all columns kept, without those that score threshold or more."""
    scored = score(docs, train(docs, labels, doc_id, text), text, keep_text=True)
    return scored.filter(F.col(f"`{scored.columns[len(docs.columns)]}`") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_passages",
    )
