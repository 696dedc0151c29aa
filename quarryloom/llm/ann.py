"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest of PIVOTS pivots, in order. Blocks of up to BLOCK vectors
keep an inverted file for each pivot: which vectors list it, and at which rank. A query visits the files
of its own pivots, which gives the footrule distance (the sum of rank differences, PREFIX where a pivot
is missing) to every vector of the block; the nearest by footrule, SHARE of the block and MORE for each
neighbour asked for, ties included, are reranked by cosine in double precision on the original vectors.
share=1.0 is an exact search.

Pivots are the PIVOTS vectors of smallest hash: a bounded sample; every vector is indexed. Equal vectors
are indexed once, with as many of their smallest ids as a result can name, so a vector that a third of
the rows share costs one entry. Queries are a stated set; they go in packed chunks to every block, and a
task holds one block and one chunk at a time.

Nulls and odd rows: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without vec_id or of another length than most vectors have; rows that repeat an id and
a vector count once; a query's own id is never among its results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryloom.llm.common import table, written

PIVOTS, PREFIX, SHARE, MORE, BLOCK, CHUNK = 256, 32, 0.3, 20, 8192, 1024


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v (array<double>), h1, h2 (its hash) of the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        rows.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
        .withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    )


def _prefix(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the numbers of its k nearest pivots (by cosine), nearest first."""
    near = -(x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    return np.argsort(near, axis=1, kind="stable")[:, :k].astype(np.int32)


class PermutationBlock:
    """Inverted files of one block of vectors."""

    def __init__(self, x: np.ndarray, prefixes: np.ndarray, n_pivots: int):
        self.x, self.norm = x, np.sqrt((x * x).sum(axis=1))
        self.n, self.k = prefixes.shape
        flat = prefixes.ravel()
        order = np.argsort(flat, kind="stable")
        self.start = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        self.who, self.rank = (order // self.k).astype(np.int32), (order % self.k).astype(np.int32)

    def footrule(self, prefix: np.ndarray) -> np.ndarray:
        """Of the query's prefix to each vector; a pivot that one side lacks stands at rank k there."""
        far = self.k * (self.k + 1)  # no pivot in common: both sides pay k - rank for each of theirs
        out = np.full(self.n, far, np.int64)
        for r, p in enumerate(prefix):
            a, b = self.start[p], self.start[p + 1]
            rank = self.rank[a:b]
            out[self.who[a:b]] += np.abs(rank - r) - (self.k - rank) - (self.k - r)
        return out

    def search(self, q: np.ndarray, prefix: np.ndarray, share: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the candidates and their cosines with q."""
        keep = int(np.ceil(self.n * share)) + MORE * k
        if keep < self.n:
            far = self.footrule(prefix)
            cand = np.nonzero(far <= np.partition(far, keep - 1)[keep - 1])[0]
        else:
            cand = np.arange(self.n)
        dots = (self.x[cand] * q).sum(axis=1)
        return cand, dots / (self.norm[cand] * np.sqrt((q * q).sum()))


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    share: float = SHARE,
    n_pivots: int = PIVOTS,
    prefix: int = PREFIX,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row of queries, its k nearest rows."""
    found = usable(rows, vec_id, embedding)
    per_length = found.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    dim = per_length["n"] if per_length else 0
    found = found.filter(F.size("v") == dim)
    # equal vectors become one entry, with the k + 1 smallest ids
    place = Window.partitionBy("h1", "h2").orderBy("id")
    one = found.groupBy("h1", "h2", "id").agg(F.first("v").alias("v"))
    entries = written(
        one.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v")),
        "ann-entries",
    )
    sample = entries.select("v", F.xxhash64("h1").alias("h"), "h1", "h2").orderBy("h", "h1", "h2").limit(n_pivots).collect()
    pivots = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), dim)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    n_pivots, prefix = len(pivots), min(prefix, len(pivots))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["v"].tolist(), np.float64)
        ids = [np.asarray(i, np.int64) for i in rows["ids"]]
        return pd.DataFrame({
            "block": [rows["block"].iloc[0]],
            "n": [len(rows)],
            "x": [x.tobytes()],
            "prefixes": [_prefix(x, pivots, prefix).tobytes()],
            "keys": [rows[["h1", "h2"]].to_numpy(np.int64).tobytes()],
            "ids": [np.concatenate(ids).tobytes()],
            "per": [np.array([len(i) for i in ids], np.int64).tobytes()],
        })

    def pack(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
        """One row for each block of about size vectors, dealt by hash; and their number."""
        n = max(1, -(-vectors.count() // size))
        dealt = vectors.withColumn("block", F.pmod(F.xxhash64("h2", "h1"), F.lit(n)))
        schema = "block bigint, n bigint, x binary, prefixes binary, keys binary, ids binary, per binary"
        return dealt.groupBy("block").applyInPandas(packed, schema), n

    cols = ["h1", "h2", "ids", "v"]
    asked = written(
        usable(queries, vec_id, embedding).filter(F.size("v") == dim).select(F.col("id").alias("query_id"), "h1", "h2", "v").dropDuplicates(["query_id", "h1", "h2"]),
        "ann-asked",
    )
    distinct = asked.groupBy("h1", "h2").agg(F.first("v").alias("v")).withColumn("ids", F.array().cast("array<bigint>"))
    blocks, n_blocks = pack(entries.select(*cols), BLOCK)
    chunks, _ = pack(distinct.select(*cols), CHUNK)
    to_all = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    met = blocks.withColumn("kind", F.lit(0)).unionByName(written(to_all, "ann-queries").withColumn("kind", F.lit(1)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ids, start = None, None, None
        for pdf in batches:
            for r in pdf.itertuples():
                x = np.frombuffer(r.x, np.float64).reshape(r.n, dim)
                pre = np.frombuffer(r.prefixes, np.int32).reshape(r.n, prefix)
                if r.kind == 0:
                    block = PermutationBlock(x, pre, n_pivots)
                    ids, per = np.frombuffer(r.ids, np.int64), np.frombuffer(r.per, np.int64)
                    start = np.concatenate([[0], np.cumsum(per)])
                    continue
                keys = np.frombuffer(r.keys, np.int64).reshape(r.n, 2)
                out = []
                for q in range(r.n):
                    cand, score = block.search(x[q], pre[q], share, k)
                    if len(cand) > k + 1:  # entries beyond the k + 1 best, ties kept, name no result
                        best = score >= np.partition(score, -k - 1)[-k - 1]
                        cand, score = cand[best], score[best]
                    named = [(-s, i) for c, s in zip(cand, score) for i in ids[start[c] : start[c + 1]]]
                    out += [(keys[q, 0], keys[q, 1], i, -s) for s, i in sorted(named)[: k + 1]]
                yield pd.DataFrame(out, columns=["h1", "h2", "vec_id", "score"])

    hits = met.repartition("block").sortWithinPartitions("block", "kind").mapInPandas(search, "h1 bigint, h2 bigint, vec_id bigint, score double")
    best = hits.groupBy("h1", "h2").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("top")
    )
    own = F.filter("top", lambda t: t["vec_id"] != F.col("query_id"))
    return (
        asked.select("query_id", "h1", "h2")
        .join(best, ["h1", "h2"])
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "t"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.far")).alias("score"))
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))
