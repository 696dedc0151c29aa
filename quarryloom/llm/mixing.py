"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words `[^\\x20\\x09-\\x0D]+`. Sources, by code point with null last, weigh WEIGHTS in turn and
share SHARE times all words; no target exceeds MOST times its source's words, and the excess is shared
again by weight until none does.

Every source's documents are dealt by hash into blocks of about block_words words. Each pass over a
source permutes its blocks; the target is as many whole passes as fit, then blocks of one more pass in
its order until the words are met. That fixes the exact quota of blocks each source gives. A binary tree
over the output shards splits these quotas: at every node the left half's share of each source is one
multivariate-hypergeometric draw, seeded by the node. Each shard then takes the next blocks of every
source's permuted order, so shards are disjoint, and shuffles its documents locally (by place).

The block that meets the target is used up to the missing words, in hash order; the one document that
crosses them counts in part. So a source's words match its target to the word, up to rounding down.

What the driver holds is bounded by parameters: one row for each source (MAX_SOURCES, checked) and for
each block (blocks grow in size rather than beyond MAX_BLOCKS). Documents are not shuffled to be planned.

Nulls and odd rows: a null text has no words; null is a source of its own; documents without words are
drawn along with their block; rows equal in id and text share one place and, where they cross the target,
the missing words evenly; sources without words have target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryloom.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 11
BLOCK_WORDS, MAX_BLOCKS, SHARD_WORDS, MAX_SOURCES = 16_384, 65_536, 4_000_000, 100_000


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """What each source gives: by weight, none above most times its size."""
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = min(share, most) * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: how many of each source's blocks a shard gets, by recursive draws."""
    total = int(quotas.sum())
    ends = np.array([total * i // shards for i in range(shards + 1)])
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        low, high, have = stack.pop()
        if high - low == 1:
            out[low] = have
            continue
        mid = (low + high) // 2
        draws = np.random.default_rng([seed, low, high])
        left = draws.multivariate_hypergeometric(have, int(ends[mid] - ends[low]), method="marginals")
        stack += [(low, mid, left), (mid, high, have - left)]
    return out


class Plan(NamedTuple):
    sources: DataFrame  # source, n_blocks, source_size, target
    draws: DataFrame  # source, block, epoch, shard, partly
    cuts: DataFrame  # source, cut (place in the block's order), part (words taken there)
    shards: int


def _place(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, text)


def _block(at: Column, n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + 1), at), n_blocks)


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> Plan:
    """sized: source, size, at (a hash of the document)."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, most)
    block_words = max(block_words, -(-sum(sizes) // MAX_BLOCKS))
    n_blocks = [max(1, -(-s // block_words)) for s in sizes]
    sources = spark.createDataFrame(
        [(r["source"], i, b, s, t) for i, (r, b, s, t) in enumerate(zip(rows, n_blocks, sizes, goal))],
        "source string, source_no int, n_blocks long, source_size long, target double",
    )
    dealt = sized.join(F.broadcast(sources.select(F.col("source").alias("_s"), "source_no", "n_blocks")), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source_no", _block(F.col("at"), F.col("n_blocks")).alias("block"), "size", "at"
    )
    words = [np.zeros(b, np.int64) for b in n_blocks]
    for r in dealt.groupBy("source_no", "block").agg(F.sum("size").alias("n")).collect():
        words[r["source_no"]][r["block"]] = r["n"]
    # the exact quota of every source: its tickets, in permuted order
    tickets, missing = [], {}
    for i, own in enumerate(words):
        need, mine, epoch = int(goal[i]), [], 0
        while need > 0:
            for b in np.random.default_rng([seed, 1_000_003, i, epoch]).permutation(len(own)):
                if need <= 0:
                    break
                partly = int(own[b]) > need
                mine.append((int(b), epoch, partly))
                if partly:
                    missing[i] = (int(b), need)
                need -= int(own[b])
            epoch += 1
        tickets.append(mine)
    shards = max(1, -(-int(sum(goal)) // shard_words))
    quotas = split_quotas(np.array([len(t) for t in tickets], np.int64), shards, seed) if rows else np.zeros((1, 0), np.int64)
    draws = []
    for i, mine in enumerate(tickets):
        shard_of = np.repeat(np.arange(shards), quotas[:, i])
        draws += [(i, b, e, int(s), p) for (b, e, p), s in zip(mine, shard_of)]
    draws = spark.createDataFrame(draws, "source_no int, block long, epoch int, shard int, partly boolean")
    # where the last block of a source meets its target
    short = spark.createDataFrame([(i, b, n) for i, (b, n) in missing.items()], "source_no int, block long, need long")
    order = Window.partitionBy("source_no").orderBy("at")
    cuts = (
        dealt.filter(F.col("size") > 0)
        .join(F.broadcast(short), ["source_no", "block"])
        .groupBy("source_no", "at", "need")
        .agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("copies"))
        .withColumn("before", F.sum("n").over(order) - F.col("n"))
        .filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
        .select("source_no", F.col("at").alias("cut"), F.floor((F.col("need") - F.col("before")) / F.col("copies")).alias("part"))
        .collect()
    )
    return Plan(sources, draws, spark.createDataFrame(cuts, "source_no int, cut long, part long"), shards)


def drawn(sized: DataFrame, p: Plan) -> DataFrame:
    """sized, with source_size, target, draws (array of epoch, shard, words, place) and taken (their words)."""
    mine = [F.col(f"`{c}`") for c in sized.columns]
    per_block = p.draws.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "partly"))).alias("_draws"))
    placed = (
        sized.join(F.broadcast(p.sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("block", _block(F.col("at"), F.col("n_blocks")))
        .join(F.broadcast(per_block), ["source_no", "block"], "left")
        .join(F.broadcast(p.cuts), "source_no", "left")
    )
    words = lambda d: F.when(~d["partly"] | (F.col("at") < F.col("cut")), F.col("size")).when(F.col("at") == F.col("cut"), F.col("part")).otherwise(0)
    used = F.filter(F.coalesce("_draws", F.array().cast("array<struct<epoch:int,shard:int,partly:boolean>>")), lambda d: ~d["partly"] | (F.col("at") <= F.col("cut")))
    draws = F.transform(used, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), words(d).alias("words"), F.xxhash64(d["shard"], d["epoch"], "at").alias("place")))
    return placed.select(*mine, "source_size", "target", draws.alias("draws")).withColumn(
        "taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    )


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), size(F.col(text)).alias("size"), _place(F.col(doc_id), F.col(text)).alias("at"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture: a row for each draw of a document, with all columns of docs and _epoch, _shard,
    _words, _place. The text of a document drawn in part holds its first _words words."""
    p = plan(written(_sized(docs, doc_id, text, source), "sizes"), **options)
    mine = docs.columns
    struct = docs.select(F.struct(*[F.col(f"`{c}`") for c in mine]).alias("_row"), F.col(source).cast("string").alias("source"), size(F.col(text)).alias("size"), _place(F.col(doc_id), F.col(text)).alias("at"))
    rows = drawn(struct, p).select("_row", "size", F.explode("draws").alias("d"))
    whole = F.col("_row")[text]
    cut = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), 1, F.col("d.words").cast("int")), " ")
    shown = [F.when(F.col("d.words") < F.col("size"), cut).otherwise(whole).alias(c) if c == text else F.col("_row")[c].alias(c) for c in mine]
    return rows.select(*shown, F.col("d.epoch").alias("_epoch"), F.col("d.shard").alias("_shard"), F.col("d.words").alias("_words"), F.col("d.place").alias("_place"))


def write_shards(mixture: DataFrame, path: str, shards: int) -> None:
    """mix()'s rows as a folder for each shard, its documents in shuffled order (by _place); shards: tasks that
    write. Documents without words are written as they are; an empty mixture writes no folder."""
    mixture.repartition(max(1, shards), "_shard").sortWithinPartitions("_shard", "_place").write.partitionBy("_shard").parquet(path)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(_sized(docs, "doc_id", "text", "source"), "sizes")
    return drawn(sized, plan(sized)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards")
    )
