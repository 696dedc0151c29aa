"""Benchmark decontamination: which documents repeat passages of a test set, and their removal.

A broadcast hash set holds the normalised n-grams of the test items; training windows are scanned
against it, hits are verified on the words themselves, and spans or whole documents go.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. A window is WINDOW consecutive
words of an item; an item of fewer words, but not none, is one window. Every window of WINDOW words
holds an aligned run of ANCHOR words that starts at a multiple of STRIDE (STRIDE + ANCHOR - 1 =
WINDOW), so only a quarter of a document's positions are looked up; around each hit all windows are
compared word by word. Nothing is missed and nothing is matched by hash alone.

Nulls and odd rows: a null or wordless text has no words and no hits; an item without an id marks
words as hit but is not counted; rows that repeat are each reported; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm.common import ascii_lower, fresh, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, ANCHOR, STRIDE = 8, 5, 4
#: A document that repeats this many words of the benchmark is contaminated, whatever the items.
MIN_HIT = 13
#: Windows of the benchmark that may be broadcast (about 100 bytes each); beyond it the joins shuffle.
BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(toks: Column, start: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), F.slice(toks, start + 1, F.lit(n)))


def _upto(last: Column, step: int = 1) -> Column:
    """0, step, 2 step ... not beyond last; empty if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each distinct window: win, len, anchors (hashes of what is looked up), items."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("toks"))
    cut = F.transform(
        _upto(F.greatest(F.size("toks") - WINDOW, F.lit(0))), lambda s: F.slice(F.col("toks"), s + 1, WINDOW)
    )
    wins = items.filter(F.size("toks") > 0).select("item", F.explode(cut).alias("w"))
    whole = F.transform(_upto(F.lit(WINDOW - ANCHOR)), lambda s: _gram(F.col("w"), s, ANCHOR))
    short = [F.when(F.size("w") == n, F.array(_gram(F.col("w"), F.lit(0), n))) for n in range(1, WINDOW)]
    return (
        wins.select("item", F.concat_ws(" ", "w").alias("win"), F.size("w").alias("len"), F.coalesce(*short, whole).alias("anchors"))
        .groupBy("win", "len")
        .agg(F.first("anchors").alias("anchors"), F.collect_set("item").alias("items"))
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row for each distinct (doc_id, text): id, text_hash, copies, n_words, hits (positions of
    hit words, ascending), items (ids of items with occurring windows, sorted as strings)."""
    wins = benchmark_windows(benchmark).persist()
    try:
        stats = wins.agg(F.count(F.lit(1)), F.collect_set(F.when(F.col("len") < WINDOW, F.col("len")))).first()
    finally:
        wins.unpersist()
    small = F.broadcast if stats[0] <= broadcast_windows else (lambda df: df)
    anchors = small(wins.select(F.explode("anchors").alias("gram")).distinct().withColumn("known", F.lit(True)))

    toks = F.col("toks")
    def looked_up(n: int) -> Column:
        """pos, len and gram of every place where a window of n words may start, or its anchor if n is WINDOW."""
        size, step = (ANCHOR, STRIDE) if n == WINDOW else (n, 1)
        return F.transform(_upto(F.size(toks) - size, step), lambda s: F.struct(s.alias("pos"), F.lit(n).alias("len"), _gram(toks, s, size).alias("gram")))

    lookups = [looked_up(n) for n in sorted({WINDOW, *stats[1]})]
    # one row a document whatever is met; its keys are the document's own, so that these rows are dealt evenly
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.col("text_hash").alias("gram")))
    scan = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words(F.col(text)).alias("toks"))
    found = (
        scan.select("*", F.explode(F.concat(mark, *lookups)).alias("g"))
        .select("id", "text_hash", "toks", "g.pos", "g.len", "g.gram")
        .join(anchors, "gram", "left")
        .filter((F.col("pos") < 0) | F.col("known"))
    )
    # all windows that hold the anchor that was met
    first = F.when(F.col("len") == WINDOW, F.greatest(F.col("pos") - (WINDOW - ANCHOR), F.lit(0))).otherwise(F.col("pos"))
    last = F.when(F.col("len") == WINDOW, F.least(F.col("pos"), F.size(toks) - WINDOW)).otherwise(F.col("pos"))
    around = F.when(
        (F.col("pos") >= 0) & (first <= last),
        F.transform(
            F.sequence(first, F.greatest(first, last)),
            lambda s: F.struct(s.alias("start"), F.concat_ws(" ", F.slice(toks, s + 1, F.col("len"))).alias("win")),
        ),
    )
    seen = found.select("id", "text_hash", F.size(toks).alias("n_words"), "pos", "len", F.explode_outer(around).alias("w"))
    met = seen.select("id", "text_hash", "n_words", "pos", "len", "w.start", F.coalesce("w.win", F.col("text_hash").cast("string")).alias("win")).join(
        small(wins.select("win", "len", "items")), ["win", "len"], "left"
    )
    hit = F.when(F.col("items").isNotNull(), F.struct("start", "len"))
    return (
        met.groupBy("id", "text_hash", "n_words")
        .agg(
            F.count(F.when(F.col("pos") < 0, 1)).alias("copies"),
            F.collect_set(hit).alias("at"),
            F.collect_set("items").alias("items"),
        )
        .select(
            "id",
            "text_hash",
            "copies",
            F.col("n_words").cast("long").alias("n_words"),
            F.array_sort(
                F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a["start"], a["start"] + a["len"] - 1))))
            ).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        )
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "both",
    min_items: int = 2,
    min_hit: int = MIN_HIT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """docs, all columns kept, without what repeats the benchmark.

    A document is contaminated if windows of at least min_items items occur in it, or at least min_hit of
    its words are hit. remove="documents" drops contaminated documents, "spans" cuts the hit words out of
    all documents, each together with what separates it from the word before, and "both" drops the
    contaminated and cuts the others."""
    if remove not in ("documents", "spans", "both"):
        raise ValueError("remove is documents, spans or both")
    bad = (F.size("items") >= min_items) | (F.size("hits") >= min_hit)
    found = contamination(docs, benchmark, doc_id, text).filter(bad if remove == "documents" else F.size("hits") > 0)
    key, of, their, its_hits, is_bad = (fresh(docs, c) for c in ("_text_hash", "_bad_id", "_bad_hash", "_bad_hits", "_bad"))
    mine = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    met = found.select(F.col("id").alias(of), F.col("text_hash").alias(their), F.col("hits").alias(its_hits), bad.alias(is_bad))
    on = keyed[doc_id].eqNullSafe(met[of]) & (keyed[key] == met[their])
    if remove == "documents":
        return keyed.join(met, on, "left_anti").select(*mine)
    word, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"{gap}*{word}+"), F.lit(0))
    tail = F.regexp_extract(F.col(text), f"({gap}*)\\z", 1)
    kept = F.filter(pieces, lambda _, i: ~F.array_contains(F.col(its_hits), i))
    cut = F.when(F.col(its_hits).isNull(), F.col(text)).otherwise(F.concat(F.array_join(kept, ""), tail))
    rows = keyed.join(met, on, "left")
    if remove == "both":
        rows = rows.filter(F.col(is_bad).isNull() | ~F.col(is_bad))
    return rows.withColumn(text, cut).select(*mine)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[s:s + 7], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.rid, dw.s, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m WHERE item IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(i.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""
