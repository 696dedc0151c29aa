"""Chat formatting: snapshots of one growing conversation collapse to the longest, which is rendered.

A logged conversation that equals the first turns of a longer one is a snapshot of it. Every turn gets
a hash bound to its position; the running XOR of these is the hash of the prefix that ends there, in
two independent 64-bit halves. An anti-join against the proper prefixes of all conversations keeps the
maximal ones, and of equal conversations the one with the smallest conv_id stays. Only hashes are
shuffled for this; texts move once, for the conversations that stay.

Nulls and odd rows: rows without conv_id or turn belong to no conversation and are left out; a null
role or text counts as empty; rows that repeat wholly count once; rows that share a turn are ordered
by role and text; markers of the template inside a text or a role are broken up by spaces, so that neither
can forge a turn; columns of any other name are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryloom.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), text.alias("text")
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n (turns in all), p1 and p2 (the hash of the first pos turns)."""
    hashed = _turns(conversations).select(
        "conv_id",
        "turn",
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit("second"), "text", "role").alias("h2"),
    )
    one = hashed.repartition("conv_id").dropDuplicates(["conv_id", "turn", "h1", "h2"])
    mine = Window.partitionBy("conv_id")
    ordered = mine.orderBy("turn", "h1", "h2")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        one.withColumn("pos", F.row_number().over(ordered))
        .withColumn("p1", F.bit_xor(F.xxhash64("pos", "h1")).over(running))
        .withColumn("p2", F.bit_xor(F.xxhash64("h2", "pos")).over(running))
        .withColumn("n", F.count(F.lit(1)).over(mine))
        .select("conv_id", "pos", "n", "p1", "p2")
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies (equal conversations) of those that no longer one begins with."""
    found = prefixes(conversations)
    whole = found.filter(F.col("pos") == F.col("n")).groupBy("pos", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")
    )
    inner = found.filter(F.col("pos") < F.col("n")).select("pos", "p1", "p2").distinct()
    return whole.join(inner, ["pos", "p1", "p2"], "left_anti").select(
        "conv_id", F.col("pos").cast("long").alias("n_turns"), "copies"
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, copies, text (rendered)."""
    safe = lambda c: F.replace(F.replace(c, F.lit(START), F.lit("<| im_start |>")), F.lit(END), F.lit("<| im_end |>"))
    turns = _turns(conversations).select(
        "conv_id", F.struct("turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role").alias("h2"), safe("role").alias("role"), safe("text").alias("text")).alias("t")
    )
    kept = maximal(conversations)
    shown = F.transform(
        F.array_distinct(F.array_sort(F.collect_list("t"))),
        lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n")),
    )
    return (
        turns.join(kept, "conv_id")
        .groupBy("conv_id", "n_turns", "copies")
        .agg(F.array_join(shown, "").alias("text"))
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations")).withColumn("n_chars", F.length("text").cast("long"))


OP6_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn, role, text) AS m FROM t GROUP BY conv_id),
g AS (SELECT m, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY m),
k AS (SELECT * FROM g WHERE NOT EXISTS (
  SELECT 1 FROM g AS d WHERE len(d.m) > len(g.m) AND d.m[1:len(g.m)] = g.m)),
r AS (
  SELECT conv_id, CAST(len(m) AS BIGINT) AS n_turns, copies,
         array_to_string(list_transform(m, lambda e: '<|im_start|>' || replace(replace(e.r, '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') || chr(10) ||
           replace(replace(e.x, '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') || '<|im_end|>' || chr(10)), '') AS text
  FROM k)
SELECT *, CAST(length(text) AS BIGINT) AS n_chars FROM r
"""
