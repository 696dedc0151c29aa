"""Section diffs between two versions of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryloom.functions.markdown import sections


def section_diff(df: DataFrame, old: str, new: str, key: str) -> DataFrame:
    """key, pos, type (added, changed, removed, unchanged), level, heading, content of every section.

    Sections pair by level, heading and occurrence, so a moved section is no change; what is compared is
    the text up to the next heading of the outline, so a child's change is not its parent's. pos is the
    order of a diff: new sections in their order, then removed ones in the old order."""
    occurrence = Window.partitionBy(key, "level", "heading").orderBy("ord")
    side = lambda c: sections(df, c, key).withColumn("nth", F.row_number().over(occurrence) - 1)
    a = side(old).select(key, "level", "heading", "nth", F.col("ord").alias("old_ord"), F.col("own_content").alias("old_own"))
    b = side(new).select(key, "level", "heading", "nth", F.col("ord").alias("new_ord"), F.col("own_content").alias("new_own"), "content")
    kind = (
        F.when(F.col("old_ord").isNull(), "added")
        .when(F.col("new_ord").isNull(), "removed")
        .when(F.col("old_own") != F.col("new_own"), "changed")
        .otherwise("unchanged")
    )
    return a.join(b, [key, "level", "heading", "nth"], "full_outer").select(
        key,
        F.coalesce(F.col("new_ord").cast("long"), F.col("old_ord") + F.lit(1 << 32)).alias("pos"),
        kind.alias("type"),
        "level",
        "heading",
        F.coalesce("content", F.lit("")).alias("content"),
    )


def diff_summary(diff: DataFrame, key: str) -> DataFrame:
    """key, added, changed, removed, all_changed: no section is as it was."""
    of = lambda t: F.count(F.when(F.col("type") == t, 1)).alias(t)
    return diff.groupBy(key).agg(of("added"), of("changed"), of("removed"), (F.count(F.when(F.col("type") == "unchanged", 1)) == 0).alias("all_changed"))


def answer_kind(eligible, old, new, changes, all_changed):
    """unchanged, diff or full: what a repeated fetch answers with."""
    return (
        F.when(~eligible | old.isNull(), "full").when(old == new, "unchanged").when((F.coalesce(changes, F.lit(0)) > 0) & ~F.coalesce(all_changed, F.lit(False)), "diff").otherwise("full")
    )
