"""Clusters of text blocks by where they lie on a rendered page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP, ALIGN, MIN_CHARS = 2.5, 40, 200  # fixed values


def column_of(blocks: list[tuple[float, float, float, float]]) -> list[int]:
    """x, y, width, height in order of (y, x) -> number of the column each joins: the first whose last block
    starts within ALIGN of it and ends at most GAP average heights above it."""
    last: list[tuple[float, float, float]] = []
    out = []
    for x, y, _, height in blocks:
        at = next((i for i, (lx, bottom, lh) in enumerate(last) if abs(x - lx) <= ALIGN and y - bottom <= max((lh + height) / 2, 1) * GAP), len(last))
        last[at : at + 1] = [(x, y + height, height)]
        out.append(at)
    return out


def cluster_blocks(blocks: DataFrame, page: str) -> DataFrame:
    """blocks (page, id, x, y, width, height, text_length) with column; blocks without text or area are left out."""
    kept = blocks.filter((F.col("text_length") > 0) & (F.col("width") > 0) & (F.col("height") > 0)).select(page, "id", "x", "y", "width", "height", "text_length")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        return pdf.assign(column=column_of(list(zip(pdf["x"], pdf["y"], pdf["width"], pdf["height"]))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.groupBy(page).applyInPandas(assign, f"{fields}, `column` int")


def main_cluster(blocks: DataFrame, page: str) -> DataFrame:
    """page, block_ids, text_length, left, top, right, bottom of the column with most text, the first of equals."""
    boxed = cluster_blocks(blocks, page).groupBy(page, "column").agg(
        F.array_sort(F.collect_list(F.struct("y", "x", "id"))).alias("_ids"),
        F.sum("text_length").alias("text_length"),
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        F.max(F.col("x") + F.col("width")).alias("right"),
        F.max(F.col("y") + F.col("height")).alias("bottom"),
    )
    best = Window.partitionBy(page).orderBy(F.desc("text_length"), "column")
    return boxed.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(
        page, F.transform("_ids", lambda x: x["id"]).alias("block_ids"), "text_length", "left", "top", "right", "bottom"
    )
