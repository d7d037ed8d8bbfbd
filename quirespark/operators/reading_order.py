"""Reading order of positioned blocks: rows of equal height give columns, columns give the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.elements import PAGE


def columns(blocks: DataFrame, threshold: float = 50.0, row: float = 10.0, page: Sequence[str] = PAGE) -> DataFrame:
    """(page, centers, column_count, is_multi_column, confidence) of pages with a row of two blocks at least.

    Left edges of such rows are clustered where the gap to the one before is over the threshold.
    """
    key = F.bround(F.col("y1") / row) * row
    rows = blocks.withColumn("in_row", F.count("*").over(Window.partitionBy(*page, key))).filter("in_row >= 2")
    order = Window.partitionBy(*page).orderBy("x1")
    rows = rows.withColumn("cluster", F.sum(F.when(F.col("x1") - F.lag("x1").over(order) <= threshold, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = rows.groupBy(*page, "cluster").agg(F.avg("x1").alias("center"), F.count("*").alias("n"))
    return clusters.groupBy(*page).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cluster", "center"))), lambda c: c["center"]).alias("centers"),
        F.count("*").alias("column_count"),
        (F.count("*") >= 2).alias("is_multi_column"),
        (F.count_if(F.col("n") >= 2) / F.count("*")).alias("confidence"),
    )


def reading_order(blocks: DataFrame, threshold: float = 50.0, row: float = 20.0, page: Sequence[str] = PAGE) -> DataFrame:
    """blocks with read_ord from 1 and column_index (null on pages of one column). The nearest column is the first of equal distance."""
    found = columns(blocks, threshold, page=page).filter("is_multi_column").select(*page, "centers")
    rows = blocks.join(found, list(page), "left")
    gaps = F.transform("centers", lambda c: F.abs(F.col("x1") - c))
    rows = rows.withColumn("column_index", (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))
    multi = F.col("centers").isNotNull()
    first = F.when(multi, F.bround(F.col("y1") / row) * row).otherwise(F.col("y1"))
    order = Window.partitionBy(*page).orderBy(first, F.coalesce("column_index", F.lit(0)), "x1", "idx")
    return rows.withColumn("read_ord", F.row_number().over(order)).drop("centers")


def reorder_gate(blocks: DataFrame, threshold: float = 50.0, page: Sequence[str] = PAGE, gate: str = "page") -> DataFrame:
    """(page, n_blocks, status): reordered, or why a page is left as it is.

    gate: "page" looks at each page, "first_page" at the least page only and lets it decide for all (for compatibility).
    """
    n = blocks.groupBy(*page).agg(F.count("*").alias("n_blocks"))
    found = columns(blocks, threshold, page=page).select(*page, "is_multi_column")
    rows = n.join(found, list(page), "left").withColumn("multi", F.coalesce("is_multi_column", F.lit(False)))
    if gate == "first_page":
        first = rows.groupBy().agg(F.min_by("multi", F.struct(*page)).alias("first_multi"))
        rows = rows.join(F.broadcast(first)).withColumn("multi", F.col("first_multi"))  # one row
    return rows.select(*page, "n_blocks", F.when(F.col("multi"), "reordered").otherwise("single column").alias("status"))


def gate_counts(gated: DataFrame) -> DataFrame:
    """(status, n_pages)"""
    return gated.groupBy("status").agg(F.count("*").alias("n_pages"))
