"""Incremental conversion: the same page transforms on a stream of HTML pages. An extension, as the batch operators have no state.

Each micro-batch is converted by itself; counts by window tolerate late pages up to the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import htmltree, markdown


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """Pages of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def statistics_stream(pages: DataFrame) -> DataFrame:
    return htmltree.page_statistics(pages.select("page_id", "html"))


def counts_by_window(pages: DataFrame, time: str = "seen_at", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, n_pages, total_elements) of pages with an event time."""
    stats = htmltree.page_statistics(pages.select("page_id", time, "html")).withWatermark(time, late)
    return stats.groupBy(F.window(time, window)).agg(F.count("*").alias("n_pages"), F.sum("total_elements").alias("total_elements"))


def markdown_batches(sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch's (page_id, complete_md, clean_md) to sink, pages that come twice in a batch once."""

    def run(batch: DataFrame, _: int) -> None:
        pages = batch.select("page_id", "html").dropDuplicates(["page_id"])
        sink(markdown.page_markdown(htmltree.page_blocks(pages), pages))

    return run
