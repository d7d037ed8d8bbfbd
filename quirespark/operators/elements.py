"""Set operators on page elements: rows (page keys, idx, type, x1, y1, x2, y2, ...).

Joins are on the page keys, which makes them hash joins with the geometry as a residual; nothing compares elements of
different pages. Page-local algorithms that depend on order run as grouped kernels (see kernels.py).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirespark.functions.geometry import box, overlap_ratio, overlaps, struct_box
from quirespark.operators import kernels

PAGE = ("page",)
BOX = ("x1", "y1", "x2", "y2")
#: Types of elements, in the order of the combined list.
PRIORITY = ("table", "vector_graphic", "image", "text", "original_line", "original_qwen_table")
CONTENT = ("text", "image", "table")


def _same_page(page: Sequence[str]) -> Column:
    met = F.lit(True)
    for c in page:
        met = met & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return met


def without_overlaps(left: DataFrame, right: DataFrame, threshold: float = 0.3, page: Sequence[str] = PAGE) -> DataFrame:
    """Rows of left that overlap no row of right on their page."""
    return left.alias("a").join(right.select(*page, *BOX).alias("b"), _same_page(page) & overlaps(box("a"), box("b"), threshold), "left_anti")


def text_without_tables(elements: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    return without_overlaps(elements.filter("type = 'text'"), elements.filter("type = 'table'"), 0.3, page)


def tables_without_images(elements: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    return without_overlaps(elements.filter("type = 'table'"), elements.filter("type = 'image'"), 0.3, page)


def overlapping_pairs(elements: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """(page, a_idx, b_idx, ratio) of the pairs a_idx < b_idx of a page that overlap."""
    pairs = elements.alias("a").join(elements.alias("b"), _same_page(page) & (F.col("a.idx") < F.col("b.idx")))
    ratio = overlap_ratio(box("a"), box("b"))
    return pairs.select(*(F.col(f"a.{c}") for c in page), F.col("a.idx").alias("a_idx"), F.col("b.idx").alias("b_idx"), ratio.alias("ratio")).filter("ratio > 0")


def suppress_duplicates(images: DataFrame, threshold: float = 0.8, page: Sequence[str] = PAGE) -> DataFrame:
    """Non-maximum suppression: largest area first (then idx), dropping what overlaps a kept one; new idx from 0.

    A fold over the page's own array: no self-join, and no Python.
    """
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    ranked = images.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct((-area).alias("less"), F.col("idx"), *BOX))).alias("ranked"))

    def step(kept: Column, one: Column) -> Column:
        covered = F.exists(kept, lambda k: overlaps(struct_box(k), struct_box(one), threshold))
        return F.when(covered, kept).otherwise(F.concat(kept, F.array(one)))

    # an empty array of the right type to begin with
    kept = F.aggregate("ranked", F.filter("ranked", lambda r: F.lit(False)), step)
    return ranked.select(*page, F.posexplode(kept).alias("idx", "one")).select(*page, "idx", F.col("one.idx").alias("source_idx"), *(F.col(f"one.{c}") for c in BOX))


def priority_union(elements: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """All elements of a page in one order: tables, vector graphics, images, texts, lines, tables as predicted."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("type")), F.lit(0))
    rank = F.when(order > 0, order).otherwise(len(PRIORITY) + 1)
    return elements.withColumn("ord", F.row_number().over(Window.partitionBy(*page).orderBy(rank, "idx")))


def reindexed(elements: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """idx from 0 within page and type, in the order of the old one."""
    return elements.withColumn("new_idx", F.row_number().over(Window.partitionBy(*page, "type").orderBy("idx")) - 1)


def summary(elements: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Counts by type; n_elements leaves vector graphics out, n_all doesn't."""
    of = lambda t: F.count_if(F.col("type") == t)
    kinds = {"n_text": "text", "n_image": "image", "n_table": "table", "n_line": "original_line", "n_vector": "vector_graphic"}
    return elements.groupBy(*by).agg(
        *(of(t).alias(name) for name, t in kinds.items()),
        F.count_if(F.col("type").isin(*CONTENT)).alias("n_elements"),
        F.count_if(F.col("type").isin(*CONTENT, "vector_graphic")).alias("n_all"),
    )


def type_histogram(elements: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """(page, component_types, component_count, x1, y1, x2, y2): what a group of elements merges into."""
    counts = elements.groupBy(*by, "type").agg(F.count("*").cast("int").alias("n"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    types = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))
    return counts.groupBy(*by).agg(types.alias("component_types"), F.sum("n").cast("int").alias("component_count"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def _by_page(rows: DataFrame, page: str, kernel, schema: str) -> DataFrame:
    """A page-local kernel over rows with idx: one shuffle on the page, a sort within partitions, and pages by the batch."""
    run = kernels.page_by_page(page, kernel, [page, *StructType.fromDDL(schema).fieldNames()])
    return rows.withColumn(page, F.col(page).cast("long")).repartition(page).sortWithinPartitions(page, "idx").mapInArrow(run, f"{page} long, {schema}")


def merge_texts(texts: DataFrame, tables: DataFrame, distance: float = 5.0, page: str = "page") -> DataFrame:
    """(page, ord, x1, y1, x2, y2, content, n_merged): texts nearer than `distance` become one, except near a table. Pages are numbers."""
    rows = texts.select(page, F.lit(True).alias("is_text"), "idx", *BOX, "content").unionByName(tables.select(page, F.lit(False).alias("is_text"), "idx", *BOX, F.lit(None).cast("string").alias("content")))
    return _by_page(rows, page, kernels.merge_texts_of_page(page, distance), "ord int, x1 double, y1 double, x2 double, y2 double, content string, n_merged int")


def merge_vector_graphics(elements: DataFrame, side: float = 30.0, rounds: int = 10, page: str = "page") -> DataFrame:
    """Elements of a page with dense groups that hold a line and an image merged into vector graphics. Pages are numbers."""
    schema = "ord int, type string, x1 double, y1 double, x2 double, y2 double, component_types map<string,int>, component_details array<struct<type string, x1 double, y1 double, x2 double, y2 double, idx long>>, component_count int"
    return _by_page(elements.select(page, F.col("idx").cast("long").alias("idx"), "type", *BOX), page, kernels.vector_graphics_of_page(page, side, rounds), schema)


def union_box(elements: DataFrame, by: Sequence[str]) -> DataFrame:
    return elements.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def block_text(lines: Column) -> Column:
    """The text of a block of lines of spans: every span's text, joined by spaces."""
    return F.trim(F.array_join(F.flatten(F.transform(lines, lambda line: F.transform(line["spans"], lambda s: s["text"]))), " "))


def page_elements(blocks: DataFrame) -> DataFrame:
    """Elements of raw page items (block_type 0: text, 1: image) with the text of their spans."""
    kind = F.when(F.col("block_type") == 0, "text").when(F.col("block_type") == 1, "image")
    return blocks.withColumn("type", kind).filter(F.col("type").isNotNull()).withColumn("content", F.when(F.col("type") == "text", block_text(F.col("lines"))))


def whole_page(elements: DataFrame, show_lines: bool = False, page: str = "page") -> DataFrame:
    """(page, idx, type, x1, y1, x2, y2, ord): the whole page, in one shuffle. elements: page, idx, type, box and content; pages are numbers.

    Tables give way to images, of which the largest stay; texts are merged and give way to tables; lines, where they are shown, may join
    images and texts as vector graphics, which take in no table. One list, in the order of priority_union(). Tables as predicted
    take no part in the rest. Elements of other types go.
    """
    rows = elements.filter(F.col("type").isin(*PRIORITY)).select(page, F.col("idx").cast("long").alias("idx"), "type", *BOX, "content")
    return _by_page(rows, page, kernels.whole_page(page, show_lines, PRIORITY), "idx long, type string, x1 double, y1 double, x2 double, y2 double, ord int")


def process_page(texts: DataFrame, images: DataFrame, tables: DataFrame, lines: DataFrame, show_lines: bool = False, page: str = "page", predicted: DataFrame | None = None) -> DataFrame:
    """whole_page() of the elements of each kind, which come apart; tables as predicted, before their borders were snapped, come last where they are given."""
    part = lambda df, t: df.select(page, F.col("idx").cast("long").alias("idx"), F.lit(t).alias("type"), *BOX, (F.col("content") if t == "text" else F.lit(None)).cast("string").alias("content"))
    parts = part(texts, "text").unionByName(part(images, "image")).unionByName(part(tables, "table"))
    if show_lines:
        parts = parts.unionByName(part(lines, "original_line"))
    if predicted is not None:
        parts = parts.unionByName(part(predicted, "original_qwen_table"))
    return whole_page(parts, show_lines, page)
