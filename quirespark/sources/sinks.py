"""Writers: metadata documents, files by page, and which files a cleanup would keep."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.names import unused

#: The colors of annotations by type, and factors of their line width.
COLORS = {"text": "blue", "image": "green", "table": "red", "original_line": "orange", "original_qwen_table": "purple", "vector_graphic": "magenta"}
PREVIEW = 200
COMPONENTS = {"component_types": "map<string,int>", "component_count": "int", "component_details": "array<struct<type: string, bbox: array<double>, index: int>>"}


def metadata(elements: DataFrame, documents: DataFrame, by: str = "doc_id") -> DataFrame:
    """(source_file, output_file, creation_time, total_pages, summary, pages) of documents (by, source_file, output_file, creation_time, total_pages).

    elements: by, page_number, type, idx, x1, y1, x2, y2, content, label, confidence, refined, and for vector graphics
    component_types, component_count, component_details if there are any.
    """
    of_vector = [F.col(c) if c in elements.columns else F.lit(None).cast(t).alias(c) for c, t in COMPONENTS.items()]
    content = F.when(F.col("type") == "text", F.substring("content", 1, PREVIEW))
    table = lambda c, default: F.when(F.col("type").isin("table", "original_qwen_table"), F.coalesce(c, F.lit(default)))
    one = F.struct("type", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("idx").alias("index"), content.alias("content"), table("label", "表格").alias("label"), table("confidence", 1.0).alias("confidence"), table("refined", False).alias("refined"), *of_vector)
    own = unused(elements, "element")
    rows = elements.withColumn(own, one)
    # elements hold maps, which have no order of their own
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "type", own)), lambda a, b: F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).when(a["type"] < b["type"], -1).when(a["type"] > b["type"], 1).otherwise(0)), lambda r: r[own])
    pages = rows.groupBy(by, "page_number").agg(ordered.alias("elements"), *(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in COLORS), F.count_if((F.col("type") == "table") & F.coalesce("refined", F.lit(False))).alias("n_refined"))
    total = lambda c, name: F.sum(c).cast("int").alias(name)
    whole = pages.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("page_number").cast("string"), F.struct("page_number", "elements")))).alias("pages"),
        F.struct(total("n_text", "total_text_blocks"), total("n_image", "total_images"), total("n_table", "total_tables"), total("n_refined", "refined_tables"), total("n_original_line", "total_original_lines"), total("n_original_qwen_table", "total_original_qwen_tables"), total("n_vector_graphic", "total_vector_graphics")).alias("summary"),
    )
    return documents.join(whole, by, "left").select(by, "source_file", "output_file", "creation_time", "total_pages", "summary", "pages")


def write_json(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A JSON document per row, in a folder per key of `by`."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "true")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_texts(rows: DataFrame, path: str, text: str, by: Sequence[str]) -> None:
    """Texts (HTML, Markdown) as files, in a folder per key."""
    rows.select(*by, F.col(text).alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy(*by).text(path)


def annotations(elements: DataFrame, width: int = 2) -> DataFrame:
    """elements with the color, line width and label with which they would be drawn."""
    color = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in COLORS.items() for x in pair)), F.col("type")), F.lit("black"))
    line = F.lit(width) * F.when(F.col("type") == "vector_graphic", 3).when(F.col("refined"), 2).otherwise(1)
    score = F.when(F.col("confidence") < 1.0, F.format_string("%s %.2f", "label", "confidence")).otherwise(F.col("label"))
    label = F.when(F.col("type") == "table", score).otherwise(F.concat_ws(" ", "type", (F.col("idx") + 1).cast("string")))
    return elements.withColumns({"color": color, "line_width": line, "drawn_label": label})


def keep_latest(files: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """files (by, path, modified) with keep: whether it is of the n newest. Nothing is deleted."""
    newest = Window.partitionBy(*by).orderBy(F.desc("modified"), F.desc("path"))
    return files.withColumn("keep", F.row_number().over(newest) <= n)


def image_counts(pages: DataFrame, images: DataFrame, page: str = "page_number") -> DataFrame:
    """(page, n_images) of all pages, also those without images."""
    counts = images.groupBy(page).agg(F.count("*").alias("n"))
    return pages.select(page).distinct().join(counts, page, "left").select(page, F.coalesce("n", F.lit(0)).alias("n_images"))


def image_details(images: DataFrame) -> DataFrame:
    """images (page_number, img_ord, format, width, height, content) with the size as text in KB."""
    return images.withColumn("size", F.concat(F.format_string("%.1f", F.length("content") / 1024), F.lit(" KB"))).drop("content")


def image_name(prefix: Column, page: Column, ordinal: Column, extension: Column) -> Column:
    return F.concat(prefix, F.lit("_page_"), page.cast("string"), F.lit("_"), ordinal.cast("string"), F.lit("."), extension)


def progress(done: Column, total: Column) -> Column:
    return F.round(done / F.greatest(total, F.lit(1)) * 100, 1)


def zip_bundle(paths: Sequence[str]) -> bytes:
    """Local files as one archive; missing ones are left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
        for p in map(Path, paths):
            if p.is_file():
                bundle.write(p, p.name)
    return out.getvalue()
