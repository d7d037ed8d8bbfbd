"""Readers: HTML directories, Markdown, slice images, and bbox metadata documents, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.functions.text import is_blank

#: File names that are read.
PAGE_FILE, SLICE_FILE = r"page_(\d+)\.html$", r"page_(\d+)_slice_(\d+)\.jpg$"
IMAGE_FILE = r"(?i)\.(?:jpg|jpeg|png|gif|bmp)$"
DETAIL = "struct<type: string, bbox: array<double>, index: int>"
ELEMENT = f"struct<type: string, bbox: array<double>, index: int, content: string, label: string, confidence: double, refined: boolean, component_types: map<string, int>, component_count: int, component_details: array<{DETAIL}>>"
METADATA = (
    "source_file string, output_file string, creation_time string, total_pages int, "
    "summary struct<total_text_blocks: int, total_images: int, total_tables: int, refined_tables: int, total_original_lines: int, total_original_qwen_tables: int, total_vector_graphics: int>, "
    f"pages map<string, struct<page_number: int, elements: array<{ELEMENT}>>>"
)


def texts(spark: SparkSession, path: str, name: str = "text") -> DataFrame:
    """(path, text) of whole UTF-8 files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(name))


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, html) of files page_{n}.html; other files aren't pages."""
    rows = texts(spark, path, "html")
    return rows.filter(F.col("path").rlike(PAGE_FILE)).select("path", F.regexp_extract("path", PAGE_FILE, 1).cast("int").alias("page"), "html")


def html_directory_status(pages: DataFrame) -> DataFrame:
    """(valid, n_files, pages): whether there is any page, and the pages in numeric order."""
    return pages.agg((F.count("*") > 0).alias("valid"), F.count("*").alias("n_files"), F.array_sort(F.collect_list("page")).alias("pages"))


def slice_images(spark: SparkSession, path: str, order: str = "numeric") -> DataFrame:
    """(path, page, slice, ord) of slice images; ord counts from 1, by numbers or, for compatibility, by name ("lexicographic")."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").filter(F.col("path").rlike(SLICE_FILE))
    return numbered_slices(rows, order)


def numbered_slices(rows: DataFrame, order: str = "numeric") -> DataFrame:
    rows = rows.select("path", F.regexp_extract("path", SLICE_FILE, 1).cast("int").alias("page"), F.regexp_extract("path", SLICE_FILE, 2).cast("int").alias("slice"))
    folder = F.regexp_replace("path", r"[^/]+$", "")
    by = ["page", "slice"] if order == "numeric" else ["path"]
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(folder).orderBy(*by)))


def available_images(paths: DataFrame) -> DataFrame:
    return paths.filter(F.col("path").rlike(IMAGE_FILE))


def markdown_status(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with valid, message and content_length of their Markdown."""
    empty = is_blank(F.coalesce(F.col(text), F.lit("")))
    return rows.withColumns({"valid": ~empty, "message": F.when(empty, "empty content").otherwise("valid content"), "content_length": F.length(text)})


def encoded(content: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def metadata_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_file, ..., pages) of bbox metadata documents."""
    return spark.read.schema(METADATA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).withColumn("path", F.col("_metadata.file_path"))


def metadata_elements(documents: DataFrame) -> DataFrame:
    """Elements of metadata documents, one a row; those without a whole box are left out."""
    pages = documents.select("path", "source_file", F.explode("pages").alias("key", "page"))
    rows = pages.select("path", "source_file", F.col("page.page_number").alias("page_number"), F.posexplode("page.elements").alias("elem_ord", "e")).filter(F.size("e.bbox") >= 4)
    box = [F.get("e.bbox", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select("path", "source_file", "page_number", "elem_ord", F.col("e.type").alias("type"), F.col("e.index").alias("idx"), *box, "e.content", "e.label", "e.confidence", "e.refined", "e.component_types", "e.component_count", "e.component_details")
