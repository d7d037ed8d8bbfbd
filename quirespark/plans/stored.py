"""Queries on files: tables are written to the shared folder, in the layouts of pages, slices, texts and documents, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions.geometry import Box, box, dpi_zoom, in_dense_window, line_box, rescaled
from quirespark.plans.inputs import EL, EL_LINES, elements, lines, longs, table
from quirespark.plans.outputs import ORACLES as OUTPUTS
from quirespark.plans.outputs import metadata_in_parts
from quirespark.sources import files, sinks


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share; on one machine a temporary one, removed at the end."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="quirespark-files-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return f"{at}/files"


def put(spark: SparkSession, path: str, named: Iterable[tuple[str, bytes]]) -> None:
    """A few small files, in whatever store the path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, content in named:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = at.getFileSystem(conf).create(at, True)
        out.write(content)
        out.close()


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """nation has 25 rows at every scale."""
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    named = [(f"page_{r.n_nationkey + 1}.html", f"<p>{r.n_name}</p>\n".encode()) for r in _nations(spark, sf_dir)]
    put(spark, path, [*named, ("cover.html", b"no page"), ("page_x.html", b"no page")])
    return files.html_pages(spark, path)


def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_pages(spark, sf_dir).select("page", "html"))


def file_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = files.html_directory_status(_pages(spark, sf_dir))
    return longs(status.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")))


def file_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice images in both orders, with their bytes as text; other files aren't slices."""
    path = folder(spark)
    put(spark, path, [*((f"page_{r.n_nationkey % 12 + 1}_slice_{r.n_nationkey // 12 + 1}.jpg", r.n_name.encode()) for r in _nations(spark, sf_dir)), ("page_1.html", b"x"), ("note.txt", b"y")])
    names = files.slice_images(spark, path, "lexicographic").select("path", F.col("ord").alias("name_ord"))
    content = files.available_images(spark.read.format("binaryFile").load(path)).select("path", files.encoded(F.col("content")).alias("content"))
    return longs(files.slice_images(spark, path).join(names, "path").join(content, "path").select("page", "slice", "ord", "name_ord", "content"))


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.col("n_name"), F.lit("\nof region "), F.col("n_regionkey").cast("string")).alias("text"))
    sinks.write_texts(rows, path, "text", ["n_nationkey"])
    return files.texts(spark, path).select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long").alias("n_nationkey"), "text")


def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata documents written as JSON, a file for so many pages of each, and read back: a document's summary with what its elements add up to."""
    path = folder(spark)
    sinks.write_json(metadata_in_parts(spark, sf_dir), path, ["doc_id"])
    whole = files.metadata_documents(spark, path)
    back = files.metadata_elements(whole).groupBy("source_file").agg(F.count("*").alias("n_elements"), F.sum(F.length("content")).alias("n_chars"), F.sum("confidence").alias("confidence"), F.count_if(F.col("label") == "T").alias("n_labelled"))
    counts = [f.name for f in whole.schema["summary"].dataType.fields]
    documents = whole.groupBy("source_file").agg(*(F.sum(f"summary.{n}").alias(n) for n in counts))
    return longs(documents.select(F.substring("source_file", 3, 20).cast("long").alias("doc_id"), "source_file", *counts).join(back, "source_file", "left"))


def image_detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.repeat(F.lit("x"), (F.col("p_size") * 1000 + 1).cast("int")), "utf-8")
    images = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("page_number"), (F.col("p_partkey") % 7 + 1).alias("img_ord"), F.lit("png").alias("format"), F.lit(100).alias("width"), F.lit(50).alias("height"), content.alias("content"))
    name = sinks.image_name(F.lit("doc"), F.col("page_number"), F.col("img_ord"), F.col("format"))
    done = sinks.progress(F.col("img_ord"), F.lit(7))
    return longs(sinks.image_details(images).select("p_partkey", "page_number", "img_ord", "format", "width", "height", "size", name.alias("name"), done.alias("done")))


def geom_dense_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = elements(spark, sf_dir).filter("type = 'text'")
    pairs = texts.alias("a").join(texts.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.idx") < F.col("b.idx")))
    return pairs.select("a.page", F.col("a.idx").alias("a_idx"), F.col("b.idx").alias("b_idx"), in_dense_window(box("a"), box("b")).alias("dense"))


def geom_line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of lines, on an image of 150 dpi and from there on one of 1000 by 1000."""
    b = line_box(*(F.col(c) for c in ("sx", "sy", "ex", "ey")))
    zoom = dpi_zoom(F.lit(150))
    big = Box(*(v * zoom for v in b))
    small = rescaled(big, F.lit(1275.0), F.lit(1650.0), F.lit(1000), F.lit(1000))
    names = ("x1", "y1", "x2", "y2")
    return longs(lines(spark, sf_dir).select("page", "line_ord", *(v.alias(f"line_{n}") for n, v in zip(names, b, strict=True)), *(v.alias(f"scaled_{n}") for n, v in zip(names, small, strict=True))))


QUERIES = {f.__name__: f for f in (file_pages, file_directory, file_slices, file_texts, file_metadata, image_detail_rows, geom_dense_window, geom_line_boxes)}
_WINDOW = "greatest(0, least((a.x1 + a.x2) / 2 + 15, b.x2) - greatest((a.x1 + a.x2) / 2 - 15, b.x1)) * greatest(0, least((a.y1 + a.y2) / 2 + 15, b.y2) - greatest((a.y1 + a.y2) / 2 - 15, b.y1)) / least(900.0, (b.x2 - b.x1) * (b.y2 - b.y1))"
ORACLES = {
    "file_pages": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS page, '<p>' || n_name || '</p>' || chr(10) AS html FROM nation",
    "file_directory": "SELECT count(*) > 0 AS valid, count(*) AS n_files, string_agg(n_nationkey + 1, ',' ORDER BY n_nationkey) AS pages FROM nation",
    "file_slices": """WITH s AS (SELECT CAST(n_nationkey % 12 + 1 AS BIGINT) AS page, CAST(n_nationkey // 12 + 1 AS BIGINT) AS slice, to_base64(encode(n_name)) AS content FROM nation)
        SELECT page, slice, row_number() OVER (ORDER BY page, slice) AS ord, row_number() OVER (ORDER BY 'page_' || page || '_slice_' || slice || '.jpg') AS name_ord, content FROM s""",
    "file_texts": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || chr(10) || 'of region ' || n_regionkey || chr(10) AS text FROM nation",
    "file_metadata": OUTPUTS["bbox_metadata"],
    "image_detail_rows": """SELECT p_partkey, CAST(p_size AS BIGINT) AS page_number, CAST(p_partkey % 7 + 1 AS BIGINT) AS img_ord, 'png' AS format, CAST(100 AS BIGINT) AS width, CAST(50 AS BIGINT) AS height, printf('%.1f KB', (p_size * 1000 + 1) / 1024.0) AS size,
        'doc_page_' || p_size || '_' || (p_partkey % 7 + 1) || '.png' AS name, round(CAST(p_partkey % 7 + 1 AS DOUBLE) / 7 * 100, 1) AS done FROM part""",
    "geom_dense_window": f"""{EL} SELECT a.page, a.idx AS a_idx, b.idx AS b_idx, (abs((b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2) <= 15 AND abs((b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2) <= 15) OR {_WINDOW} > 0.1 AS dense
        FROM el a JOIN el b ON a.page = b.page AND a.idx < b.idx WHERE a.type = 'text' AND b.type = 'text'""",
    "geom_line_boxes": f"""{EL_LINES}, b AS (SELECT page, line_ord, least(sx, ex) AS line_x1, least(sy, ey) AS line_y1, greatest(sx, ex) AS line_x2, greatest(sy, ey) AS line_y2 FROM ln)
        SELECT *, """
    + ", ".join(f"CAST(trunc(line_{n} * (150 / 72.0::DOUBLE) / {side}::DOUBLE * 1000) AS BIGINT) AS scaled_{n}" for n, side in (("x1", 1275.0), ("y1", 1650.0), ("x2", 1275.0), ("y2", 1650.0)))
    + " FROM b",
}
