"""Queries on what is written: metadata documents, annotations, slice documents, totals and texts of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import elements as E
from quirespark.operators import htmltree, layout, replies
from quirespark.plans.inputs import EL, elements, longs, page_sizes, table
from quirespark.plans.layouts import _SLICES
from quirespark.plans.workflow import document_totals as totals
from quirespark.sources import files, sinks


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of documents of a hundred pages, with the columns of their types."""
    is_table = F.col("type") == "table"
    return elements(spark, sf_dir).select(
        (F.col("page") % 100).alias("doc_id"), F.col("page").cast("int").alias("page_number"), "type", F.col("idx").cast("int").alias("idx"), "x1", "y1", "x2", "y2",
        F.when(F.col("type") == "text", F.repeat(F.lit("word "), (F.col("idx") * 20).cast("int"))).alias("content"), F.when(is_table & (F.col("idx") % 2 == 0), "T").alias("label"), F.when(is_table, F.col("idx") % 3 / 2).alias("confidence"), F.when(is_table, F.col("idx") % 2 == 1).alias("refined"),
    )


def bbox_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata documents made and taken apart again: a document's summary with what its elements add up to."""
    whole = metadata_of_documents(spark, sf_dir)
    flat = files.metadata_elements(whole.withColumn("path", F.col("doc_id").cast("string")))
    back = flat.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n_elements"), F.sum(F.length("content")).alias("n_chars"), F.sum("confidence").alias("confidence"), F.count_if(F.col("label") == "T").alias("n_labelled"))
    return longs(whole.select("doc_id", "source_file", "summary.*").join(back, "doc_id", "left"))


def _documents(spark: SparkSession) -> DataFrame:
    return spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("in"), F.col("id").cast("string")).alias("source_file"), F.lit("out").alias("output_file"), F.lit("2025-01-01 00:00:00").alias("creation_time"), F.lit(100).alias("total_pages"))


def metadata_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.metadata(_described(spark, sf_dir), _documents(spark))


def metadata_in_parts(spark: SparkSession, sf_dir: str, pages: int = 2000) -> DataFrame:
    """Metadata of so many pages of a document at most in a row, which needs no more memory as documents grow; doc_id tells parts apart."""
    part = lambda page: F.floor(F.col(page) / (100 * pages)) * 100
    parts = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("doc_id"), part("l_orderkey").alias("part")).distinct()
    docs = _documents(spark).join(parts, "doc_id", "left").withColumn("doc_id", F.col("doc_id") + F.coalesce("part", F.lit(0))).drop("part")
    return sinks.metadata(_described(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + part("page_number")), docs)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(sinks.annotations(_described(spark, sf_dir)).select("page_number", "idx", "type", "color", "line_width", "drawn_label"))


def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over good pages; every thirteenth page of a document failed."""
    els = _described(spark, sf_dir)
    bad = els.filter("page_number % 13 = 0").select("doc_id", "page_number").distinct()
    good = els.filter("page_number % 13 <> 0")
    return longs(totals(good, bad).withColumn("failed_pages", F.array_join(F.transform("failed_pages", lambda p: p.cast("string")), ",")))


def images_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = elements(spark, sf_dir)
    return sinks.image_counts(els, els.filter("type = 'image'"), "page")


def slice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = elements(spark, sf_dir)
    info = layout.slice_info(layout.slices(layout.regions(els, page_sizes(els))))
    area = F.aggregate("slices", F.lit(0).cast("long"), lambda a, s: a + s["width"].cast("long") * s["height"])
    return longs(info.select("page", "layout_type", F.size("slices").alias("n_slices"), F.size("discarded_slices").alias("n_discarded"), area.alias("pixels"), F.get("discarded_slices", F.lit(0))["reason"].alias("reason")))


def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lambda *c: F.array(*(F.struct(x.alias("text")) for x in c))
    lines = F.array(F.struct(spans(F.lit(" "), F.col("p_name"), F.col("p_brand")).alias("spans")), F.struct(spans(F.col("p_type"), F.lit(" ")).alias("spans")))
    box = [F.lit(float(k)).alias(c) for k, c in enumerate(E.BOX)]
    items = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("block_type"), *box, lines.alias("lines"))
    return E.page_elements(items).select("p_partkey", "type", "content")


def point_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit('<points x1="'), F.col("p_size").cast("string"), F.lit('" y1="2" alt="'), F.col("p_brand"), F.lit('">'), F.col("p_name"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise("</points>"))
    p = replies.points(reply)
    return table(spark, sf_dir, "part").select("p_partkey", F.get(p["points"], F.lit(0))["x"].alias("x"), p["alt"].alias("alt"), p["phrase"].alias("phrase"))


def html_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with colors, positions and formula classes, cleaned."""
    style = F.when(F.col("s_suppkey") % 2 == 0, "color: red;").otherwise("color:blue; margin: 1px;")
    html = F.concat(F.lit('<html><body><p class="formula.handwritten formula" data-bbox="1 2 3 4" style="'), style, F.lit('">'), F.col("s_name"), F.lit('</p><div class="image caption">x</div></body></html>'))
    return table(spark, sf_dir, "supplier").select("s_suppkey", htmltree.clean_html(html).alias("html"))


QUERIES = {f.__name__: f for f in (bbox_metadata, annotations, document_totals, images_per_page, slice_documents, block_texts, point_replies, html_cleaned)}
_DESCRIBED = f"""{EL}, de AS (SELECT page % 100 AS doc_id, page AS page_number, type, idx, CASE WHEN type = 'text' THEN repeat('word ', idx * 20) END AS content, CASE WHEN type = 'table' AND idx % 2 = 0 THEN 'T' END AS label,
 CASE WHEN type = 'table' THEN CAST(idx % 3 AS DOUBLE) / 2 END AS confidence, CASE WHEN type = 'table' THEN idx % 2 = 1 END AS refined FROM el)"""
_N = "CAST(count(*) FILTER ({c}) AS BIGINT) AS {n}"
ORACLES = {
    "bbox_metadata": f"""{_DESCRIBED} SELECT CAST(d.id AS BIGINT) AS doc_id, 'in' || d.id AS source_file, """
    + ", ".join(f"CASE WHEN count(type) > 0 THEN {_N.format(c=c, n='x')[:-5]} END AS {n}" for n, c in (("total_text_blocks", "type = 'text'"), ("total_images", "type = 'image'"), ("total_tables", "type = 'table'"), ("refined_tables", "refined"), ("total_original_lines", "type = 'original_line'"), ("total_original_qwen_tables", "FALSE"), ("total_vector_graphics", "FALSE")))
    + """, CASE WHEN count(type) > 0 THEN count(type) END AS n_elements, CAST(sum(length(substring(content, 1, 200))) AS BIGINT) AS n_chars, CAST(sum(confidence) AS DOUBLE) AS confidence, CASE WHEN count(type) > 0 THEN CAST(count(*) FILTER (label = 'T') AS BIGINT) END AS n_labelled
        FROM range(100) d(id) LEFT JOIN de ON de.doc_id = d.id GROUP BY d.id""",
    "annotations": f"""{_DESCRIBED} SELECT page_number, idx, type, CASE type WHEN 'text' THEN 'blue' WHEN 'image' THEN 'green' WHEN 'table' THEN 'red' ELSE 'orange' END AS color, CAST(CASE WHEN refined THEN 4 ELSE 2 END AS BIGINT) AS line_width,
        CASE WHEN type = 'table' THEN CASE WHEN confidence < 1 THEN printf('%s %.2f', coalesce(label, 'null'), confidence) ELSE label END ELSE type || ' ' || (idx + 1) END AS drawn_label FROM de""",
    "document_totals": f"""{_DESCRIBED}, g AS (SELECT doc_id, {', '.join(_N.format(c=c, n=n) for n, c in (('n_text', "type = 'text'"), ('n_image', "type = 'image'"), ('n_table', "type = 'table'"), ('n_line', "type = 'original_line'"), ('n_vector', 'FALSE'), ('n_elements', "type IN ('text', 'image', 'table')"), ('n_all', "type IN ('text', 'image', 'table')")))} FROM de WHERE page_number % 13 <> 0 GROUP BY doc_id),
        b AS (SELECT doc_id, string_agg(page_number, ',' ORDER BY page_number) AS failed_pages FROM (SELECT DISTINCT doc_id, page_number FROM de WHERE page_number % 13 = 0) GROUP BY doc_id)
        SELECT doc_id, n_text, n_image, n_table, n_line, n_vector, n_elements, n_all, coalesce(failed_pages, '') AS failed_pages FROM g FULL JOIN b USING (doc_id)""",
    "images_per_page": f"{EL} SELECT page, count(*) FILTER (type = 'image') AS n_images FROM el GROUP BY page",
    "slice_documents": f"""{_SLICES} SELECT page, any_value(layout_type) AS layout_type, count(*) FILTER (NOT discarded) AS n_slices, count(*) FILTER (discarded) AS n_discarded, CAST(coalesce(sum((px2 - px1) * (py2 - py1)) FILTER (NOT discarded), 0) AS BIGINT) AS pixels,
        arg_min(printf('PDF box too small (%.1fx%.1fpx)', x2 - x1, y2 - y1), region_ord) FILTER (discarded) AS reason FROM cut JOIN lay USING (page) GROUP BY page""",
    "block_texts": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'text' ELSE 'image' END AS type, CASE p_partkey % 3 WHEN 0 THEN trim('  ' || p_name || ' ' || p_brand || ' ' || p_type || '  ') END AS content FROM part WHERE p_partkey % 3 < 2",
    "point_replies": "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS VARCHAR) END AS x, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS alt, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS phrase FROM part",
    "html_cleaned": """SELECT s_suppkey, '```html' || chr(10) || '<html><body>' || chr(10) || '<p class="formula"' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' style=" margin: 1px"' END || '>' || s_name || '</p> ' || chr(10) || ' <div class="image"></div> ' || chr(10) || '</body></html>' || chr(10) || '```' AS html FROM supplier""",
}
