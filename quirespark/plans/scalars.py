"""Queries on scalar geometry, replies, files and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import geometry as G
from quirespark.operators import replies
from quirespark.plans.inputs import EL, elements, longs, table
from quirespark.sources.sinks import keep_latest as newest


def geom_smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 3000 + 40).alias("h"), (F.col("p_size") * 61 + 40).cast("long").alias("w"))
    height, width = G.smart_resize(F.col("h"), F.col("w"))
    return longs(part.select("p_partkey", "h", "w", height.alias("input_height"), width.alias("input_width")))


def geom_pixel_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = G.pixel_crop(G.box(), F.lit(2550 / 612), F.lit(3300 / 792), F.lit(2550), F.lit(3300))
    return longs(elements(spark, sf_dir).select("page", "idx", *(c.alias(n) for c, n in zip(crop, ("px1", "py1", "px2", "py2"), strict=True)), G.too_small(G.box()).alias("discarded")))


def geom_model_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.model_to_page(G.Box(F.col("x2"), F.col("y1"), F.col("x1"), F.col("y2")), (F.lit(1120.0), F.lit(1456.0)), (F.lit(1700.0), F.lit(2200.0)), (F.lit(612.0), F.lit(792.0)))
    return elements(spark, sf_dir).select("page", "idx", *(F.round(c, 6).alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)))


def parse_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" ["), F.col("x1").cast("string"), F.lit(", -"), F.col("y1").cast("string"), F.when(F.col("idx") % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.col("x2").cast("string"))), F.lit("; "), F.when(F.col("idx") % 7 == 0, "1.2.3").otherwise(F.col("y2").cast("string")), F.lit("]"))
    b = G.parse_box(text)
    return elements(spark, sf_dir).select("page", "idx", *(c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)))


def reply_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of replies: one, two or none by part, some of them malformed."""
    item = lambda k, extra: F.concat(F.lit('{"bbox_2d": ['), *(x for n, m in enumerate((1, 2, 3, 4)) for x in ([F.lit(", ")] if n else []) + [(F.col("p_partkey") * m % 997 + k).cast("string")]), F.lit("]"), extra, F.lit("}"))
    one, two = item(0, F.concat(F.lit(', "label": "'), F.col("p_brand"), F.lit('", "confidence": 0.5'))), item(5, F.lit(""))
    reply = F.when(F.col("p_partkey") % 5 == 0, "no table here").when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("ok ["), one)).otherwise(F.concat(F.lit("Found: ["), one, F.lit(", "), two, F.lit(', {"label": "no box"}] end')))
    return longs(replies.detections(table(spark, sf_dir, "part").select("p_partkey", reply.alias("reply"))))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.operators.inference import RetryPolicy

    waits = RetryPolicy(max_retries=6, delay=2.0).waits()
    return spark.range(len(waits)).select(F.col("id").alias("attempt"), F.element_at(F.array(*map(F.lit, waits)), (F.col("id") + 1).cast("int")).alias("wait"))


def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a customer: what stays and what would go when the three newest stay."""
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("modified"))
    return newest(files, 3, ("name",)).select("name", "path", "keep")


QUERIES = {f.__name__: f for f in (geom_smart_resize, geom_pixel_crop, geom_model_to_page, parse_bbox, reply_detections, retry_schedule, keep_latest)}
ORACLES = {
    "geom_smart_resize": """WITH p AS (SELECT p_partkey, p_partkey * 37 % 3000 + 40 AS h, CAST(p_size * 61 + 40 AS BIGINT) AS w FROM part),
        s AS (SELECT *, CASE WHEN h * w < 401408 THEN sqrt(401408.0::DOUBLE / (h * w)) WHEN h * w > 1605632 THEN sqrt(1605632.0::DOUBLE / (h * w)) ELSE 1.0::DOUBLE END AS f FROM p)
        SELECT p_partkey, h, w, CAST((CAST(trunc(h * f) AS BIGINT) + 27) // 28 * 28 AS BIGINT) AS input_height, CAST((CAST(trunc(w * f) AS BIGINT) + 27) // 28 * 28 AS BIGINT) AS input_width FROM s""",
    "geom_pixel_crop": f"""{EL} SELECT page, idx, CAST(greatest(trunc(x1 * (2550.0::DOUBLE / 612)), 0) AS BIGINT) AS px1, CAST(greatest(trunc(y1 * (3300.0::DOUBLE / 792)), 0) AS BIGINT) AS py1, CAST(least(trunc(x2 * (2550.0::DOUBLE / 612)), 2550) AS BIGINT) AS px2,
        CAST(least(trunc(y2 * (3300.0::DOUBLE / 792)), 3300) AS BIGINT) AS py2, x2 - x1 <= 15 OR y2 - y1 <= 15 AS discarded FROM el""",
    "geom_model_to_page": f"""{EL} SELECT page, idx, round(x1 / 1120.0::DOUBLE * 1700 * (612.0::DOUBLE / 1700), 6) AS x1, round(y1 / 1456.0::DOUBLE * 2200 * (792.0::DOUBLE / 2200), 6) AS y1, round(x2 / 1120.0::DOUBLE * 1700 * (612.0::DOUBLE / 1700), 6) AS x2, round(y2 / 1456.0::DOUBLE * 2200 * (792.0::DOUBLE / 2200), 6) AS y2 FROM el""",
    "parse_bbox": f"{EL} SELECT page, idx, " + ", ".join(f"CASE WHEN idx % 5 <> 0 AND idx % 7 <> 0 THEN {c} END AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM el",
    "reply_detections": """SELECT p_partkey, CAST(k AS BIGINT) AS det_ord, """ + ", ".join(f"CAST(p_partkey * {m} % 997 + CASE k WHEN 0 THEN 0 ELSE 5 END AS DOUBLE) AS {c}" for m, c in enumerate(("x1", "y1", "x2", "y2"), 1)) + """,
        CASE k WHEN 0 THEN p_brand ELSE '表格' END AS label, CASE k WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM part, range(2) r(k) WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""",
    "retry_schedule": "SELECT attempt, CAST(2.0 * pow(1.5, attempt) AS DOUBLE) AS wait FROM range(6) r(attempt)",
    "keep_latest": "SELECT o_custkey AS name, CAST(o_orderkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) <= 3 AS keep FROM orders",
}
