"""Tables of a scale, and element tables derived from lineitem in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 612.0, 792.0
#: Elements of pages: integer-valued doubles, so that arithmetic is exact in any engine.
ELEMENTS = """
SELECT l_orderkey AS page,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx,
       CASE l_linenumber % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'image' WHEN 2 THEN 'original_line' ELSE 'text' END AS type,
       CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x1 + w AS DOUBLE) AS x2, CAST(y1 + h AS DOUBLE) AS y2
FROM (SELECT *, (l_partkey * 37) % 330 AS x1, CAST(round(l_extendedprice * 100) AS BIGINT) % 680 AS y1,
             20 + (l_suppkey * 13) % 261 AS w, 8 + CAST(l_quantity AS BIGINT) AS h
      FROM {lineitem}) AS derived
"""
#: Lines around tables: level or upright ones beside a border, and some rectangles.
LINES = """
SELECT page, idx AS line_ord, CASE WHEN idx % 11 = 5 THEN 'rect' ELSE 'line' END AS kind,
       CASE WHEN idx % 3 = 0 THEN x1 - 4 ELSE x1 - 12 END AS sx, CASE WHEN idx % 3 = 0 THEN y1 - 6 WHEN idx % 2 = 0 THEN y1 - 7 ELSE y2 + 9 END AS sy,
       CASE WHEN idx % 3 = 0 THEN x1 - 4 ELSE x2 + 5 END AS ex, CASE WHEN idx % 3 = 0 THEN y2 + 6 WHEN idx % 2 = 0 THEN y1 - 7 ELSE y2 + 9 END AS ey,
       x1 - 3 AS x1, y1 - 5 AS y1, x2 + 8 AS x2, y2 + 7 AS y2
FROM {elements}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(spark.sql(ELEMENTS, lineitem=table(spark, sf_dir, "lineitem")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(spark.sql(LINES, elements=elements(spark, sf_dir)))


def page_sizes(els: DataFrame) -> DataFrame:
    return els.select("page").distinct().select("page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def longs(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT, so that engines agree on types."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


#: The derived tables for DuckDB, as common table expressions.
EL = f"WITH el AS ({ELEMENTS.format(lineitem='lineitem')})"
EL_LINES = f"{EL}, ln AS ({LINES.format(elements='el')})"
#: Overlap of a and b by the smaller area, in SQL.
RATIO = """CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) AND least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) > 0
 THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) ELSE 0.0 END"""
