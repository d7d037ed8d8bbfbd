"""Queries on page layout and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import layout, reading_order
from quirespark.plans.inputs import EL, HEIGHT, WIDTH, elements, longs, page_sizes


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = elements(spark, sf_dir)
    return layout.page_layout(els, page_sizes(els))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = elements(spark, sf_dir)
    return layout.regions(els, page_sizes(els))


def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layouts(spark, sf_dir).select("page", "layout_type", "center_line", "n_content", "n_crossing")


def layout_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_distribution(_layouts(spark, sf_dir))


def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_regions(spark, sf_dir).drop("width", "height", "layout_type"))


def page_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(layout.slices(_regions(spark, sf_dir)).drop("width", "height", "layout_type"))


def slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.slice_summary(layout.slices(_regions(spark, sf_dir))).withColumn("slices_per_page", F.round("slices_per_page", 6))


def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reading_order.columns(elements(spark, sf_dir))
    centers = F.array_join(F.transform("centers", lambda c: F.round(c * 1000).cast("long").cast("string")), ",")
    return longs(found.select("page", "column_count", "is_multi_column", F.round("confidence", 9).alias("confidence"), centers.alias("centers")))


def reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(reading_order.reading_order(elements(spark, sf_dir)).select("page", "idx", "column_index", "read_ord"))


def reorder_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_order.reorder_gate(elements(spark, sf_dir))


_LAYOUT = f"""{EL}, ct AS (SELECT *, x1 <= {WIDTH / 2} AND x2 >= {WIDTH / 2} AS crossing FROM el WHERE type IN ('text', 'image', 'table')),
multi AS (SELECT DISTINCT a.page FROM ct a JOIN ct b ON a.page = b.page AND a.idx <> b.idx AND NOT (a.y2 < b.y1 OR b.y2 < a.y1) AND NOT (a.crossing AND b.crossing)),
pl AS (SELECT p.page, count(ct.idx) AS n_content, count(*) FILTER (ct.crossing) AS n_crossing FROM (SELECT DISTINCT page FROM el) p LEFT JOIN ct USING (page) GROUP BY p.page),
lay AS (SELECT page, CASE WHEN n_content = 0 THEN 'single' WHEN n_crossing = 0 THEN 'double' WHEN page IN (SELECT page FROM multi) THEN 'mixed' ELSE 'single' END AS layout_type, CAST({WIDTH / 2} AS DOUBLE) AS center_line, n_content, n_crossing FROM pl)"""
_REGIONS = f"""{_LAYOUT}, o AS (SELECT ct.*, CASE WHEN crossing THEN 'single' ELSE 'double' END AS kind, row_number() OVER (PARTITION BY page ORDER BY y1, idx) AS k FROM ct JOIN lay USING (page) WHERE layout_type = 'mixed'),
t AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY page ORDER BY k) = kind THEN 0 ELSE 1 END AS turned FROM o),
u AS (SELECT *, sum(turned) OVER (PARTITION BY page ORDER BY k) AS turn FROM t),
n AS (SELECT *, CASE WHEN y1 <= max(y2) OVER (PARTITION BY page, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 20 THEN 0 ELSE 1 END AS fresh FROM u),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY k) AS region FROM n),
m AS (SELECT page, region, kind, min(y1) AS y1, max(y2) AS y2 FROM g GROUP BY ALL),
x AS (SELECT m.page, m.region, ct.type AS element_type, row_number() OVER (PARTITION BY m.page, m.region ORDER BY ct.idx) - 1 AS element_index, bool_or(ct.crossing) OVER (PARTITION BY m.page, m.region) AS odd, ct.x1, greatest(ct.y1, m.y1) AS y1, ct.x2, least(ct.y2, m.y2) AS y2
  FROM m JOIN ct ON ct.page = m.page AND NOT (ct.y2 < m.y1 OR ct.y1 > m.y2) WHERE m.kind = 'double'),
regular AS (SELECT * FROM m WHERE kind = 'single' OR NOT EXISTS (SELECT 1 FROM x WHERE x.page = m.page AND x.region = m.region AND x.odd)),
parts AS (SELECT page, 1 AS region, 0 AS sub, 'single' AS region_type, 0.0 AS x1, 0.0 AS y1, {WIDTH} AS x2, {HEIGHT} AS y2, NULL AS element_type, NULL AS element_index FROM lay WHERE layout_type = 'single'
  UNION ALL SELECT page, 1, s, CASE s WHEN 0 THEN 'left_column' ELSE 'right_column' END, s * {WIDTH / 2}, 0.0, (s + 1) * {WIDTH / 2}, {HEIGHT}, NULL, NULL FROM lay, range(2) r(s) WHERE layout_type = 'double'
  UNION ALL SELECT page, region, 0, 'single', 0.0, y1, {WIDTH}, y2, NULL, NULL FROM regular WHERE kind = 'single'
  UNION ALL SELECT page, region, s, CASE s WHEN 0 THEN 'left_column' ELSE 'right_column' END, s * {WIDTH / 2}, y1, (s + 1) * {WIDTH / 2}, y2, NULL, NULL FROM regular, range(2) r(s) WHERE kind = 'double'
  UNION ALL SELECT page, region, element_index, 'irregular_element', x1, y1, x2, y2, element_type, element_index FROM x WHERE odd),
reg AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY region, sub) AS region_ord, region_type, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, element_type, CAST(element_index AS BIGINT) AS element_index FROM parts)"""
_SLICES = f"""{_REGIONS}, sl AS (SELECT *, x2 - x1 <= 15 OR y2 - y1 <= 15 AS discarded FROM reg),
cut AS (SELECT page, region_ord, region_type, CASE WHEN NOT discarded THEN CAST(sum(CASE WHEN discarded THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY region_ord) AS BIGINT) END AS slice_index, discarded, x1, y1, x2, y2,
  CAST(greatest(trunc(x1 * (2550.0::DOUBLE / {WIDTH})), 0) AS BIGINT) AS px1, CAST(greatest(trunc(y1 * (3300.0::DOUBLE / {HEIGHT})), 0) AS BIGINT) AS py1, CAST(least(trunc(x2 * (2550.0::DOUBLE / {WIDTH})), 2550) AS BIGINT) AS px2, CAST(least(trunc(y2 * (3300.0::DOUBLE / {HEIGHT})), 3300) AS BIGINT) AS py2 FROM sl)"""
_COLUMNS = f"""{EL}, rw AS (SELECT *, count(*) OVER (PARTITION BY page, round_even(y1 / 10, 0) * 10) AS in_row FROM el),
st AS (SELECT page, x1, CASE WHEN x1 - lag(x1) OVER (PARTITION BY page ORDER BY x1) <= 50 THEN 0 ELSE 1 END AS fresh FROM rw WHERE in_row >= 2),
cl AS (SELECT page, x1, sum(fresh) OVER (PARTITION BY page ORDER BY x1 ROWS UNBOUNDED PRECEDING) AS cluster FROM st),
ce AS (SELECT page, cluster, avg(x1) AS center, count(*) AS n FROM cl GROUP BY page, cluster),
co AS (SELECT page, count(*) AS column_count, count(*) >= 2 AS is_multi_column, CAST(count(*) FILTER (n >= 2) AS DOUBLE) / count(*) AS confidence, list(center ORDER BY cluster) AS centers FROM ce GROUP BY page)"""
QUERIES = {f.__name__: f for f in (page_layout, layout_distribution, layout_regions, page_slices, slice_summary, column_clusters, reorder_gate)} | {"reading_order": reading}
ORACLES = {
    "page_layout": f"{_LAYOUT} SELECT page, layout_type, center_line, n_content, n_crossing FROM lay",
    "layout_distribution": f"{_LAYOUT} SELECT layout_type, count(*) AS n_pages FROM lay GROUP BY layout_type",
    "layout_regions": f"{_REGIONS} SELECT * FROM reg",
    "page_slices": f"{_SLICES} SELECT *, CASE WHEN NOT discarded THEN 'page_' || page || '_slice_' || slice_index || '.jpg' END AS filename FROM cut",
    "slice_summary": f"""{_SLICES} SELECT count(*) FILTER (NOT discarded) AS total_slices, count(*) FILTER (discarded) AS total_discarded, count(*) FILTER (region_type = 'irregular_element' AND NOT discarded) AS total_irregular, count(DISTINCT page) AS processed_pages,
        round(CAST(count(*) FILTER (NOT discarded) AS DOUBLE) / greatest(count(DISTINCT page), 1), 6) AS slices_per_page FROM cut""",
    "column_clusters": f"{_COLUMNS} SELECT page, column_count, is_multi_column, round(confidence, 9) AS confidence, array_to_string(list_transform(centers, lambda c: CAST(CAST(round(c * 1000) AS BIGINT) AS VARCHAR)), ',') AS centers FROM co",
    "reading_order": f"""{_COLUMNS}, e AS (SELECT el.*, co.centers, list_transform(co.centers, lambda c: abs(el.x1 - c)) AS gaps FROM el LEFT JOIN co ON el.page = co.page AND co.is_multi_column),
        f AS (SELECT *, list_position(gaps, list_min(gaps)) - 1 AS column_index FROM e)
        SELECT page, idx, CAST(column_index AS BIGINT) AS column_index, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN centers IS NOT NULL THEN round_even(y1 / 20, 0) * 20 ELSE y1 END, coalesce(column_index, 0), x1, idx) AS read_ord FROM f""",
    "reorder_gate": f"{_COLUMNS} SELECT el.page, count(*) AS n_blocks, CASE WHEN bool_or(coalesce(co.is_multi_column, FALSE)) THEN 'reordered' ELSE 'single column' END AS status FROM el LEFT JOIN co USING (page) GROUP BY el.page",
}
