"""Queries on page elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions.geometry import box, min_distance
from quirespark.operators import elements as E
from quirespark.operators import snapping
from quirespark.plans import folds
from quirespark.plans.inputs import EL, EL_LINES, RATIO, elements, lines, longs


def geom_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = E.overlapping_pairs(elements(spark, sf_dir))
    return pairs.select("page", "a_idx", "b_idx", F.round("ratio", 9).alias("ratio"), (F.col("ratio") > 0.3).alias("over"))


def geom_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = elements(spark, sf_dir).filter("type = 'text'")
    pairs = texts.alias("a").join(texts.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.idx") < F.col("b.idx")))
    gap = min_distance(box("a"), box("b"))
    return pairs.select("a.page", F.col("a.idx").alias("a_idx"), F.col("b.idx").alias("b_idx"), F.round(gap, 9).alias("distance"), (gap < 5).alias("near"))


def text_minus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.text_without_tables(elements(spark, sf_dir))


def tables_minus_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tables_without_images(elements(spark, sf_dir))


def image_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(E.suppress_duplicates(elements(spark, sf_dir).filter("type = 'image'")))


def element_union_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(E.priority_union(E.reindexed(elements(spark, sf_dir))).select("page", "ord", "type", "idx", "new_idx"))


def element_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(E.summary(elements(spark, sf_dir)))


def element_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_page = E.summary(elements(spark, sf_dir))
    return per_page.agg(F.count("*").alias("total_pages"), *(F.sum(c).alias(f"total_{c[2:]}") for c in per_page.columns if c != "page"))


def component_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.type_histogram(elements(spark, sf_dir))
    as_text = F.array_join(F.transform(F.map_entries("component_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return longs(found.select("page", as_text.alias("component_types"), "component_count", "x1", "y1", "x2", "y2"))


def text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = elements(spark, sf_dir)
    texts = els.filter("type = 'text'").withColumn("content", F.concat(F.lit("t"), F.col("idx").cast("string")))
    return longs(E.merge_texts(texts, els.filter("type = 'table'")))


def vector_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.merge_vector_graphics(elements(spark, sf_dir))
    as_text = F.array_join(F.array_sort(F.transform(F.map_entries("component_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return longs(found.select("page", "ord", "type", "x1", "y1", "x2", "y2", as_text.alias("component_types"), F.size("component_details").alias("n_details"), "component_count"))


def page_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = elements(spark, sf_dir)
    snapped = snapping.snap(els.filter("type = 'table'"), lines(spark, sf_dir)).select("page", "idx", F.lit("table").alias("type"), *E.BOX)
    rows = els.filter("type <> 'table'").unionByName(snapped).withColumn("content", F.lit(""))
    return longs(E.whole_page(rows, show_lines=True).select("page", "ord", "type", *E.BOX))


def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapping.candidates(elements(spark, sf_dir).filter("type = 'table'"), lines(spark, sf_dir))
    sides = [F.col(f"{s}.{f}").alias(f"{s}_{n}") for s in ("left", "right", "top", "bottom") for f, n in (("ord", "line"), ("pos", "pos"))]
    return found.select("page", "idx", *sides, F.col("rect.ord").alias("rect_line"))


def snap_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapping.snap(elements(spark, sf_dir).filter("type = 'table'"), lines(spark, sf_dir))


#: Border candidates of each table (t) and line (m), for DuckDB.
_PAIRS = f"""{EL_LINES}, c AS (
 SELECT t.page, t.idx, t.x1, t.y1, t.x2, t.y2, t.x2 - t.x1 AS w, t.y2 - t.y1 AS h, m.line_ord, m.kind, m.x1 AS mx1, m.y1 AS my1, m.x2 AS mx2, m.y2 AS my2,
  (m.sx + m.ex) / 2 AS x, (m.sy + m.ey) / 2 AS y, least(m.sx, m.ex) AS xlo, greatest(m.sx, m.ex) AS xhi, least(m.sy, m.ey) AS ylo, greatest(m.sy, m.ey) AS yhi,
  m.kind = 'line' AND abs(m.sx - m.ex) <= 2 AS upright, m.kind = 'line' AND abs(m.sy - m.ey) <= 2 AS flat
 FROM el t JOIN ln m ON t.page = m.page WHERE t.type = 'table'),
s AS (SELECT *, flat AND NOT upright AS level, h < 75 AS small,
  least(yhi, y2 + 30) - greatest(ylo, y1 - 30) >= least(h * 0.5, (yhi - ylo) * 0.5) AS tall,
  least(xhi, x2 + 30) - greatest(xlo, x1 - 30) >= least(w * 0.5, (xhi - xlo) * 0.5) AS broad,
  CASE WHEN h < 75 THEN greatest(h * 0.85, 30) ELSE h * 0.25 END AS down, CASE WHEN h < 75 THEN greatest(h * 0.5, 30) ELSE h * 0.25 END AS up FROM c),
q AS (SELECT *,
  upright AND tall AND abs(x - x1) <= 30 AND x <= x1 + w * 0.25 AS is_left, upright AND tall AND abs(x - x2) <= 30 AND x >= x2 - w * 0.25 AS is_right,
  level AND broad AND abs(y - y1) <= 30 AND y <= y1 + down AS is_top, level AND broad AND abs(y - y2) <= 30 AND y >= y2 - up AS is_bottom,
  kind = 'rect' AND abs(x1 - mx1) <= 30 AND abs(y1 - my1) <= 30 AND abs(x2 - mx2) <= 30 AND abs(y2 - my2) <= 30 AS is_rect FROM s),
b AS (SELECT page, idx, x1, y1, x2, y2, any_value(small) AS small,
  min({{'d': abs(x - x1), 'o': line_ord, 'p': x, 'lo': ylo, 'hi': yhi}}) FILTER (is_left) AS l, min({{'d': abs(x - x2), 'o': line_ord, 'p': x, 'lo': ylo, 'hi': yhi}}) FILTER (is_right) AS r,
  min({{'d': abs(y - y1), 'o': line_ord, 'p': y, 'lo': xlo, 'hi': xhi}}) FILTER (is_top) AS t, min({{'d': abs(y - y2), 'o': line_ord, 'p': y, 'lo': xlo, 'hi': xhi}}) FILTER (is_bottom) AS bo,
  min({{'o': line_ord, 'x1': mx1, 'y1': my1, 'x2': mx2, 'y2': my2}}) FILTER (is_rect) AS re FROM q GROUP BY ALL)"""
_SNAP_STEPS = f"""{_PAIRS},
a AS (SELECT b.page, b.idx, min({{'d': abs(q.y - (b.t.p + b.y2 - b.y1)), 'o': q.line_ord, 'p': q.y}}) AS ag FROM b JOIN q ON b.page = q.page AND b.idx = q.idx
  WHERE b.small AND b.t IS NOT NULL AND q.flat AND q.broad AND abs(q.y - (b.t.p + b.y2 - b.y1)) <= 29.7 AND q.y >= b.t.p + b.y2 - b.y1 - greatest((b.y2 - b.y1) * 0.5, 30) GROUP BY ALL),
f AS (SELECT b.*, b.small AND b.t IS NOT NULL AS moved, a.ag, b.l IS NOT NULL AS fl, b.r IS NOT NULL AS fr, b.t IS NOT NULL AS ft, (b.small AND b.t IS NOT NULL) OR b.bo IS NOT NULL AS fb FROM b LEFT JOIN a USING (page, idx)),
g AS (SELECT *, coalesce(l.p, x1) AS l0, coalesce(r.p, x2) AS r0, coalesce(t.p, y1) AS t0, CASE WHEN moved THEN coalesce(ag.p, t.p + y2 - y1) ELSE coalesce(bo.p, y2) END AS b0,
  CASE WHEN ft THEN t.lo WHEN fb THEN bo.lo END AS alo, CASE WHEN ft THEN t.hi WHEN fb THEN bo.hi END AS ahi, least(l.lo, r.lo) AS vlo, greatest(l.hi, r.hi) AS vhi,
  fl::INT + fr::INT + ft::INT + fb::INT AS n FROM f),
k AS (SELECT *,
  CASE WHEN abs(alo - l0) <= 30 AND abs(alo - l0) > 2 AND (NOT fl OR abs(alo - x1) < abs(l0 - x1)) THEN alo ELSE l0 END AS l1,
  CASE WHEN abs(ahi - r0) <= 30 AND abs(ahi - r0) > 2 AND (NOT fr OR abs(ahi - x2) < abs(r0 - x2)) THEN ahi ELSE r0 END AS r1,
  CASE WHEN (NOT ft OR abs(vlo - y1) < abs(t0 - y1)) AND abs(vlo - t0) > 2 THEN vlo ELSE t0 END AS t1,
  CASE WHEN (NOT fb OR abs(vhi - y2) < abs(b0 - y2)) AND abs(vhi - b0) > 2 THEN vhi ELSE b0 END AS b1 FROM g)"""
_SNAP = """SELECT page, idx, CASE WHEN re IS NOT NULL THEN re.x1 WHEN n >= 2 THEN least(l1, r1) ELSE x1 END AS x1, CASE WHEN re IS NOT NULL THEN re.y1 WHEN n >= 2 THEN least(t1, b1) ELSE y1 END AS y1,
  CASE WHEN re IS NOT NULL THEN re.x2 WHEN n >= 2 THEN greatest(l1, r1) ELSE x2 END AS x2, CASE WHEN re IS NOT NULL THEN re.y2 WHEN n >= 2 THEN greatest(t1, b1) ELSE y2 END AS y2, re IS NOT NULL OR n >= 2 AS refined FROM k"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH el", "WITH RECURSIVE el", 1)


_NMS = f"""i AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) * (y2 - y1) DESC, idx) AS k FROM el WHERE type = 'image'),
 walk AS (SELECT page, k, [{{'idx': idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM i WHERE k = 1
  UNION ALL SELECT b.page, b.k, CASE WHEN len(list_filter(w.kept, lambda a: {RATIO} > 0.8)) > 0 THEN w.kept ELSE list_append(w.kept, {{'idx': b.idx, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) END
  FROM walk w JOIN i b ON b.page = w.page AND b.k = w.k + 1),
 last AS (SELECT page, arg_max(kept, k) AS kept FROM walk GROUP BY page),
 flat AS (SELECT page, unnest(range(len(kept))) AS idx, unnest(kept) AS e FROM last)"""
#: The whole page: im, tb, tx, ca are the images, tables, texts and candidates for vector graphics that are left.
_PROCESS = f"""{_recursive(_SNAP_STEPS)}, sn AS ({_SNAP}), {_NMS},
 im AS (SELECT page, idx, e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2 FROM flat),
 tb AS (SELECT a.page, a.idx, a.x1, a.y1, a.x2, a.y2 FROM sn a WHERE NOT EXISTS (SELECT 1 FROM im b WHERE b.page = a.page AND {RATIO} > 0.3)),
 raw AS (SELECT page, idx, x1, y1, x2, y2, '' AS content FROM el WHERE type = 'text'),
 {folds.merged_texts('raw', 'tb')},
 tx AS (SELECT a.* FROM (SELECT page, ord AS idx, e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2 FROM mt) a WHERE NOT EXISTS (SELECT 1 FROM tb b WHERE b.page = a.page AND {RATIO} > 0.3)),
 ca AS (SELECT page, {{'k': 1, 'i': idx}} AS idx, 'image' AS type, x1, y1, x2, y2 FROM im UNION ALL SELECT page, {{'k': 2, 'i': idx}}, 'text', x1, y1, x2, y2 FROM tx
  UNION ALL SELECT page, {{'k': 3, 'i': idx}}, type, x1, y1, x2, y2 FROM el WHERE type = 'original_line'),
 {folds.vector_graphics('ca')},
 al AS (SELECT page, idx, 'table' AS type, x1, y1, x2, y2 FROM tb UNION ALL SELECT page, ord, e.t, e.x1, e.y1, e.x2, e.y2 FROM vg)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY CASE type WHEN 'table' THEN 1 WHEN 'vector_graphic' THEN 2 WHEN 'image' THEN 3 WHEN 'text' THEN 4 ELSE 5 END, idx) AS ord, type, x1, y1, x2, y2 FROM al"""
_COUNTS = """CAST(count(*) FILTER (type = 'text') AS BIGINT) AS {p}text, CAST(count(*) FILTER (type = 'image') AS BIGINT) AS {p}image, CAST(count(*) FILTER (type = 'table') AS BIGINT) AS {p}table,
 CAST(count(*) FILTER (type = 'original_line') AS BIGINT) AS {p}line, CAST(count(*) FILTER (type = 'vector_graphic') AS BIGINT) AS {p}vector,
 CAST(count(*) FILTER (type IN ('text', 'image', 'table')) AS BIGINT) AS {p}elements, CAST(count(*) FILTER (type IN ('text', 'image', 'table', 'vector_graphic')) AS BIGINT) AS {p}all"""
QUERIES = {
    f.__name__: f
    for f in (geom_overlap_ratio, geom_min_distance, text_minus_tables, tables_minus_images, image_nms, element_union_priority, element_summary, element_totals, component_histogram, text_merge, vector_graphics, page_process, snap_nearest, snap_refined)
}
ORACLES = {
    "geom_overlap_ratio": f"{EL} SELECT page, a_idx, b_idx, round(ratio, 9) AS ratio, ratio > 0.3 AS over FROM (SELECT a.page, a.idx AS a_idx, b.idx AS b_idx, {RATIO} AS ratio FROM el a JOIN el b ON a.page = b.page AND a.idx < b.idx) WHERE ratio > 0",
    "geom_min_distance": f"""{EL}, d AS (SELECT a.page, a.idx AS a_idx, b.idx AS b_idx, greatest(a.x1 - b.x2, b.x1 - a.x2, 0) AS dx, greatest(a.y1 - b.y2, b.y1 - a.y2, 0) AS dy FROM el a JOIN el b ON a.page = b.page AND a.idx < b.idx WHERE a.type = 'text' AND b.type = 'text')
        SELECT page, a_idx, b_idx, round(sqrt(dx * dx + dy * dy), 9) AS distance, sqrt(dx * dx + dy * dy) < 5 AS near FROM d""",
    "text_minus_tables": f"{EL} SELECT a.* FROM el a WHERE a.type = 'text' AND NOT EXISTS (SELECT 1 FROM el b WHERE b.page = a.page AND b.type = 'table' AND {RATIO} > 0.3)",
    "tables_minus_images": f"{EL} SELECT a.* FROM el a WHERE a.type = 'table' AND NOT EXISTS (SELECT 1 FROM el b WHERE b.page = a.page AND b.type = 'image' AND {RATIO} > 0.3)",
    "image_nms": f"{_recursive(EL)}, {_NMS} SELECT page, CAST(idx AS BIGINT) AS idx, CAST(e.idx AS BIGINT) AS source_idx, e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2 FROM flat",
    "element_union_priority": f"""{EL} SELECT page, row_number() OVER (PARTITION BY page ORDER BY CASE type WHEN 'table' THEN 1 WHEN 'vector_graphic' THEN 2 WHEN 'image' THEN 3 WHEN 'text' THEN 4 WHEN 'original_line' THEN 5 ELSE 6 END, idx) AS ord, type, idx,
        row_number() OVER (PARTITION BY page, type ORDER BY idx) - 1 AS new_idx FROM el""",
    "element_summary": f"{EL} SELECT page, {_COUNTS.format(p='n_')} FROM el GROUP BY page",
    "element_totals": f"{EL} SELECT count(DISTINCT page) AS total_pages, {_COUNTS.format(p='total_')} FROM el",
    "component_histogram": f"""{EL}, t AS (SELECT page, type, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM el GROUP BY page, type)
        SELECT page, string_agg(type || ':' || n, ',' ORDER BY type) AS component_types, CAST(sum(n) AS BIGINT) AS component_count, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM t GROUP BY page""",
    "text_merge": f"""{_recursive(EL)}, raw AS (SELECT *, 't' || idx AS content FROM el WHERE type = 'text'), tb AS (SELECT * FROM el WHERE type = 'table'), {folds.merged_texts('raw', 'tb')}
        SELECT page, ord, e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2, e.c AS content, e.n AS n_merged FROM mt""",
    "vector_graphics": f"""{_recursive(EL)}, {folds.vector_graphics('el')}
        SELECT page, ord, e.t AS type, e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2, e.types AS component_types, e.n AS n_details, e.n AS component_count FROM vg""",
    "page_process": _PROCESS,
    "snap_nearest": f"""{_PAIRS} SELECT page, idx, l.o AS left_line, l.p AS left_pos, r.o AS right_line, r.p AS right_pos, t.o AS top_line, t.p AS top_pos, bo.o AS bottom_line, bo.p AS bottom_pos, re.o AS rect_line FROM b""",
    "snap_refined": f"{_SNAP_STEPS} {_SNAP}",
}
