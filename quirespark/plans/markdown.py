"""Queries on Markdown text, on documents whose sentences are broken into lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators import markdown, qa
from quirespark.plans.inputs import longs, table
from quirespark.sources import files


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with breaks after commas, and comments and rules in between."""
    md = F.concat(F.lit("<!-- top -->\n\n"), F.regexp_replace(F.replace("text", F.lit(", "), F.lit(",\n")), r"\. ", ".\n\n---\n<!-- x -->\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", md.alias("md"))


def md_clean_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir).select("doc_id", markdown.clean(F.col("md")).alias("clean_md"))


def md_merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as pages of one: a sum of their cleaned lengths and a hash tell of the text."""
    pages = _broken(spark, sf_dir).select("source", F.col("doc_id").alias("page_id"), F.col("md").alias("complete_md"), markdown.clean(F.col("md")).alias("clean_md"))
    out = markdown.merged(pages, ("source",))
    return out.select("source", "n_pages", F.length("complete_md").cast("long").alias("n_complete"), F.length("clean_md").cast("long").alias("n_clean"), F.md5(F.col("clean_md").cast("binary")).alias("clean_md5"))


def md_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir).select("doc_id", T.preview(F.col("md"), 20).alias("preview"))


def md_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(files.markdown_status(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "valid", "content_length"))


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see ![fig "), F.col("p_partkey").cast("string"), F.lit("](img/"), F.col("p_brand"), F.lit(".png) and <img class='a' src=\"pic/"), F.col("p_size").cast("string"), F.lit(".jpg\" alt=\"z\"> ![]("), F.col("p_type"), F.lit(")"))
    found = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(qa.image_references(text)).alias("ord", "r"))
    return longs(found.select("p_partkey", "ord", "r.*"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete and clean Markdown of each page."""
    from quirespark.operators import htmltree

    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return markdown.page_markdown(htmltree.page_blocks(pages), pages)


QUERIES = {f.__name__: f for f in (md_clean_document, md_merge_documents, md_preview, md_validate, image_refs, page_markdown)}
_MD = "'<!-- top -->' || chr(10) || chr(10) || regexp_replace(replace(text, ', ', ',' || chr(10)), '\\. ', '.' || chr(10) || chr(10) || '---' || chr(10) || '<!-- x -->' || chr(10) || chr(10), 'g')"


def _clean_sql(rows: str) -> str:
    """Cleaning of `rows` (doc, md) with windows over lines: (doc, clean)."""
    space = "'^[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+|[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+$'"
    return f"""src AS ({rows}), l0 AS (SELECT doc, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS k FROM src),
 l1 AS (SELECT doc, k, line, regexp_replace(line, {space}, '', 'g') AS s FROM l0),
 l2 AS (SELECT * FROM l1 WHERE NOT (starts_with(s, '<!--') AND ends_with(s, '-->')) AND s <> '---'),
 l3 AS (SELECT *, lag(s) OVER (PARTITION BY doc ORDER BY k) AS p FROM l2),
 l4 AS (SELECT doc, k, CASE WHEN s = '' THEN '' ELSE line END AS line, s FROM l3 WHERE s <> '' OR coalesce(p, '') <> ''),
 l5 AS (SELECT *, lag(s) OVER (PARTITION BY doc ORDER BY k) AS p FROM l4),
 l6 AS (SELECT *, coalesce(NOT regexp_matches(s, '^([#|\\-*!$>\\[]|```)') AND NOT regexp_matches(s, '^\\p{{Nd}}+$') AND regexp_matches(s, '^\\p{{Ll}}') AND p <> '' AND NOT regexp_matches(p, '^([#|\\-*!$>]|```)') AND NOT regexp_matches(p, '[.?!]$'), FALSE) AS joins FROM l5),
 l7 AS (SELECT *, coalesce(lead(joins) OVER (PARTITION BY doc ORDER BY k), FALSE) AS joined, row_number() OVER (PARTITION BY doc ORDER BY k) AS n FROM l6),
 l8 AS (SELECT doc, k, CASE WHEN n = 1 THEN '' WHEN joins THEN ' ' ELSE chr(10) END AS sep, CASE WHEN joins THEN s WHEN joined THEN rtrim(line) ELSE line END AS t FROM l7),
 cleaned AS (SELECT doc, regexp_replace(string_agg(sep || t, '' ORDER BY k), '\\n+$', '') AS clean FROM l8 GROUP BY doc)"""


ORACLES = {
    "md_clean_document": f"WITH {_clean_sql(f'SELECT doc_id AS doc, {_MD} AS md FROM documents')} SELECT d.doc_id, coalesce(clean, '') AS clean_md FROM documents d LEFT JOIN cleaned ON doc = doc_id",
    "md_preview": f"""WITH m AS (SELECT doc_id, {_MD} AS md FROM documents), s AS (SELECT *, string_split(md, chr(10)) AS lines FROM m), n AS (SELECT *, len(lines) - CASE WHEN ends_with(md, chr(10)) THEN 1 ELSE 0 END AS n FROM s)
        SELECT doc_id, CASE WHEN n <= 20 THEN md ELSE array_to_string(lines[1:20], chr(10)) || chr(10) || chr(10) || '... (' || (n - 20) || ' more lines)' END AS preview FROM n""",
    "md_validate": "SELECT doc_id, regexp_matches(text, '[^\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]') AS valid, length(text) AS content_length FROM documents",
    "image_refs": """SELECT p_partkey, CAST(ord AS BIGINT) AS ord, CASE ord WHEN 0 THEN 'fig ' || p_partkey ELSE '' END AS alt_text, CASE ord WHEN 0 THEN 'img/' || p_brand || '.png' WHEN 1 THEN p_type ELSE 'pic/' || p_size || '.jpg' END AS path,
        CASE ord WHEN 2 THEN 'html' ELSE 'markdown' END AS type FROM part, range(3) r(ord)""",
    "md_merge_documents": f"""WITH {_clean_sql(f'SELECT doc_id AS doc, {_MD} AS md FROM documents')},
        pg AS (SELECT d.source, d.doc_id, {_MD.replace('text', 'd.text')} AS md, coalesce(clean, '') AS clean FROM documents d LEFT JOIN cleaned ON doc = d.doc_id),
        jn AS (SELECT source, count(*) AS n_pages, string_agg(md, chr(10) || chr(10) ORDER BY doc_id) AS complete, string_agg(clean, chr(10) || chr(10) ORDER BY doc_id) FILTER (regexp_matches(clean, '[^\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]')) AS clean FROM pg GROUP BY source),
        {_clean_sql("SELECT source AS doc, clean AS md FROM jn").replace('src AS', 'src2 AS').replace('FROM src)', 'FROM src2)').replace('l0', 'm0').replace('l1', 'm1').replace('l2', 'm2').replace('l3', 'm3').replace('l4', 'm4').replace('l5', 'm5').replace('l6', 'm6').replace('l7', 'm7').replace('l8', 'm8').replace('cleaned AS', 'recleaned AS')}
        SELECT jn.source, n_pages, length(complete) AS n_complete, length(r.clean) AS n_clean, md5(r.clean) AS clean_md5 FROM jn JOIN recleaned r ON r.doc = jn.source""",
}
