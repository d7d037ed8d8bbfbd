"""Executed plans of the layout queries, clashing names, and records of all elements."""

import re

import pytest

from quirespark.operators import htmltree
from quirespark.plans import registry
from quirespark.sources import sinks


@pytest.mark.parametrize("name", ["page_layout", "layout_regions", "page_slices", "slice_summary", "slice_documents"])
def test_a_page_is_shuffled_once(spark, small, name):
    """Two scans of the elements (pages and elements) and a shuffle of each; aggregates over all pages take one or two more."""
    df = registry.QUERIES[name](spark, small)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet", final)) <= 2
    assert len(re.findall(r"\bExchange hashpartitioning", final)) <= (4 if name == "slice_summary" else 3), final


def test_a_whole_page_is_shuffled_once(spark, small):
    """Scans of the elements and of the lines around tables; snapping shuffles each, and the page is shuffled once more with its snapped tables."""
    df = registry.QUERIES["page_process"](spark, small)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet", final)) <= 3
    assert len(re.findall(r"\bExchange hashpartitioning", final)) <= 5, final


def test_names_that_clash(spark):
    pages = spark.createDataFrame([(1, "<p data-bbox='1 2 3 4'>x</p><img>", "a")], "page_id long, html string, sources string")
    images = spark.createDataFrame([(1, 1, "p.png")], "page_id long, img_ord int, path string")
    row = htmltree.insert_sources(pages, images, page="page_id").first()
    assert "p.png" in row.html and row.sources == "a"
    named = spark.createDataFrame([(1, "<p>x</p>", "a", "b", "c")], "page_id long, html string, found string, blocks string, block string")
    assert htmltree.page_statistics(named).first().found == "a" and htmltree.page_blocks(named).first().blocks == "b"
    els = spark.createDataFrame([(1, 1, "text", 0, 0.0, 0.0, 1.0, 1.0, "t", None, None, None, "e")], "doc_id long, page_number int, type string, idx int, x1 double, y1 double, x2 double, y2 double, content string, label string, confidence double, refined boolean, element string")
    docs = spark.createDataFrame([(1, "s", "o", "c", 1)], "doc_id long, source_file string, output_file string, creation_time string, total_pages int")
    assert sinks.metadata(els, docs).first().summary.total_text_blocks == 1


def test_records_of_all_elements(spark):
    html = "<div class='a b'><h2>T</h2><ul class=l><li>one</li></ul><img src=x><table><tr><td>c</td></tr></table><p>open"
    rows = htmltree.element_records(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("ord").collect()
    assert [(r.type, r.text, r.parent_class) for r in rows] == [("div", "Tonecopen", []), ("h2", "T", ["a", "b"]), ("ul", "one", ["a", "b"]), ("img", "", ["a", "b"]), ("table", "c", ["a", "b"]), ("p", "open", ["a", "b"])]


def test_cleaning_joins_children_and_line_breaks_by_spaces():
    assert htmltree.cleaned("<body><p>a</p>tail &amp; end</body>") == "```html\n<html><body>\n<p>a</p> \n tail & end \n</body></html>\n```"
