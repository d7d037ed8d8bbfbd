"""Image sources over the whole part table."""

from quirespark.operators import htmltree
from quirespark.plans import pages


def test_parts_beyond_the_first_count(spark, tmp_path):
    spark.createDataFrame([(k, 1) for k in range(501, 561)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rows = pages.image_sources(spark, str(tmp_path)).collect()
    assert len(rows) == 60 and {r.html for r in rows} == {'<p>a</p><img alt="x"/><img src="old"/>'}


def test_every_image_of_a_long_page(spark):
    n = spark.read.parquet("/root/testdata/sf0.01/part.parquet").count()
    paths = spark.range(1, n + 1).selectExpr("concat('/f/doc_page_', id % 7, '_', id div 7 + 1, '.png') as path")
    long_pages = spark.createDataFrame([(p, '<img src="old">' * (n // 7 + 1)) for p in range(7)], "page int, html string")
    made = {r.page: r.html for r in htmltree.insert_sources(long_pages, htmltree.image_index(paths, "doc")).collect()}
    have = {(k % 7, k // 7 + 1) for k in range(1, n + 1)}
    assert made == {p: "".join(f'<img src="/f/doc_page_{p}_{o}.png"/>' if (p, o) in have else '<img src="old"/>' for o in range(1, n // 7 + 2)) for p in range(7)}
