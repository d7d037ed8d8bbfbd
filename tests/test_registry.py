"""Every registered query against its SQL twin on the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quirespark.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert rows
    if name in registry.ORACLES:
        r = duck.sql(registry.ORACLES[name])
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert sorted(repr(tuple(plain(x[k]) for k in at)) for x in r.fetchall()) == rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_references_cut_before_their_semicolon(spark, tmp_path):
    """Titles of larger scales are cut in the middle of a reference."""
    rows = [(1, "<h1>a&amp;&amp</h1>"), (2, "<script>var t='&amp';</script><h1>b &lt</h1>"), (3, "<h1>&quot;c & d&quot;&am</h1>"), (4, "<h1>e &amp;lt; f</h1>"), (5, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = {1: "# a&&amp\n", 2: "# b &lt\n", 3: '# "c & d"&am\n', 4: "# e &lt; f\n"}
    assert dict(registry.QUERIES["html_heading_markdown"](spark, str(tmp_path)).collect()) == want
    assert dict(c.sql(registry.ORACLES["html_heading_markdown"]).fetchall()) == {k: v for k, v in want.items() if v}


def test_metadata_files_hold_so_many_pages(spark, small, duck, monkeypatch):
    """Documents of many parts add up to what the SQL says, and no row has more pages than a part."""
    from quirespark.plans import outputs, stored

    parts = outputs.metadata_in_parts(spark, small, 4)
    assert parts.selectExpr("max(size(pages))").first()[0] <= 4 and parts.count() > 200
    monkeypatch.setattr(stored, "metadata_in_parts", lambda s, d: outputs.metadata_in_parts(s, d, 4))
    df = registry.QUERIES["file_metadata"](spark, small)
    r = duck.sql(registry.ORACLES["file_metadata"])
    assert sorted(repr(tuple(x)) for x in df.select(*r.columns).collect()) == sorted(map(repr, r.fetchall()))
