"""The pipeline against a plain run of the operators' brute-force models, stage by stage."""

import corpus_pipeline
import pytest
from helpers import SCHEMA, awkward
from test_leaks import brute_find
from test_near import brute as brute_near
from test_packing import verify
from test_suffixes import brute as brute_suffixes

from quirespark.llm import quality


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = step(spark, docs, small)
        if name != "best-fit packing":
            assert after.columns == docs.columns
            after = spark.createDataFrame(after.collect(), docs.schema)
            kept = {r.doc_id: r.text for r in after.collect()}
        if name == "quality classifier":
            good = {r.doc_id for r in quality.score(docs, labels).collect() if r.predicted}
            marks = {r.doc_id: r.quality for r in labels.collect()}
            assert kept == {d: t for d, t in before.items() if d in good}
            assert sum(marks.get(d) == 1 and d not in good for d in before) <= 0.02 * len(before)
        elif name == "simhash near-dedup":
            rows = list(before.items())
            firsts = brute_near(rows)
            assert kept == {d: t for d, t in rows if d in firsts}
        elif name == "suffix-array dedup":
            want = brute_suffixes(list(before.items()))
            assert kept.keys() == before.keys() and all(abs(len(kept[d].encode()) - (n - gone)) <= 6 * spans for d, (n, gone, spans, _) in want.items())
            assert {r.doc_id: r.n_chars for r in after.collect()} == {d: len(t) for d, t in kept.items()}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            leaked = {d for d, _ in brute_find(list(before.items()), items)}
            assert kept == {d: t for d, t in before.items() if d not in leaked}
        else:
            bins, tokens = verify(after.collect(), list(before.items()))
            assert bins <= 1.05 * -(-tokens // 2048) + 1
        docs = after
    assert len(steps) == 5


def test_run_is_all_stages(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, small)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))


@pytest.mark.parametrize("rows", ["awkward", "empty"])
def test_awkward(spark, small, rows):
    docs = awkward(spark) if rows == "awkward" else spark.createDataFrame([], SCHEMA)
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, docs, small)
        if name != "best-fit packing":
            assert after.columns == docs.columns
        docs = after
    assert docs.count() >= (rows == "awkward")
