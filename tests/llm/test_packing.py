import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirespark.llm import packing

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_tokenizers(text):
    assert packing.byte_bpe(*PATHS).ids(text).tolist() == Tokenizer.from_file(PATHS[0]).encode(text, add_special_tokens=False).ids


def test_special_string_goes_to_the_tokenizer():
    text = "a <|endoftext|> b"
    assert packing.byte_bpe(*PATHS).ids(text).tolist() == Tokenizer.from_file(PATHS[0]).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17, 24, 25])
def test_cut(n):
    parts = packing.cut(n, 8)
    assert sum(x for _, x in parts) == n and all(x == 8 for _, x in parts[1:]) and 0 < parts[0][1] <= 8 and len(parts) == -(-n // 8)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_best_fit_bins(sizes):
    where, offset, fill = packing.best_fit(np.array(sizes), 50)
    by = defaultdict(list)
    for b, o, s in zip(where.tolist(), offset.tolist(), sizes, strict=True):
        by[b].append((o, s))
    for b, items in by.items():
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
        assert at == fill[b] <= 50
    # best fit decreasing: every bin but one is over half full
    assert sum(f <= 25 for f in fill.tolist()) <= 1


def verify(rows, docs, capacity=2048):
    tok = Tokenizer.from_file(PATHS[0])
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    want = []
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    return len(by), sum(n for *_, n, _ in want)


def test_against_tokenizer(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(9, "doc_id")
    bins, tokens = verify(packing.best_fit_pack(docs, *PATHS).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert bins <= 1.03 * -(-tokens // 2048) + 1


def test_awkward(spark):
    docs = awkward(spark)
    verify(packing.best_fit_pack(docs, *PATHS).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_rounds_merge_across_partitions(spark):
    docs = documents(spark, ["word " * (100 + 37 * (i % 23)) for i in range(400)]).repartition(40, "doc_id")
    bins, tokens = verify(packing.best_fit_pack(docs, *PATHS).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert bins <= -(-tokens // 2048) * 1.05 + 1


def test_empty(spark):
    assert packing.best_fit_pack(documents(spark, ["x"]).filter("doc_id < 0"), *PATHS).count() == 0
