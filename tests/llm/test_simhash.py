import numpy as np
import pytest
import xxhash
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import simhash

U = np.uint64


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: list of (doc_id, fingerprint)."""
    ids = list(range(len(fps)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def key(r):
    return tuple((x is None, x) for x in r)


def verify(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [(d, brute_fp(t)) for d, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps), strict=True)), key=key)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=key) == want


def test_small_table(spark, small):
    verify(spark.read.parquet(f"{small}/documents.parquet"))


@pytest.mark.parametrize("share", [1, 3, 10**9])
def test_hot_fingerprints(spark, share, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", share)
    verify(documents(spark, ["same text of some words"] * 40 + ["same text of some word"] * 30 + [f"other {i} text {i * 7} here" for i in range(30)]))


def test_awkward(spark):
    verify(awkward(spark))


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, ["x"]).filter("doc_id < 0")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 6))
def test_forest_keeps_every_component(seed, n, groups):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    codes = base[rng.integers(0, 5, n)]
    for _ in range(3):
        codes = codes ^ np.where(rng.random(n) < 0.7, U(1) << rng.integers(0, 64, n).astype(U), U(0))
    pairs = np.unique(np.stack([rng.integers(0, groups, n).astype(U), codes], 1), axis=0)
    u, v = simhash.forest(pairs[:, 0], pairs[:, 1])
    assert len(u) <= len(pairs)
    for g in np.unique(pairs[:, 0]).tolist():
        own = pairs[pairs[:, 0] == g, 1].tolist()
        want = brute_components(list(enumerate(own)))
        if groups == 1:
            got = {int(c): int(c) for c in own}
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                got[a] = b
            for i, a in enumerate(own):
                for j, b in enumerate(own):
                    assert (want[i] == want[j]) == (got[a] == got[b])


@pytest.mark.parametrize("bucket", [1, 4096])
def test_links_with_hot_buckets(spark, bucket):
    rng = np.random.default_rng(5)
    codes = set()
    for base in rng.integers(0, 2**63, 6, dtype=np.uint64).tolist():
        for _ in range(150):
            c = base
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                c ^= 1 << b
            codes.add(c)
    codes = sorted(codes)
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long")
    labels = {r.node: r.label for r in simhash.components(simhash.links(df, bucket)).collect()}
    signed = [int(np.uint64(c).view(np.int64)) for c in codes]
    got = [labels.get(s, s) for s in signed]
    want = brute_components(list(zip(signed, codes, strict=True)))
    assert got == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "u long, v long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}
