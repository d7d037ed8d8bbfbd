import hashlib
import random

import pytest
from helpers import awkward, documents

from quirespark.llm import suffixes


def brute(docs, width=100):
    """docs: (doc_id, text), by doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            s = data[i : i + width]
            if s in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def verify(docs, **how):
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs, **how).collect()}
    assert rows == brute([(r.doc_id, r.text) for r in docs.collect()])
    return rows


def passages(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    common = [" ".join(rng.choices(words, k=k)) for k in (12, 20, 24, 26, 30, 60, 200)] + ["ab" * 200, "x" * 400, "q" * 99, "r" * 100, "t" * 101]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(4)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, 4), rng.choice(common))
        text = " ".join(parts)
        if texts and rng.random() < 0.3:
            text = rng.choice(texts)
            if rng.random() < 0.7 and text:
                k = rng.randrange(len(text))
                text = text[:k] + "#" + text[k + rng.randint(0, 3) :]
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("how", [{"filter_bits": 20}, {"hot_least": 3, "filter_bits": 16}, {"filter_bits": 12}])
def test_planted_passages(spark, seed, how):
    docs = documents(spark, passages(seed)).repartition(5)
    rows = verify(docs, **how)
    assert sum(r[1] for r in rows.values()) > 1000


def test_many_chunks_and_slices(spark, monkeypatch):
    texts = passages(9, 60) + ["long " + "".join(random.Random(3).choices("abc ", k=30_000))] * 2
    for small in ("CHUNK", "SORTED", "SLICE"):
        monkeypatch.setattr(suffixes, small, 700)
    monkeypatch.setattr(suffixes, "HELD", 20_000)
    import numpy as np

    ids, doc_spans = np.arange(len(texts)), []
    # the map and merge kernels by themselves, as the workers would run them with small chunks
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])]
    bitmap = type("B", (), {"value": b"\xff" * 4096})
    run, _ = suffixes._sorted_runs(100, 32, 3, bitmap, np.zeros(0, np.uint64))
    rows = [r for b in run(batches) for r in b.to_pylist()]
    assert len({r["r"] for r in rows if r["known"]}) > 1  # no range has all known repeats
    merged, _ = suffixes._merged(100)
    for r in sorted({x["r"] for x in rows}):
        schema = pa.schema([("r", pa.int32()), *((c, pa.binary()) for c in ("shared", "lengths", "rests", "doc", "lo", "known"))])
        doc_spans += merged(pa.Table.from_pylist([x for x in rows if x["r"] == r], schema=schema)).to_pylist()
    want = brute(list(enumerate(texts)))
    for i, t in enumerate(texts):
        kept, removed, many = suffixes.kept_bytes(t.encode(), [(s["start"], s["end"]) for s in doc_spans if s["doc"] == i])
        assert (len(t.encode()), removed, many, hashlib.sha256(kept).hexdigest()) == want[i]


def test_merge_order_and_prefixes():
    rng = random.Random(1)
    lists = [sorted("".join(rng.choices("ab", k=rng.randint(1, 9))).encode() for _ in range(rng.randint(0, 30))) for _ in range(7)]
    sources = []
    for x in lists:
        shared, rests = suffixes.front_code(x)
        sources.append(suffixes.Run(shared.tolist(), [len(s) for s in x], rests))
    got, before = [], b""
    for k, h in suffixes.merge(sources):
        s = sources[k].string
        if got:
            assert h == suffixes.shared_prefix(before, s, 0)
        got.append(s)
        before = s
    assert got == sorted(sum(lists, []))


def test_small_table(spark, small):
    verify(spark.read.parquet(f"{small}/documents.parquet"))


def test_awkward(spark):
    rows = suffixes.digests(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count() and all(r.n_removed == 0 for r in rows)
    kept = suffixes.remove(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == len(rows)


def test_remove_and_empty(spark):
    text = "é" * 30 + " ".join(f"word{i}" for i in range(40))
    docs = documents(spark, [text, "new " + text + " end", None])
    rows = {r.doc_id: r.text for r in suffixes.remove(docs).collect()}
    assert rows == {0: text, 1: "new  end", 2: None}
    assert suffixes.digests(docs.limit(0)).count() == 0


def test_repeated_ids_null_ids_and_clashing_names(spark):
    """One id with two texts, and several texts without an id, are documents of their own."""
    rng = random.Random(4)
    a, b, c = ("".join(rng.choices("abcdefgh ", k=300)) for _ in range(3))
    rows = [(5, "x" + a + a, "0"), (5, b * 2, "1"), (5, b * 2, "2"), (None, c, "3"), (None, "y" + c, "4"), (None, None, "5"), (7, "z", "6")]
    names = ("__spans", "__doc", "key", "doc", "spans", "its_id", "least")
    docs = spark.createDataFrame([(d, t, *[k] * len(names)) for d, t, k in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = suffixes.remove(docs)
    assert kept.columns == docs.columns
    got = {r.key: r.text for r in kept.collect()}
    assert got["0"] == "x" + a and got["1"] == got["2"] == b and got["5"] is None and got["6"] == "z"
    assert sorted([got["3"], got["4"]], key=len) in ([c, "y"], ["y", c], ["", "y" + c])
    assert suffixes.digests(docs).count() == 7


def test_filter_places_agree(spark):
    """The filter's places by SQL and by numpy."""
    import numpy as np
    from pyspark.sql import functions as F

    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 50)
    for bits in (16, 29):
        row = spark.createDataFrame([(int(k),) for k in keys], "kh long").select(*(F.shiftrightunsigned(F.shiftleft("kh", min(skip, 64 - bits)), 64 - bits) for skip in suffixes.SKIPPED)).collect()
        assert [list(map(int, c)) for c in zip(*row, strict=True)] == [p.astype(np.int64).tolist() for p in suffixes.bloom_places(keys.view(np.uint64), bits)]
