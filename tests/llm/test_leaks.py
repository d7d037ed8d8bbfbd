import collections
import math
import random

import pytest
from helpers import awkward, documents

from quirespark.llm import leaks

SCHEMA = "item_id long, text string"


def plain_words(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in text or "").split(" ")


def grams(found, size):
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def brute_find(docs, items, share=0.8, stride=64):
    """(doc_id, item_id) -> best score: BM25 of every passage with every section, without an index; then the overlaps."""
    items = [(i, [w for w in plain_words(t) if w]) for i, t in items]
    items = [(i, w) for i, w in items if w]
    parts = []
    for k, (_, w) in enumerate(items):
        n = math.ceil(len(w) / stride)
        parts += [(k, n, w[j * len(w) // n : (j + 1) * len(w) // n]) for j in range(n)]
    df = collections.Counter(t for *_, p in parts for t in set(p))
    mean = sum(len(p) for *_, p in parts) / max(1, len(parts))
    out = {}
    for d, text in docs:
        found = [w for w in plain_words(text) if w]
        for first in range(0, max(0, len(found)), stride):
            have = set(found[first : first + 2 * stride])
            for k, n, p in parts:
                i, w = items[k]
                cut = max(1, min(len(w) - 1, round(len(w) * 2 / 3)))
                pieces = [x for x in (w[:cut], w[cut:]) if x]
                weight = {t: math.log(1 + (len(parts) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(p) / mean)) for t, f in collections.Counter(p).items()}
                whole = sum(weight.values())
                lacks = sum(int(0.2 * len(grams(x, 5)) + 1e-9) for x in pieces) if n == 1 else int(0.2 * len(p) + 1e-9) + 4
                least = max(min(weight.values()), whole - sum(sorted(weight.values())[::-1][:lacks])) / whole
                score = sum(v for t, v in weight.items() if t in have) / whole
                if score < least * (1 - 1e-6):
                    continue
                wide = found[max(0, first - len(w)) : first + 2 * stride + len(w)]
                over = [sum(g in grams(wide, min(5, len(x))) for g in grams(x, 5)) / len(grams(x, 5)) for x in pieces]
                if min(over) >= share:
                    out[d, i] = max(out.get((d, i), 0.0), score)
    return out


def brute_scores(index, query):
    out = {}
    for t in query:
        for item, impact in zip(*index.postings[t], strict=True):
            out[item] = out.get(item, 0.0) + impact
    return out


@pytest.mark.parametrize("seed", range(30))
def test_wand_finds_all_above_the_threshold(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(3, 20)))) for i in range(rng.randint(1, 90))]
    for fixed in (0.2, 0.5, 0.8, None):
        index, threshold = leaks.Index(rows, threshold=fixed), 1.0
        found = leaks.words(" ".join(rng.choices(vocabulary, k=300)))
        width = 2 * leaks.STRIDE
        want = {}
        for first in range(0, len(found), leaks.STRIDE):
            query = sorted({index.terms[w] for w in found[first : first + width] if w in index.terms})
            hits = {k: s for k, s in brute_scores(index, query).items() if s >= threshold}
            if hits:
                want[first] = hits
        got = {}
        for first, query, allowed in index.passages(found, threshold):
            hits = dict(index.search(query, allowed, threshold))
            if hits:
                got[first] = hits
        assert got.keys() == want.keys()
        for first in want:
            assert got[first] == pytest.approx(want[first])


def verify(spark, docs, items, **how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bench = spark.createDataFrame(items, SCHEMA)
    got = {(r.doc_id, r.item_id): r.score for r in leaks.find(docs, bench, **how).collect()}
    want = brute_find(rows, items)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    left = leaks.clean(docs, bench, **how)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in rows if d not in {g[0] for g in got})
    return got


@pytest.mark.parametrize("slice_bytes", [16 << 20, 600])
def test_planted(spark, slice_bytes):
    rng = random.Random(4)
    vocabulary = [f"x{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 50)))) for i in range(30)] + [(50 + i, " ".join(rng.choices(vocabulary, k=90 + 70 * i))) for i in range(3)] + [(99, None), (98, "")]
    texts = []
    for k in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 500))
        if k % 3 == 0:
            leak = items[k % 30][1].split()
            if k % 2:
                leak[len(leak) // 4] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = leak
        if k % 7 == 0:
            w += items[k % 30][1].upper().split()[: len(items[k % 30][1].split()) // 2]  # a question without its answer
        texts.append(" ".join(w))
    for i in range(3):  # items longer than a passage, one with a word changed
        leak = items[30 + i][1].split()
        leak[20] = "changed" if i == 1 else leak[20]
        texts.append(" ".join([*rng.choices(vocabulary, k=30 + 17 * i), *leak, *rng.choices(vocabulary, k=100)]))
    got = verify(spark, documents(spark, texts), items, slice_bytes=slice_bytes)
    assert {(60, 50), (61, 51), (62, 52)} <= got.keys()
    assert len(got) >= 10


def test_small_table(spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    verify(spark, spark.read.parquet(f"{small}/documents.parquet"), items)


def test_awkward(spark):
    verify(spark, awkward(spark), [(1, "a b c d"), (1, "a b c d"), (None, "one"), (3, "漢字")])
    verify(spark, awkward(spark).limit(0), [(1, "a b c d")])
    assert leaks.find(awkward(spark), spark.createDataFrame([], SCHEMA)).count() == 0


def test_inserted_words_at_every_offset(spark):
    """An item of 59 words with ten words inserted, wherever it stands."""
    rng = random.Random(2)
    vocabulary = [f"x{i}" for i in range(900)]
    item = rng.sample(vocabulary, 59)
    leak = [*item[:30], *(f"new{k}" for k in range(10)), *item[30:]]
    docs = documents(spark, [" ".join([*rng.choices(vocabulary, k=64 + at), *leak, *rng.choices(vocabulary, k=150)]) for at in range(64)])
    assert leaks.find(docs, spark.createDataFrame([(1, " ".join(item))], SCHEMA)).count() == 64


def test_slices_do_not_change_scores(spark):
    rng = random.Random(6)
    vocabulary = [f"x{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 100)))) for i in range(60)]
    docs = documents(spark, [" ".join([*rng.choices(vocabulary, k=rng.randint(0, 200)), *items[k][1].split()]) for k in range(60)])
    bench = spark.createDataFrame(items, SCHEMA)
    one, many = (sorted(tuple(r) for r in leaks.find(docs, bench, slice_bytes=b).collect()) for b in (16 << 20, 600))
    assert len(one) >= 60 and [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in many]
    assert [r[2] for r in one] == pytest.approx([r[2] for r in many], rel=1e-12)


def test_memory_of_a_large_index():
    """100,000 items: the arrays of a worker stay below 500 MB."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 200_000}" for _ in range(17))) for i in range(100_000)]
    index = leaks.Index(rows)
    size = index.groups.nbytes + sum(a.itemsize * len(a) for pair in (*index.postings, *index.blocks) for a in pair)
    assert len(index.owner) == 100_000 and size < 200_000_000
    hits = [s for first, query, allowed in index.passages(leaks.words("so " * 80 + rows[77][1])) for s, _ in index.search(query, allowed)]
    assert 77 in hits


def test_repeated_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven", "a"), (1, "a clean text", "b")], "doc_id long, text string, `__leaked` string")
    left = leaks.clean(docs, spark.createDataFrame([(1, "one two three four five six seven")], SCHEMA))
    assert [r.text for r in left.collect()] == ["a clean text"] and left.columns == docs.columns
