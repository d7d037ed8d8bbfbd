import itertools

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents

from quirespark.llm import simhash


def brute_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows):
    """Ids that stay: of each component of similar texts the least."""
    sets, top = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            top[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_near_copies_go_in_the_stage(spark, small):
    """Near copies of 0.9 and more, of which the fingerprints differ in more than two bits."""
    rng = np.random.default_rng(3)
    texts, far = [], 0
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        copy = [*words]
        for at in (40, 150, 260)[: 1 + k % 3]:
            copy[at] = "changed"
        texts += [" ".join(words), " ".join(copy)]
        a, b = (simhash.majority(np.array(simhash.shingle_hashes(t), np.uint64), np.array([0]))[0] for t in texts[-2:])
        far += int(a ^ b).bit_count() > 2
    assert far > 5
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, documents(spark, texts), small)
    assert {r.doc_id for r in kept.collect()} == set(range(0, 60, 2))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_whole_table(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


def near_texts(seed, n, size=200, similarity=0.8):
    """Pairs of texts whose similarity is `similarity` or just above, by words changed far apart."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 100_000, size)]
        changed = int((1 - similarity) / (1 + similarity) * (size - 4) / 5)
        copy = [*words]
        for at in (rng.permutation((size - 8) // 5)[:changed] * 5 + 4).tolist():
            copy[at] = "changed"
        out.append((" ".join(words), " ".join(copy)))
    return out


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.9), (0.85, 0.97), (0.9, 0.99)])
def test_recall_near_the_threshold(spark, similarity, least):
    """Measured recall of pairs at a similarity of 0.8, 0.85 and 0.9."""
    pairs = near_texts(7, 400, similarity=similarity)
    docs = documents(spark, [t for p in pairs for t in p])
    assert all(len(brute_set(a) & brute_set(b)) >= 0.8 * len(brute_set(a) | brute_set(b)) for a, b in pairs)
    left = simhash.keep_one(docs).count()
    assert 400 <= left <= 400 + (1 - least) * 400


def test_exact_similarity_decides():
    base = np.arange(100, dtype=np.uint64)
    assert simhash.alike(base, base + np.uint64(11), 80)  # 89 of 111
    assert not simhash.alike(base, base + np.uint64(12), 80)  # 88 of 112
    assert not simhash.alike(base, base[:79], 80) and simhash.alike(base, base[:80], 80)


def test_below_the_threshold_stays(spark):
    pairs = near_texts(9, 40, similarity=0.7)
    docs = documents(spark, [t for p in pairs for t in p])
    assert simhash.keep_one(docs).count() == 80


@pytest.mark.parametrize("bucket", [1, 4096])
def test_hot_groups(spark, bucket, monkeypatch):
    """A large group of near copies, dealt by one band and by two, and in several chunks of a bucket."""
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = []
    for k in range(300):
        copy = [*words]
        copy[20 + k % 160] = f"x{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(50)] + [texts[0]] * 30
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash.near_links, "__defaults__", (simhash.Near(), bucket))
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    docs = documents(spark, texts)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {0, *range(300, 350)}


def test_large_buckets_keep_every_candidate(spark, monkeypatch):
    """Pairs at a similarity of 0.8 that meet in buckets of two texts, each of which is over the limit of one."""
    pairs = near_texts(7, 400, similarity=0.8)
    docs = documents(spark, [t for p in pairs for t in p])
    whole = {r.doc_id for r in simhash.keep_one(docs).collect()}
    monkeypatch.setattr(simhash, "BUCKET", 1)
    monkeypatch.setattr(simhash.near_links, "__defaults__", (simhash.Near(), 1))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == whole


@pytest.mark.parametrize("bucket", [2, 4096])
def test_a_text_between_two_others_joins_both(spark, bucket, monkeypatch):
    """Each text is similar to its middle one, not to the others: more links than the nearest of each."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 300)]
        places = (rng.permutation(58)[:12] * 5 + 4).tolist()
        for k in range(4):
            copy = [*words]
            for at in places[4 * (k - 1) : 4 * k] if k else []:
                copy[at] = f"changed{k}"
            texts.append(" ".join(copy))
    rows = list(enumerate(rng.permutation(texts).tolist()))
    want = brute(rows)
    assert len(want) == 60 and not len(brute([r for r in rows if r[1] not in texts[::4]])) < 180
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash.near_links, "__defaults__", (simhash.Near(), bucket))
    assert {r.doc_id for r in simhash.keep_one(documents(spark, [t for _, t in rows])).collect()} == want


def test_all_pairs_of_two_labels_against_brute_force():
    rng = np.random.default_rng(6)
    how = simhash.Near(words=1, most=10)
    codes = rng.integers(0, 2**63, 5, dtype=np.uint64)[rng.integers(0, 5, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    keys, labels = np.sort(rng.integers(0, 12, 300)), rng.integers(0, 3, 300)
    name = lambda k: int(k).to_bytes(16, "big")
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(np.zeros(b - a, np.int64)), *(pa.array([f(x) for x in of[a:b]], pa.binary()) for f, of in ((name, range(300)), (lambda c: c.tobytes(), codes), (name, labels)))], names=list("abcde")) for a, b in ((0, 70), (70, 71), (71, 300))]
    got = [tuple(sorted((int.from_bytes(u), int.from_bytes(v)))) for x in simhash._pair_batches(how)[0](iter(batches)) for u, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    assert sorted(got) == [(i, j) for i, j in itertools.combinations(range(300), 2) if keys[i] == keys[j] and labels[i] != labels[j] and int(codes[i] ^ codes[j]).bit_count() <= 10]


def test_nearest_leaders_against_all_pairs():
    rng = np.random.default_rng(3)
    how = simhash.Near(words=1, most=10, near=3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    codes = base[rng.integers(0, 6, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    groups = np.sort(rng.integers(0, 9, 200))
    row, to, leaders = simhash.nearest_leaders(groups, codes[:, None], how)
    want, leads = {}, []
    for i in range(200):
        seen = [(int(codes[i] ^ codes[j]).bit_count(), j) for j in leads if groups[j] == groups[i]]
        if seen and min(seen)[0] <= how.most:
            want[i] = min(seen)[1]
        if not seen or min(seen)[0] > how.near:
            leads.append(i)
    assert dict(zip(row.tolist(), to.tolist(), strict=True)).keys() == want.keys() and leaders.tolist() == leads
    for i, j in zip(row.tolist(), to.tolist(), strict=True):
        assert int(codes[i] ^ codes[j]).bit_count() == int(codes[i] ^ codes[want[i]]).bit_count()


def test_awkward(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 6, 7]
    assert simhash.keep_one(documents(spark, ["x"]).filter("doc_id < 0")).count() == 0


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, "alpha beta", 0), (5, "totally other", 1), (5, "alpha beta", 2), (None, "alpha beta", 3)]
    names = ["content", "first", "first_id", "label", "n", "least", "bands", "code"]
    docs = spark.createDataFrame([(d, t, *[str(k)] * len(names)) for d, t, k in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.content for r in kept.collect()) == ["0", "1"]


def test_sketches_prove_only_unlike_pairs():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 5, 30, 140, 150, 900, 9000)]
    for share in (0.02, 0.05, 0.1, 0.12, 0.3):
        sets += [np.unique(np.concatenate([s[rng.random(len(s)) >= share], rng.integers(0, 2**63, rng.integers(0, 2 + int(share * len(s))), dtype=np.uint64)])) for s in sets[:8]]
    sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    pairs = np.array(list(itertools.combinations(range(len(sets)), 2)))
    kept = simhash.maybe_alike(pairs, np.array([len(s) for s in sets]), np.array([simhash.sketch(s) for s in sets], object), 80)
    kept = set(map(tuple, kept.tolist()))
    true = {(i, j) for i, j in map(tuple, pairs.tolist()) if simhash.alike(sets[i], sets[j], 80)}
    assert 20 < len(true) <= len(true & kept) and len(kept) < 3 * len(true) < len(pairs) / 2


def test_unlike_texts_of_a_large_group_make_no_pairs(spark, monkeypatch):
    """Texts of one template that are near each other by fingerprint, at a similarity of 0.75: not a row for each two of them."""
    rng = np.random.default_rng(4)
    words, texts = [f"w{x}" for x in rng.integers(0, 100_000, 300)], []
    for k in range(200):
        copy = [*words]
        for at in (rng.permutation(58)[:9] * 5 + 4).tolist():
            copy[at] = f"x{k}"
        texts.append(" ".join(copy))
    made = []
    whole = simhash.rest_links

    def counted(*args):
        pairs = whole(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash, "rest_links", counted)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()} == want
    assert len(want) > 50 and made[0] <= 5 * len(texts)
