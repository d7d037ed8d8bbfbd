import collections
import math
import re
import zlib

import numpy as np
import xxhash
from helpers import SCHEMA, awkward, documents

from quirespark.llm import quality


def test_features_by_hand():
    make = quality.Features(18)
    row, place, value = make.rows(["a b a b", "", "x"])
    assert set(row.tolist()) == {0, 2}
    # words: a twice, b twice of four; pairs: "a b" twice, "b a" once of three; shapes: "a a" three times of three
    got = sorted(np.round(value[row == 0] ** 2, 6).tolist())
    assert got == sorted(np.round([0.5, 0.5, 2 / 3, 1 / 3, 1.0], 6).tolist())
    assert sorted(value[row == 2].tolist()) == [1.0]


def test_features_do_not_depend_on_batches():
    texts = ["the cat sat", "on the the the mat!!", "", "Ünï çödé 12 34"]
    whole = quality.Features(18)
    a = whole.rows(texts)
    for k, t in enumerate(texts):
        row, place, value = quality.Features(18).rows([t])
        assert place.tolist() == a[1][a[0] == k].tolist() and np.allclose(value, a[2][a[0] == k])


def test_ftrl_is_the_published_update():
    how = quality.Ftrl(bits=2, epochs=1)
    rows = [(np.array([0, 2]), np.array([1.0, 0.5]), 1), (np.array([0]), np.array([1.0]), 0), (np.array([2, 3]), np.array([0.3, 0.2]), 1)]
    z, n, w = [0.0] * 5, [0.0] * 5, [0.0] * 5
    for places, values, y in rows:
        x = dict(zip([*places.tolist(), 4], [*values.tolist(), 1.0], strict=True))
        for i in x:
            w[i] = 0.0 if abs(z[i]) <= how.l1 else -(z[i] - np.sign(z[i]) * how.l1) / ((how.beta + n[i] ** 0.5) / how.alpha + how.l2)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / how.alpha
            z[i] += g - s * w[i]
            n[i] += g * g
    want = [0.0 if abs(z[i]) <= how.l1 else -(z[i] - np.sign(z[i]) * how.l1) / ((how.beta + n[i] ** 0.5) / how.alpha + how.l2) for i in range(5)]
    weights, bias = quality.train(rows, how)
    assert np.allclose([*weights, bias], want)


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.doc_id in marks and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) >= 0.95


def test_awkward(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 1), (4, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = awkward(spark)
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.score is not None and r.held_out is not None for r in rows)
    scores = {}
    for r in rows:
        assert scores.setdefault(r.doc_id, r.score) == r.score
    kept = quality.keep_good(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(documents(spark, ["a b", None]), none).collect()} == {0.5}
    assert quality.score(spark.createDataFrame([], SCHEMA), none).count() == 0


def brute_score(text, weights, bias, bits=18):
    """A whole score by dictionaries of n-grams and plain integers."""
    a, b, c, most = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, (1 << 64) - 1
    words = (text or "").split()

    def shaped(w):
        w = re.sub("[A-ZÀ-ÖØ-Þ]+", "A", w)
        w = re.sub(r"[^\W\d_A-Z]+", "a", w)
        return re.sub(r"\d+", "0", w)

    word = [xxhash.xxh64_intdigest(w.encode(), 1) for w in words]
    form = [c if k and words[k - 1] == w else xxhash.xxh64_intdigest(shaped(w).encode(), 2) for k, w in enumerate(words)]
    kinds = [[w * a & most for w in word], [(x * a + y) * b & most for x, y in zip(word, word[1:], strict=False)], [(x * b + y) * c & most for x, y in zip(form, form[1:], strict=False)]]
    total = bias
    counts = collections.Counter()
    size = {}
    for kind in kinds:
        for h in kind:
            place = ((h ^ h >> 29) * a & most) >> (64 - bits)
            counts[place] += 1
            size.setdefault(place, len(kind))
    for place, n in counts.items():
        total += weights[place] * math.sqrt(n / size[place])
    return 1 / (1 + math.exp(-max(-35, min(35, total))))


def test_whole_scores_against_brute_force(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    weights, bias = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.score(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - brute_score(texts[r.doc_id], weights, bias)) < 1e-9


def test_shapes_are_whole_words():
    """Words that differ after many characters have different shapes."""
    assert quality.shape("ab-" * 20 + "x") != quality.shape("ab-" * 20 + "9")


def test_an_id_with_several_texts_trains_once(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame([(1, "a good text"), (2, "bad bad bad")], "doc_id long, text string")
    more = plain.unionByName(spark.createDataFrame([(1, "zzz")] * 5, "doc_id long, text string"))
    (w1, b1), (w2, b2) = quality.fit(plain, labels, fold=None), quality.fit(more, labels, fold=None)
    assert b1 == b2 and np.array_equal(w1, w2)
