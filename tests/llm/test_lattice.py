import math
import zlib
from collections import Counter

import public_tokenizers
import pytest
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute_log10(model, word):
    """Over all segmentations, one by one."""
    s = b" " + word

    def total(at):
        if at == len(s):
            return 1.0
        return sum(model.weights[s[at:e]] * total(e) for e in range(at + 1, len(s) + 1) if s[at:e] in model.weights)

    return math.log10(total(0))


@settings(max_examples=80, deadline=None)
@given(st.text(st.characters(exclude_characters=" \t\n\r\x0b\x0c", exclude_categories=("Cs",)), min_size=1, max_size=4))
def test_lattice_sums_all_segmentations(word):
    model = lattice.Lattice(lattice.pieces(PATH), {300: 5, 400: 7, 29871: 3})
    b = word.encode()[:12]
    assert math.isclose(model.log10(b), brute_log10(model, b), rel_tol=1e-9)


def test_probabilities_sum_to_one_and_long_words_do_not_underflow():
    model = lattice.Lattice(lattice.pieces(PATH), {300: 5})
    assert math.isclose(sum(model.weights.values()) + 10**model.end, 1.0)
    one, two = model.log10(b"a" * 3000), model.log10(b"a" * 6000)
    assert math.isfinite(two) and 1.9 < two / one < 2.1


def brute(rows):
    train = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*lattice.tokens(t), b"\n"])
    total, distinct = sum(train.values()), len(train)
    own = lattice.pieces(PATH)
    counts = own.count([w.decode() for w in train if w != b"\n"], [n for w, n in train.items() if w != b"\n"])
    counts[own.end] = train[b"\n"]
    model = lattice.Lattice(own, counts)
    out = []
    for i, t in rows:
        found = [*lattice.tokens(t), b"\n"]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        base = sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in found)
        score = sum(model.end if w == b"\n" else model.log10(w) for w in found)
        out.append((i, held, len(found), sum(train[w] > 0 for w in found), total, base, score))
    return out


def verify(docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in lattice.score(docs, PATH, **how).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])


@pytest.mark.parametrize("frequent", [0, 100, 1 << 17])
def test_small_table(spark, small, frequent):
    verify(spark.read.parquet(f"{small}/documents.parquet").repartition(3), frequent=frequent)


def test_awkward(spark):
    verify(awkward(spark))


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    verify(documents(spark, ["a b"], first=held))
    assert lattice.score(documents(spark, ["x"]).limit(0), PATH).count() == 0


def test_very_long_words(spark):
    """Words of a megabyte are never broadcast, however often they stand."""
    long = "ab" * 500_000
    verify(documents(spark, [long, long + " x y", "x y z", long]))


def test_base_score_against_sql(spark, small):
    """The base score by DuckDB."""
    import duckdb

    ids = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE folds (doc_id BIGINT, train BOOLEAN)")
    con.executemany("INSERT INTO folds VALUES (?, ?)", ids)
    want = con.execute(
        rf"""
        WITH t AS (
            SELECT doc_id, train, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [chr(10)]) AS w
            FROM '{small}/documents.parquet' JOIN folds USING (doc_id)),
        c AS (SELECT w, count(*) FILTER (train) AS n FROM t GROUP BY w),
        s AS (SELECT sum(n) AS total, count(*) FILTER (n > 0) AS kinds FROM c)
        SELECT doc_id, count(*), count(*) FILTER (n > 0), any_value(total)::BIGINT, sum(log10((n + 1) / (total + kinds + 1))) FROM t JOIN c USING (w), s GROUP BY doc_id ORDER BY 1"""
    ).fetchall()
    got = lattice.score(spark.read.parquet(f"{small}/documents.parquet"), PATH).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score").orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == [w[:4] for w in want] and [r[4] for r in got] == pytest.approx([w[4] for w in want])
