"""Quality classifier: hashed word n-grams, logistic regression trained by follow-the-regularised-leader.

Features of a text, each hashed into 2^bits places: its words, its word pairs, and pairs of word shapes, where a
shape keeps symbols, folds letters and digits, and is `=` for a word that repeats its predecessor. A place's value
is the square root of its share of the text's n-grams of that kind, so a score is a sparse dot product of bounded length.

Training takes at most `rows` labelled documents (those of least hash of doc_id), in one task that sees them in a
fixed order; the weights, at most 2^bits of them, are broadcast. Every document is scored over its whole text.

Defined results: null and empty texts have no features and get the score of the bias; rows with a null label don't
train, and a doc_id labelled twice counts once, with its higher label; of several texts of a doc_id the least trains; without labels every score is a half; equal rows
get equal scores; an empty table gives no rows; other columns are ignored by score() and kept by keep_good().
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
A, B, C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Words of a worker's cache, and words that are scored at once.
CACHED, AT_ONCE = 200_000, 1 << 18
SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"\d+"), "0"))


@dataclass(frozen=True)
class Ftrl:
    """Rates of follow-the-regularised-leader (per-coordinate), and the places of the hashing."""

    bits: int = 18
    alpha: float = 0.4
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    epochs: int = 4


def shape(word: str) -> str:
    for pattern, mark in SHAPES:
        word = pattern.sub(mark, word)
    return word


class Features:
    """Texts to sparse rows. Hashes of words are kept until there are too many of them."""

    def __init__(self, bits: int):
        self.shift = U(64 - bits)
        self.places: dict[str, int] = {}
        self.fresh: list[tuple[int, int]] = []
        self.known = np.zeros((2, 0), U)

    def indexes(self, text: str) -> list[int]:
        places, words = self.places, text.split()
        out = list(map(places.get, words))
        if None in out:
            for k, i in enumerate(out):
                if i is None:
                    w = words[k]
                    i = places.get(w)
                    if i is None:
                        i = places[w] = len(places)
                        self.fresh.append((xxhash.xxh64_intdigest(w.encode(), 1), xxhash.xxh64_intdigest(shape(w).encode(), 2)))
                    out[k] = i
        return out

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, value), by row."""
        if len(self.places) > CACHED:
            self.places, self.fresh, self.known = {}, [], np.zeros((2, 0), U)
        lists = [self.indexes(t) for t in texts]
        if len(self.fresh) * 8 > self.known.shape[1] or not self.known.shape[1]:
            self.known, self.fresh = np.concatenate([self.known, np.array(self.fresh, U).reshape(-1, 2).T], axis=1), []
        hashes = np.concatenate([self.known, np.array(self.fresh, U).reshape(-1, 2).T], axis=1) if self.fresh else self.known
        n = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter((i for x in lists for i in x), np.int64, n.sum())
        row = np.repeat(np.arange(len(texts)), n)
        if not len(ids):
            return row, ids, np.zeros(0)
        word, form = hashes[0][ids], hashes[1][ids]
        pair = row[1:] == row[:-1]
        form[1:][pair & (ids[1:] == ids[:-1])] = C
        kinds = [(row, word * A), (row[1:][pair], ((word[:-1] * A + word[1:]) * B)[pair]), (row[1:][pair], ((form[:-1] * B + form[1:]) * C)[pair])]
        keys = np.concatenate([r.astype(U) << U(24) | (h ^ h >> U(29)) * A >> self.shift for r, h in kinds])
        totals = np.concatenate([np.bincount(r, minlength=len(texts))[r] for r, _ in kinds])
        keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
        return (keys >> U(24)).astype(np.int64), (keys & U((1 << 24) - 1)).astype(np.int64), np.sqrt(counts / totals[first])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], how: Ftrl) -> tuple[np.ndarray, float]:
    """(weights, bias) from (places, values, label) rows, in their order."""
    size = (1 << how.bits) + 1  # the last place is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * how.l1) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)
        return np.where(np.abs(z[at]) <= how.l1, 0.0, w)

    for _ in range(how.epochs):
        for places, values, label in rows:
            at, x = np.append(places, size - 1), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def _train_task(how: Ftrl):
    schema = pa.schema([("place", pa.int64()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, rows = Features(how.bits), []
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("quality").to_pylist()
            for at in range(0, len(texts), 64):
                row, places, values = make.rows([t or "" for t in texts[at : at + 64]])
                cuts = np.searchsorted(row, np.arange(1, len(texts[at : at + 64])))
                rows += zip(np.split(places, cuts), np.split(values, cuts), labels[at : at + 64], strict=True)
        if rows:
            w, bias = train(rows, how)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], schema=schema)

    return run, "place long, weight double"


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8192, how: Ftrl = Ftrl(), fold: int | None = 5) -> tuple[np.ndarray, float]:
    """(weights, bias). Rows whose crc32(doc_id as text) mod `fold` is 0 never train."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    if fold:
        marked = marked.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0)
    sample = marked.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # bounded by `rows`
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))  # a row for each id, however often it stands
    task, schema = _train_task(how)
    ordered = texts.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    weights, bias = np.zeros(1 << how.bits), 0.0
    for r in ordered.select("text", "quality").mapInArrow(task, schema).collect():
        if r.place < 0:
            bias = r.weight
        else:
            weights[r.place] = r.weight
    return weights, bias


class Scorer:
    def __init__(self, bits: int, weights: np.ndarray, bias: float):
        self.make, self.weights, self.bias = Features(bits), weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1]) // 6
            if size >= AT_ONCE:
                out.append(self._some(part))
                part, size = [], 0
        out.append(self._some(part))
        return np.concatenate(out)

    def _some(self, texts: list[str]) -> np.ndarray:
        row, place, value = self.make.rows(texts)
        total = np.bincount(row, self.weights[place] * value, len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def scorer(spark: SparkSession, weights: np.ndarray, bias: float, how: Ftrl = Ftrl()):
    """A column function: the score of a text column. The weights have 2^bits places, whatever the input."""
    held = spark.sparkContext.broadcast((weights.astype(np.float64), bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = Scorer(how.bits, *held.value)
        for texts in batches:
            yield pd.Series(by.scores(texts.tolist()) if len(texts) else np.zeros(0))

    return score


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 8192, how: Ftrl = Ftrl(), fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    weights, bias = fit(docs, labels, rows, how, fold)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs.sparkSession, weights, bias, how)("text").alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 8192, how: Ftrl = Ftrl(), fold: int | None = 5) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    weights, bias = fit(docs, labels, rows, how, fold)
    return docs.filter(scorer(docs.sparkSession, weights, bias, how)(F.col("text")) >= threshold)
