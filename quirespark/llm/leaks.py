"""Benchmark decontamination: a BM25 inverted index of test items, with block-max WAND searched by every passage.

A text's words (lower-cased letters, digits and bytes above 127) are cut into strides of 64, and each two neighbouring
strides are a passage. An item of more than 64 words is cut into equal sections of 64 at most; others are one section.
A term's impact on a section is its BM25 weight divided by what all terms of the section reach together, so a score is
between 0 and 1. Every passage is a query of distinct terms that retrieves all sections whose threshold its score
reaches: postings are in blocks, each with its greatest impact by term; groups of blocks whose impacts can't add up to
the threshold are passed over, and WAND moves its pivot through the others. Retrieved items are verified: the share of
the five-word shingles of the question (the item's first part), and of its answer (the rest), that the passage with
as many words as the item has on both sides holds must both be 0.8 at least.

A section's threshold is the least score that verification can accept. Where 0.8 of an item's shingles are held, some
section lacks a fifth of those that start in it at most; each word that a passage lacks costs one of them, so the passage
reaches the whole score less that many of the greatest impacts. It holds a word of the section in any case, so the
threshold is the section's least impact at least. A fixed threshold may be given instead.

The index is broadcast in slices of at most `slice_bytes` of item text, built once by each worker; a larger benchmark
takes a pass for each slice. Numbers of items, document frequencies and the mean length are those of the whole
benchmark, so that results don't depend on the slices.

Defined results: null and empty texts have no passages; null and wordless items match nothing; equal items are
each reported; rows that repeat a doc_id are reported once by find(), and judged each by its own text by clean(); an empty
table gives no rows; other columns are ignored by find() and kept by clean().
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import settled

#: BM25 constants, sections of a block, words of a stride (and of a section at most), groups of blocks.
K1, B, BLOCK, STRIDE, GROUPS = 1.2, 0.75, 8, 64, 64
#: Letters to lower case, other ASCII characters but digits to spaces.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def shingles(found: list, size: int) -> set[tuple]:
    """Runs of `size` words; of fewer words the whole."""
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def sections(found: list[bytes]) -> list[list[bytes]]:
    """Equal cuts of STRIDE words at most."""
    n = -(-len(found) // STRIDE)
    return [found[k * len(found) // n : (k + 1) * len(found) // n] for k in range(n)]


class Item(NamedTuple):
    item_id: int | None
    question: set[tuple]
    answer: set[tuple]
    size: int


class Statistics(NamedTuple):
    """Of the whole benchmark: sections, words in them, and the sections that hold a term."""

    n: int
    words: int
    df: dict[bytes, int]


def statistics(texts: list[str | None]) -> Statistics:
    """Those of a benchmark that is one slice."""
    df: dict[bytes, int] = {}
    n = total = 0
    for t in texts:
        for part in sections(words(t)):
            n += 1
            total += len(part)
            for w in set(part):
                df[w] = df.get(w, 0) + 1
    return Statistics(n, total, df)


class Index:
    """Postings by term, sorted by section, with the maxima of their blocks."""

    def __init__(self, rows: list[tuple], shingle: int = 5, share: float = 0.8, threshold: float | None = None, question_share: float = 2 / 3, whole: Statistics | None = None):
        whole = whole or statistics([t for _, t in rows])
        self.items: list[Item] = []
        #: Item of each section.
        self.owner: list[int] = []
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        sizes: list[int] = []
        lacking: list[int] = []
        for i, t in rows:
            w = words(t)
            if not w:
                continue
            cut = max(1, min(len(w) - 1, round(len(w) * question_share)))
            self.items.append(Item(i, shingles(w[:cut], shingle), shingles(w[cut:], shingle), len(w)))
            parts = sections(w)
            for part in parts:
                k = len(self.owner)
                self.owner.append(len(self.items) - 1)
                sizes.append(len(part))
                # one section: both parts of the item have their own allowance; of several, a fifth of the section's words, and
                # those at the question's end that start no shingle
                lacking.append(sum(int((1 - share) * len(p) + 1e-9) for p in self.items[-1][1:3]) if len(parts) == 1 else int((1 - share) * len(part) + 1e-9) + shingle - 1)
                times: dict[bytes, int] = {}
                for term in part:
                    times[term] = times.get(term, 0) + 1
                for term, f in times.items():
                    at = self.terms.setdefault(term, len(self.terms))
                    if at == len(postings):
                        postings.append([])
                    postings[at].append((k, f))
        n = len(self.owner)
        lengths, mean = np.array(sizes, float), whole.words / max(1, whole.n)
        found = [(np.array([k for k, _ in p], np.int64), np.array([f for _, f in p], float)) for p in postings]
        del postings
        impacts = []
        for term, (at, tf) in zip(self.terms, found, strict=True):
            df = whole.df[term]
            impacts.append(np.log(1 + (whole.n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[at] / mean)))
        at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
        impact = np.concatenate(impacts) if found else np.zeros(0)
        reach = np.bincount(at, impact, n)
        if threshold is None:
            self.thresholds = self._thresholds(at, impact, reach, np.array(lacking, np.int64))
        else:
            self.thresholds = np.full(n, threshold)
        # impacts are in parts of the section's threshold, so that 1 reaches it
        impact = impact / reach[at] / self.thresholds[at] if n else impact
        ends = np.cumsum([0, *(len(a) for a, _ in found)])
        self.width = max(1, -(-n // (BLOCK * GROUPS))) * BLOCK  # sections of a group
        self.groups = np.zeros((len(self.terms) + 1, -(-n // self.width)), np.float32)
        term = np.repeat(np.arange(len(found)), np.diff(ends))
        np.maximum.at(self.groups, (term, at // self.width), np.float32(impact * 1.000001))
        new = np.append(True, (term[1:] != term[:-1]) | (at[1:] // BLOCK != at[:-1] // BLOCK)) if n else np.zeros(0, bool)
        first = np.flatnonzero(new)
        most = np.maximum.reduceat(impact, first) if n else impact
        cuts = np.searchsorted(first, ends)
        blocks = at[first] // BLOCK
        self.postings = [(array("q", at[a:b].tobytes()), array("d", impact[a:b].tobytes())) for a, b in zip(ends, ends[1:], strict=False)]
        self.blocks = [(array("q", blocks[a:b].tobytes()), array("d", most[a:b].tobytes())) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.most = [max(m) for _, m in self.blocks]

    @staticmethod
    def _thresholds(at: np.ndarray, impact: np.ndarray, reach: np.ndarray, lacking: np.ndarray) -> np.ndarray:
        """1 less the greatest impacts of as many words as an accepted passage may lack; the least impact at least."""
        order = np.lexsort((-impact, at))
        own, first = impact[order], np.searchsorted(at[order], np.arange(len(reach)))
        sums = np.append(0.0, np.cumsum(own))
        many = np.minimum(lacking, np.bincount(at, minlength=len(reach)))
        least = np.minimum.reduceat(own, first) if len(own) else own
        return np.maximum(least / reach, 1 - (sums[first + many] - sums[first]) / reach) * (1 - 1e-9)

    def _block(self, term: int, block: int) -> float:
        """The greatest impact of a term in a block."""
        ids, most = self.blocks[term]
        k = bisect_left(ids, block)
        return most[k] if k < len(ids) and ids[k] == block else 0.0

    def search(self, query: list[int], allowed: np.ndarray, threshold: float = 1.0) -> list[tuple[int, float]]:
        """(item, score) of all items that reach the threshold, by block-max WAND. allowed: groups that may hold any."""
        cursors = [[self.postings[t][0][0], 0, t] for t in query]
        limit = threshold * (1 - 1e-9)
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= limit:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            block = item // BLOCK
            lead = pivot + 1
            while lead < len(cursors) and cursors[lead][0] == item:
                lead += 1
            group = item // self.width
            if not allowed[group]:
                goal, lag = (group + 1) * self.width, cursors
            elif sum(self._block(t, block) for _, _, t in cursors[:lead]) < limit:
                # nothing before the block's end, or before the next cursor, can reach the threshold
                goal = min((block + 1) * BLOCK, cursors[lead][0]) if lead < len(cursors) else (block + 1) * BLOCK
                goal = max(goal, item + 1)
                lag = cursors[:lead]
            elif cursors[0][0] == item:
                score = sum(self.postings[t][1][at] for _, at, t in cursors[:lead])
                if score >= limit:
                    out.append((item, score))
                goal, lag = item + 1, cursors[:lead]
            else:
                goal, lag = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in lag:
                items = self.postings[c[2]][0]
                at = bisect_left(items, goal, c[1])
                c[1], c[0] = at, items[at] if at < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def passages(self, found: list[bytes], threshold: float = 1.0) -> Iterator[tuple[int, list[int], np.ndarray]]:
        """(first word, distinct terms, groups that may reach the threshold) of the passages that any group may match."""
        terms = np.fromiter((self.terms.get(w, -1) for w in found), np.int64, len(found))
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return
        width = len(self.terms) + 1
        keys = np.unique(at // STRIDE * width + terms[at])
        stride, term = keys // width, keys % width
        first = np.flatnonzero(np.append(True, stride[1:] != stride[:-1]))
        have = stride[first]
        sums = np.add.reduceat(self.groups[term], first, axis=0)
        # a passage begins at each stride with terms, and at the one before it
        starts = np.unique(np.concatenate([have, have[have > 0] - 1]))
        bounds = np.zeros((len(starts), sums.shape[1]), np.float32)
        for shift in (0, 1):
            k = np.minimum(np.searchsorted(have, starts + shift), len(have) - 1)
            met = have[k] == starts + shift
            bounds[met] += sums[k[met]]
        for s in starts[bounds.max(axis=1) * np.float32(1.00001) >= threshold].tolist():
            own = np.unique(term[np.searchsorted(stride, s) : np.searchsorted(stride, s + 2)])
            exact = self.groups[own].sum(axis=0) * np.float32(1.00001)
            if exact.max() >= threshold:
                yield s * STRIDE, own.tolist(), exact >= threshold

    def matches(self, text: str | None, share: float, shingle: int, one: bool = False) -> dict[int, tuple[float, float, float, int]]:
        """item -> (score, question overlap, answer overlap, first word) of its best verified passage; of `one`, the first found."""
        found = words(text)
        out: dict[int, tuple[float, float, float, int]] = {}
        for first, query, allowed in self.passages(found) if found else ():
            for section, score in self.search(query, allowed):
                item = self.owner[section]
                i = self.items[item]
                wide = found[max(0, first - i.size) : first + 2 * STRIDE + i.size]
                have = shingles(wide, shingle)
                # parts of fewer words than a shingle are looked for as runs of their own length
                over = [len(p & (have if len(next(iter(p))) == shingle else shingles(wide, len(next(iter(p)))))) / len(p) if p else 1.0 for p in (i.question, i.answer)]
                if min(over) >= share:
                    best = (round(min(1.0, score * float(self.thresholds[section])), 12), *over, first)  # sums in any order are one score
                    out[item] = max(out.get(item, best), best, key=lambda m: (m[0], -m[3]))
                    if one:
                        return out
        return out


_BUILT: dict[int, Index] = {}


def _index(held) -> Index:
    """The index of a broadcast slice, built once by a worker; another slice takes its place."""
    if held.key not in _BUILT:
        _BUILT.clear()
        _BUILT[held.key] = Index(*held.rows.value)
    return _BUILT[held.key]


class Held(NamedTuple):
    key: str
    rows: object


def _find(held: Held, share: float, shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _index(held)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns, strict=True):
                rows += [(doc_id.as_py(), by.items[k].item_id, *m) for k, m in by.matches(text.as_py(), share, shingle).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, sections with it), and under no term the words of all sections and their number."""
    for batch in batches:
        some = statistics(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([*some.df, None], pa.binary()), pa.array([*some.df.values(), some.n], pa.int64()), pa.array([*[0] * len(some.df), some.words], pa.int64())], names=["term", "n", "words"])


def _slices(benchmark: DataFrame, share: float, shingle: int, threshold: float | None, slice_bytes: int) -> Iterator[Held]:
    """The benchmark's items by the slice, each with the statistics of its terms in the whole benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    counted = settled(items.select("text").mapInArrow(_terms, "term binary, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    total = counted.filter("term IS NULL").first()
    n, length = (total.n, total.words) if total else (0, 0)
    for k in range(slices):
        # a slice holds about slice_bytes of text, whatever the benchmark's size, and its terms are fewer
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text")
        rows = [tuple(r) for r in part.collect()]
        own = part.select("text").mapInArrow(_terms, "term binary, n long, words long").select("term").distinct()
        df = {bytes(r.term): r.n for r in counted.filter("term IS NOT NULL").join(own, "term", "left_semi").select("term", "n").collect()}
        held = spark.sparkContext.broadcast((rows, shingle, share, threshold, 2 / 3, Statistics(n, length, df)))
        yield Held(f"{spark.sparkContext.applicationId}-{held._jbroadcast.id()}", held)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float | None = None, share: float = 0.8, shingle: int = 5, slice_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): verified items of each document, by their best passage."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for held in _slices(benchmark, share, shingle, threshold, slice_bytes):
        found = rows.mapInArrow(*_find(held, share, shingle))
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("question_overlap", "answer_overlap", "first_word"), F.struct("score", -F.col("first_word"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best).select("doc_id", "item_id", "score", "best.*")


def _leaked(held: Held, share: float, shingle: int):
    @F.pandas_udf("boolean")
    def leaked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = _index(held)
        for texts in batches:
            yield pd.Series([bool(by.matches(t, share, shingle, one=True)) for t in texts], dtype=bool)

    return leaked


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float | None = None, share: float = 0.8, shingle: int = 5, slice_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs without a verified item, with all their columns; nothing is shuffled."""
    for held in _slices(benchmark, share, shingle, threshold, slice_bytes):
        docs = docs.filter(~_leaked(held, share, shingle)(F.col("text")))
    return docs
