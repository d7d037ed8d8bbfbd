"""Language-model scores by subword lattices.

A token (lower-cased word, or the end of a text) is a sequence of pieces of an existing vocabulary with byte
fallback. Piece scores are learned from the training texts: counts of the pieces into which the vocabulary cuts
their words, smoothed. A word's probability is the sum over all its segmentations, by forward recursion in log
space, and a text's is the product over its tokens, as no piece crosses a word's start. The base score beside it
is an add-one unigram model of whole tokens.

Counting words gives one table of all words with their training counts; each distinct word goes through its
lattice once. The most frequent words, at most `frequent` of them, are broadcast, and a text's other words are joined
with the table. What is gathered grows with the corpus, and only counts of pieces and frequent words reach the driver.

Defined results: null and empty texts have one token, their end; a null doc_id trains; equal rows each train and
get equal scores; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import Scratch, settled

#: Distinct words that a task counts before it sends them on; the word that stands for a text's end (no word has a line break).
HELD, END = 200_000, "\n"
#: Rare words of an output batch, about, each sixteen bytes of one; bytes of words that a task counts; bytes of a word that is broadcast at most.
SENT, HELD_BYTES, SHORT = 50_000, 32 << 20, 256
SPACE = "▁"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Pieces:
    """A sentencepiece vocabulary as byte strings; a leading space marks a word's start."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes | None] = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i) or SPACE in piece[1:]:
                self.bytes.append(None)
            else:
                self.bytes.append(piece.replace(SPACE, " ").encode())
        self.end = self.model.eos_id()

    def count(self, words: list[str], times: list[int]) -> Counter:
        """Pieces of the vocabulary's own segmentation, over all words."""
        out: Counter = Counter()
        for ids, n in zip(self.model.encode(words, num_threads=1), times, strict=True):
            for i in ids:
                out[i] += n
        return out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Log10 probabilities of words from piece scores (natural logarithms by byte string)."""

    def __init__(self, vocabulary: Pieces, counts: dict[int, int], smoothing: float = 0.1):
        used = [i for i, b in enumerate(vocabulary.bytes) if b is not None or i == vocabulary.end]
        total = sum(counts.get(i, 0) for i in used) + smoothing * len(used)
        self.weights: dict[bytes, float] = {}
        for i in used:
            if i != vocabulary.end:  # a byte and a character may be written alike
                b = vocabulary.bytes[i]
                self.weights[b] = self.weights.get(b, 0.0) + (counts.get(i, 0) + smoothing) / total
        self.end = math.log10((counts.get(vocabulary.end, 0) + smoothing) / total)
        self.longest = max(map(len, self.weights))

    def log10(self, word: bytes) -> float:
        """Sum over all segmentations. Sums are kept relative to the last scale, so that long words don't underflow."""
        s = b" " + word
        n, longest, weight = len(s), self.longest, self.weights.get
        forward, scale = [1.0], 0.0
        base = 0  # forward[k] is of place base + k
        for end in range(1, n + 1):
            total = 0.0
            for start in range(max(0, end - longest), end):
                w = weight(s[start:end])
                if w is not None:
                    total += forward[start - base] * w
            forward.append(total)
            if total < 1e-200:
                first = max(0, end + 1 - longest) - base
                forward, base = [f / total for f in forward[first:]], base + first
                scale += math.log(total)
        return (scale + math.log(forward[-1])) / math.log(10)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of training rows, and of the others with n = 0 so that each word is in the table."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    ends = size = 0

    def counted() -> pa.RecordBatch:
        train, held = seen[True], seen[False]
        words = [*train, *(w for w in held if w not in train)]
        n = [*train.values(), *[0] * (len(words) - len(train))]
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], schema=schema)
        train.clear()
        held.clear()
        return out

    for batch in batches:
        for text, held in zip(*batch.columns, strict=True):
            held, found = held.as_py(), tokens(text.as_py())
            seen[not held].update(found)
            ends += not held
            size += sum(len(w) for w in found if len(w) > SHORT)
            if len(seen[True]) + len(seen[False]) > HELD or size > HELD_BYTES:
                yield counted()
                size = 0
    yield counted()
    yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], schema=schema)


def _count_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in batches:
            words, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(words), 4096):
                out += pieces(path).count(words[at : at + 4096], times[at : at + 4096])
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.int64())], names=["piece", "n"])

    return run


def _word_scores(path: str, counts: dict[int, int], smoothing: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice(pieces(path), counts, smoothing)
        for batch in batches:
            words = batch.column(0).cast(pa.binary()).to_pylist()
            scores = [model.end if w == b"\n" else model.log10(w) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["word", "n", "logp"])

    return run


ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())])))])
ROWS_SQL = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, lattice double, rare array<struct<word string, times long>>"


def _score_rows(frequent):
    """Sums over the frequent words of each text, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, base, lattice = frequent.value
        place = {w: k for k, w in enumerate(words)}
        get = place.get
        row = TaskContext.get().partitionId() << 34
        out: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROWS, strict=True)], schema=ROWS)

        for batch in batches:
            for doc_id, text, held in zip(*batch.columns, strict=True):
                found = tokens(text.as_py())
                at = list(map(get, found))
                rare: Counter = Counter()
                if None in at:
                    rare.update(w for w, k in zip(found, at, strict=True) if k is None)
                    at = [k for k in at if k is not None]
                at.append(place[b"\n"])
                k = np.array(at)
                out.append((row, doc_id.as_py(), held.as_py(), len(found) + 1, int(known[k].sum()), float(base[k].sum()), float(lattice[k].sum()), [{"word": w.decode(), "times": n} for w, n in rare.items()]))
                row += 1
                size += 10 + len(rare) + sum(map(len, rare)) // 16
                if size >= SENT:
                    yield made()
                    out, size = [], 0
        if out:
            yield made()

    return run


def score(docs: DataFrame, model_path: str, frequent: int = 1 << 17, smoothing: float = 0.1, fold: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out)
    with Scratch(spark) as scratch:
        words = scratch.keep(rows.select("text", "held_out").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
        total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
        # At most one count for each piece of the vocabulary reaches the driver.
        used = words.filter(F.col("n") > 0)
        counts = {r.piece: r.n for r in used.filter(F.col("word") != END).mapInArrow(_count_pieces(model_path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        ends = used.filter(F.col("word") == END).first()
        counts[pieces(model_path).end] = ends.n if ends else 0
        scored = scratch.keep(words.mapInArrow(_word_scores(model_path, counts, smoothing), "word string, n long, logp double"), "scored")
        scratch.drop("words")
        # Words by the octave of their count, and from the top as many octaves as stay within `frequent` words.
        octave = F.floor(F.log2(F.col("n") + 1) * 16)
        # Longer words are never among them, so that what is broadcast is at most `frequent` times SHORT bytes.
        short = F.octet_length("word") <= SHORT
        least, room = math.inf, frequent
        for r in scored.filter(short).groupBy(octave.alias("octave")).count().orderBy(F.desc("octave")).collect():
            room -= r["count"]
            if room < 0:
                break
            least = r.octave
        top = scored.filter(short & (octave >= float(least)) & (F.col("word") != END)).unionByName(scored.filter(F.col("word") == END)).collect()
        if not any(r.word == END for r in top):
            top = [*top, type("End", (), {"word": END, "n": 0, "logp": 0.0})]
        n = np.array([r.n for r in top], np.float64)
        held_top = spark.sparkContext.broadcast(([r.word.encode() for r in top], n > 0, np.log10(n + 1), np.array([r.logp for r in top])))
        texts = scratch.keep(rows.mapInArrow(_score_rows(held_top), ROWS_SQL), "texts")
        rare = texts.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.times")
        joined = rare.join(scored.filter((octave < float(least)) | ~short), "word").groupBy("row").agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"), F.sum(F.col("times") * F.col("logp")).alias("more_lattice")
        )
        zero = F.lit(0.0)
        out = texts.drop("rare").join(joined, "row", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
            (F.col("lattice") + F.coalesce("more_lattice", zero)).alias("score"),
        )
        return settled(out)
