"""Repeated-passage removal by a distributed merge sort of sampled suffixes.

A byte goes if a string of `width` bytes that covers it also starts earlier in the corpus (smaller doc_id, or
the same document and an earlier start).

Every string of `width` bytes holds an anchor: the leftmost least hash among its `gram`-byte substrings. Neighbouring
strings with one anchor form a run, and only the suffix at a run's start is sorted, cut where the run's last string
ends. Equal strings have equal anchors, so only suffixes that share an anchor are compared:

1. Anchors are counted; those that occur once can't be in a repeated string. A Bloom filter of fixed size tells of the
   others (its false positives only cost work). Where there are more than it can tell apart, they are joined with
   the anchors of the documents instead, and each document gets the list of its own.
2. Each chunk of documents, of the same size at every scale, sorts its suffixes by (anchor, bytes) and front-codes them
   (length of the prefix shared with the predecessor, and the rest). A task merges the runs of its chunks; of equal
   suffixes the earliest stays, the others are known to be repeats. The merged run is cut at fixed points of the anchor
   range, which deal it out evenly.
3. Each range merges its runs by a tree of losers that holds how much each loser shares with the last winner:
   unequal shared lengths decide without looking at a byte, equal ones are compared from there on. The merge yields the
   suffixes in order with the lengths of their common prefixes: equal suffixes are neighbours, and repeats of the earliest.
4. Different suffixes with one anchor may share some of their strings (the ends of repeated passages): the
   strings of each such suffix are matched by 128-bit hashes.

An anchor with very many suffixes is hot: its strings become suffixes of their own, which spread over all ranges.

Defined results: a null text is an empty one; texts under `width` bytes are kept; rows that repeat a doc_id and its text
are one document; of a doc_id with several texts the one of least hash is that document, and the others, like texts
without a doc_id, are documents of their own that come after all others; an empty table gives no rows; columns other
than doc_id and text are ignored by spans() and kept by remove().
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import fresh, settled

U = np.uint64
#: Bytes of text whose anchors are counted at once, that a map task sorts at once, and that are hashed at once; bytes of
#: front-coded runs that it merges.
CHUNK, SORTED, SLICE, HELD = 4 << 20, 2 << 20, 1 << 17, 24 << 20
#: log2 of the bits of the filter of repeated anchors; suffixes of a range; suffixes of an anchor that is hot at least.
FILTER_BITS, RANGE_ROWS, HOT_LEAST, HOT_SHARE = 28, 100_000, 2000, 500
#: Suffixes of anchors with different ones that are matched at once.
MATCHED = 10_000
#: Bits of a hash that the filter skips, for each of its places; bits of it for an anchor at least.
SKIPPED, BITS_EACH = (0, 18, 35), 3
#: Documents after all others.
LATER = 1 << 62
MIX = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; data has eight bytes more than there are places."""
    n = len(data) - 8
    return np.lib.stride_tricks.as_strided(data, (n, 8), (1, 1)).copy().view("<u8").ravel()


def _mixed(n: int, words: Iterable[np.ndarray], seed: int = 0) -> np.ndarray:
    h = np.full(n, seed, U)
    for k, w in enumerate(words):
        h += w
        h *= MIX[k & 3]
        h ^= h >> U(29 + (k & 3))
    return h


def runs(data: bytes, starts: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor's hash) of the runs of strings of `width` bytes within [start, end) of each document in data."""
    n, span = len(data), width - gram + 1
    padded = np.frombuffer(data + b"\0" * (gram + 8), np.uint8)
    w = _words(padded)
    grams = _mixed(n, (w[k : n + k] for k in range(0, gram, 8)))
    least, have = grams, 1
    while have * 2 <= span:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if span > have:
        least = np.minimum(least[: have - span], least[span - have :])
    m = len(least)
    edge = np.zeros(n + 1, np.int64)
    long = ends - starts >= width
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - width + 1, -1)
    inside = np.cumsum(edge)[:m] > 0
    new = np.zeros(m, bool)
    # a run ends where its anchor leaves, or where a smaller one enters
    new[1:] = (grams[: m - 1] == least[:-1]) | (least[1:] < least[:-1])
    new[starts[long]] = True
    first = np.flatnonzero(new & inside)
    stops = np.append(np.flatnonzero(new | ~inside), m)
    last = stops[np.searchsorted(stops, first, side="right")] - 1
    key = least[first] * MIX[0]  # least hashes crowd at zero
    key ^= key >> U(32)
    return first, last, key * MIX[1]


def chunks(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[np.ndarray, list[bytes], list[np.ndarray | None]]]:
    """Documents by the chunk: ids, texts, and the starts of their repeated runs if there is a third column."""
    most = most or CHUNK
    ids: list[int] = []
    texts: list[bytes] = []
    starts: list[np.ndarray | None] = []
    size = 0
    for batch in batches:
        given = batch.column(2) if batch.num_columns > 2 else [None] * batch.num_rows
        for i, t, at in zip(batch.column(0).to_pylist(), batch.column(1), given, strict=True):
            ids.append(i)
            texts.append(t.as_py().encode())
            starts.append(None if at is None else np.array(at.as_py(), np.int64))
            size += len(texts[-1])
            if size >= most:
                yield np.array(ids, np.int64), texts, starts
                ids, texts, starts, size = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts, starts


def chunk_runs(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document's place, first start, last start, anchor) of all runs; a long document is hashed in overlapping slices."""
    out: list[tuple[np.ndarray, ...]] = []
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal parts, size
        if size >= width:
            lengths = np.array([len(p) for *_, p in parts])
            ends = np.cumsum(lengths)
            lo, hi, key = runs(b"".join(p for *_, p in parts), ends - lengths, ends, width, gram)
            part = np.searchsorted(ends, lo, side="right")
            shift = np.array([s for _, s, _ in parts])[part] - (ends - lengths)[part]
            out.append((np.array([d for d, *_ in parts])[part], lo + shift, hi + shift, key))
        parts, size = [], 0

    for d, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), SLICE):
            piece = text[at : at + SLICE + width - 1] if len(text) > SLICE else text
            parts.append((d, at, piece))
            size += len(piece)
            if size >= SLICE:
                flush()
    flush()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _count(width: int, gram: int):
    schema = pa.schema([("kh", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, _ in chunks(batches):
            doc, lo, hi, key = chunk_runs(texts, width, gram)
            distinct, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            kinds = np.ones(len(distinct), np.int64)
            again = np.flatnonzero(n[inverse] > 1)
            if len(again):
                hashes = np.array([xxhash.xxh64_intdigest(texts[d][a:b]) for d, a, b in zip(doc[again].tolist(), lo[again].tolist(), (hi[again] + width).tolist(), strict=True)], U)
                pairs = np.unique(np.stack([inverse[again].astype(U), hashes], 1), axis=0)
                place, many = np.unique(pairs[:, 0].astype(np.int64), return_counts=True)
                kinds[place] = many
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n), pa.array(kinds)], schema=schema)

    return run


def _positions(width: int, gram: int):
    """(kh, doc_id, lo) of every run."""
    schema = pa.schema([("kh", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in chunks(batches):
            doc, lo, _, key = chunk_runs(texts, width, gram)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(lo)], schema=schema)

    return run


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, known to be `at` at least."""
    n = min(len(a), len(b))
    x, y = a[at:n], b[at:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """(prefix length shared with the predecessor, the rests) of sorted strings."""
    shared, rests, before = [], [], b""
    for s in strings:
        h = shared_prefix(before, s, 0)
        shared.append(h)
        rests.append(s[h:])
        before = s
    return np.array(shared, np.int32), b"".join(rests)


class Run:
    """A front-coded run, decoded one string at a time."""

    __slots__ = ("at", "k", "lengths", "n", "rests", "shared", "string")

    def __init__(self, shared: Sequence[int], lengths: Sequence[int], rests: bytes):
        self.shared, self.lengths, self.rests, self.n = shared, lengths, rests, len(shared)
        self.k, self.at, self.string = -1, 0, b""

    def advance(self) -> int:
        """Goes to the next string; what it shares with the one before, -1 at the end."""
        self.k += 1
        if self.k == self.n:
            return -1
        h = self.shared[self.k]
        end = self.at + self.lengths[self.k] - h
        self.string = self.string[:h] + self.rests[self.at : end]
        self.at = end
        return h


def merge(sources: list[Run]) -> Iterator[tuple[int, int]]:
    """(source, prefix shared with the string before) of all strings in order; the source stands at the string."""
    leaves = 1
    while leaves < len(sources):
        leaves *= 2
    # what each source's string shares with the string that beat it, or, for the winner, with the last one put out
    shared = [s.advance() for s in sources] + [-1] * (leaves - len(sources))
    shared = [0 if h >= 0 else -1 for h in shared]
    strings = [s.string for s in sources] + [b""] * (leaves - len(sources))
    losers = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = strings[a], strings[b]
        h = shared_prefix(s, t, x)
        if h == len(s) or (h < len(t) and s[h] < t[h]):
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while shared[winner] >= 0:
        yield winner, shared[winner]
        source = sources[winner]
        shared[winner] = source.advance()
        strings[winner] = source.string
        node = (winner + leaves) // 2
        while node:
            loser = losers[node]
            x, y = shared[winner], shared[loser]
            if x < y:  # the loser shares more with the last string put out, and so is less
                losers[node], winner = winner, loser
            elif x == y and x >= 0:
                s, t = strings[winner], strings[loser]
                h = shared_prefix(s, t, x)
                if h == len(s) or (h < len(t) and s[h] < t[h]):
                    shared[loser] = h
                else:
                    shared[winner] = h
                    losers[node], winner = winner, loser
            node //= 2


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals, by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    first = np.append(True, doc[1:] != doc[:-1])
    base = np.cumsum(first) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    new = first | np.append(True, start[1:] + base[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1] - base[at]


def window_hashes(data: bytes, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    w = _words(np.frombuffer(data + b"\0" * 8, np.uint8))
    offsets = [*range(0, width - 7, 8)] + ([width - 8] if width % 8 else [])
    # a word of all places at a time
    return _mixed(len(places), (w[places + k] for k in offsets), 1), _mixed(len(places), (w[places + k] for k in reversed(offsets)), 2)


def repeated_windows(strings: list[bytes], doc: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the strings of `width` bytes in `strings` that start earlier in another one of them."""
    lengths = np.array([len(s) for s in strings])
    many = lengths - width + 1
    begin = np.cumsum(lengths) - lengths
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    h1, h2 = window_hashes(b"".join(strings), np.repeat(begin, many) + step, width)
    doc, start = np.repeat(doc, many), np.repeat(lo, many) + step
    order = np.argsort(h1)
    same = h1[order][1:] == h1[order][:-1]
    some = order[np.append(same, False) | np.append(False, same)]
    some = some[np.lexsort((start[some], doc[some], h2[some], h1[some]))]
    if not len(some):
        return doc[:0], start[:0]
    h1, h2, doc, start = h1[some], h2[some], doc[some], start[some]
    at = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    head = np.repeat(at, np.diff(np.append(at, len(h1))))
    later = (doc != doc[head]) | (start != start[head])
    return doc[later], start[later]


def bloom_places(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of hashes in a filter of 2^bits bits."""
    return [key << U(min(skip, 64 - bits)) >> U(64 - bits) for skip in SKIPPED]


class Sorted(NamedTuple):
    """A front-coded run of suffixes, each with its document and start."""

    shared: Sequence[int]
    lengths: Sequence[int]
    rests: bytes
    owners: Sequence[int]
    starts: Sequence[int]


def intervals_of(flat: array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of (document, start, end), three numbers after another."""
    return united(*np.frombuffer(flat, np.int64).reshape(-1, 3).T)


def local_merge(held: list[Sorted], bounds: list[bytes], gone: array) -> Iterator[tuple[int, Sorted]]:
    """(range, its part) of the merged runs. Of equal suffixes the earliest stays, the others go to `gone`, three numbers each."""
    sources = [Run(h.shared, h.lengths, h.rests) for h in held]
    shared, lengths, rests, owners, starts = array("i"), array("i"), bytearray(), array("q"), array("q")
    r, before = 0, b""
    for k, h in merge(sources):
        run = sources[k]
        s, owner, start = run.string, held[k].owners[run.k], held[k].starts[run.k]
        if h == len(s) == len(before):
            if (owner, start) < (owners[-1], starts[-1]):
                gone.extend((owners[-1], starts[-1], starts[-1] + len(s) - 8))
                owners[-1], starts[-1] = owner, start
            elif (owner, start) > (owners[-1], starts[-1]):
                gone.extend((owner, start, start + len(s) - 8))
            continue
        if r < len(bounds) and s >= bounds[r]:
            if lengths:
                yield r, Sorted(shared, lengths, bytes(rests), owners, starts)
                shared, lengths, rests, owners, starts = array("i"), array("i"), bytearray(), array("q"), array("q")
            r = bisect_right(bounds, s)
        if not lengths:
            h = 0
        shared.append(h)
        lengths.append(len(s))
        rests += s[h:]
        owners.append(owner)
        starts.append(start)
        before = s
    if lengths:
        yield r, Sorted(shared, lengths, bytes(rests), owners, starts)


def _sorted_runs(width: int, gram: int, ranges: int, bloom, hot: np.ndarray):
    schema = pa.schema([("r", pa.int32()), ("shared", pa.binary()), ("lengths", pa.binary()), ("rests", pa.binary()), ("doc", pa.binary()), ("lo", pa.binary()), ("known", pa.binary())])
    bounds = [(k * (1 << 64) // ranges).to_bytes(8, "big") for k in range(1, ranges)]

    def sorted_chunk(ids: np.ndarray, texts: list[bytes], starts: list[np.ndarray | None]) -> Sorted:
        doc, lo, hi, key = chunk_runs(texts, width, gram)
        if bloom is None:
            base = np.cumsum([0, *(len(t) for t in texts)])
            take = np.isin(base[doc] + lo, np.concatenate([b + s for b, s in zip(base, starts, strict=False)]))
        else:
            bits = np.frombuffer(bloom.value, np.uint8)
            take = np.ones(len(key), bool)
            for place in bloom_places(key, (len(bits) * 8).bit_length() - 1):
                take &= (bits[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8) & 1).astype(bool)
        doc, lo, hi, key = doc[take], lo[take], hi[take], key[take]
        is_hot = np.isin(key, hot)
        if is_hot.any():  # each string of a hot anchor goes by a hash of its own
            own = np.flatnonzero(is_hot)
            parts = [texts[d][a:b] for d, a, b in zip(doc[own].tolist(), lo[own].tolist(), (hi[own] + width).tolist(), strict=True)]
            many = hi[own] - lo[own] + 1
            begin = np.cumsum(many + width - 1) - (many + width - 1)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            h, _ = window_hashes(b"".join(parts), np.repeat(begin, many) + step, width)
            start = np.repeat(lo[own], many) + step
            cold = ~is_hot
            doc, lo, hi, key = (np.concatenate(p) for p in ((doc[cold], np.repeat(doc[own], many)), (lo[cold], start), (hi[cold], start), (key[cold], h * MIX[2])))
        heads = key.astype(">u8").tobytes()
        strings = [heads[8 * k : 8 * k + 8] + texts[d][a:b] for k, (d, a, b) in enumerate(zip(doc.tolist(), lo.tolist(), (hi + width).tolist(), strict=True))]
        order = sorted(range(len(strings)), key=strings.__getitem__)
        strings = [strings[k] for k in order]
        shared, rests = front_code(strings)
        return Sorted(array("i", shared.tobytes()), array("i", map(len, strings)), rests, array("q", ids[doc[order]].tobytes()), array("q", lo[order].astype(np.int64).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def dealt(held: list[Sorted]) -> Iterator[pa.RecordBatch]:
            gone = array("q")
            rows: list[tuple] = []
            size = 0
            for r, part in local_merge(held, bounds, gone):
                rows.append((r, *(squeeze(c) for c in (part.shared, part.lengths, part.rests, part.owners, part.starts)), None))
                size += len(rows[-1][3])
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if gone:  # any range may report them
                known = np.stack(intervals_of(gone)).tobytes()
                rows.append((zlib.crc32(known) % ranges, *[None] * 5, squeeze(known)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        held: list[Sorted] = []
        size = 0
        for ids, texts, starts in chunks(batches, SORTED):
            held.append(sorted_chunk(ids, texts, starts))
            size += len(held[-1].rests) + 24 * len(held[-1].shared)
            if size >= HELD:
                yield from dealt(held)
                held, size = [], 0
        if held:
            yield from dealt(held)

    return run, "r int, shared binary, lengths binary, rests binary, doc binary, lo binary, known binary"


def _merged(width: int):
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        plain = zstandard.ZstdDecompressor().decompress
        sources, docs, los, out = [], [], [], []
        for row in table.select(["shared", "lengths", "rests", "doc", "lo", "known"]).to_pylist():
            if row["known"]:
                out.append(tuple(np.frombuffer(plain(row["known"]), np.int64).reshape(3, -1)))
                continue
            sources.append(Run(*(array("i", plain(row[c])) for c in ("shared", "lengths")), plain(row["rests"])))
            docs.append(array("q", plain(row["doc"])))
            los.append(array("q", plain(row["lo"])))
        gone = array("q")
        group: list[tuple[bytes, int, int]] = []  # (suffix, doc, start) of the earliest of equal ones, of one anchor
        mixed: list[tuple[bytes, int, int]] = []  # those of anchors with different suffixes

        def matched() -> None:
            s, d, a = zip(*mixed, strict=True)
            doc, start = repeated_windows(list(s), np.array(d, np.int64), np.array(a, np.int64), width)
            out.append(united(doc, start, start + width))
            mixed.clear()

        before = b""
        for source, h in merge(sources):
            run = sources[source]
            string = run.string
            doc, lo = docs[source][run.k], los[source][run.k]
            if h == len(string) == len(before):
                _, d, a = group[-1]
                if (doc, lo) < (d, a):
                    gone.extend((d, a, a + len(string) - 8))
                    group[-1] = (string[8:], doc, lo)
                elif (doc, lo) > (d, a):
                    gone.extend((doc, lo, lo + len(string) - 8))
            else:
                if h < 8:
                    if len(group) > 1:
                        mixed += group
                        if len(mixed) >= MATCHED:
                            matched()
                    group = []
                group.append((string[8:], doc, lo))
            before = string
        if len(group) > 1:
            mixed += group
        if mixed:
            matched()
        if gone:
            out.append(intervals_of(gone))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(c) for c in united(*(np.concatenate(c) for c in zip(*out, strict=True)))], schema=schema)

    return run, "doc long, start long, end long"


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with the column `key`: the document of a row, in the order of documents."""
    ids, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    own = F.lit(LATER).bitwiseOR(F.xxhash64(ids, text).bitwiseAND(F.lit(LATER - 1)))
    hashes = docs.filter("doc_id IS NOT NULL").select(ids.alias("id"), F.xxhash64(text).alias("h"))
    several = settled(hashes.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least <> most").select("id", "least"))
    if several.isEmpty():
        return docs.withColumn(key, F.coalesce(ids, own))
    its_id, least = fresh(docs, "its_id", "least")
    joined = docs.join(several.select(F.col("id").alias(its_id), F.col("least").alias(least)), ids == F.col(its_id), "left")
    return joined.withColumn(key, F.when(F.col(least) != F.xxhash64(text), own).otherwise(F.coalesce(ids, own))).drop(its_id, least)


def spans(docs: DataFrame, width: int = 100, gram: int = 32, filter_bits: int = FILTER_BITS, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc, spans) of the documents that lose bytes: spans is an array of (start, end) in bytes, which may overlap. doc is of keyed()."""
    return _spans(keyed(docs.select("doc_id", "text"), "key").select("key", "text"), width, gram, filter_bits, hot_least)


def _spans(rows: DataFrame, width: int = 100, gram: int = 32, filter_bits: int = FILTER_BITS, hot_least: int = HOT_LEAST) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.select(F.col("key").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = rows.mapInArrow(_count(width, gram), "kh long, n long, kinds long").groupBy("kh").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).filter("n > 1")
    counts = settled(counts)
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # At most HOT_SHARE anchors are hot, and the filter is of fixed size: what the driver gathers is bounded.
    most = max(hot_least, total // HOT_SHARE)
    hot = np.array([r.kh for r in counts.filter(F.col("kinds") > most).select("kh").collect()], np.int64).view(U)
    ranges = max(1, -(-total // RANGE_ROWS))
    if BITS_EACH * kinds <= 1 << filter_bits:
        bits = np.zeros(1 << (filter_bits - 3), np.uint8)
        place = F.explode(F.array(*(F.shiftrightunsigned(F.shiftleft("kh", min(skip, 64 - filter_bits)), 64 - filter_bits) + 1 for skip in SKIPPED)))
        for page in counts.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect():
            at = (page.page - 1) * 4096
            bits[at : at + 4096] |= np.frombuffer(page.bits, np.uint8)[: len(bits) - at]
        sorted_runs, schema = _sorted_runs(width, gram, ranges, spark.sparkContext.broadcast(bits.tobytes()), hot)
        marked = rows
    else:
        found = rows.mapInArrow(_positions(width, gram), "kh long, doc_id long, lo long").join(counts.select("kh"), "kh")
        by_doc = found.groupBy("doc_id").agg(F.collect_list("lo").alias("starts"))
        sorted_runs, schema = _sorted_runs(width, gram, ranges, None, hot)
        marked = rows.join(by_doc, "doc_id").select("doc_id", "text", "starts")
    merged, found = _merged(width)
    intervals = marked.mapInArrow(sorted_runs, schema).groupBy("r").applyInArrow(merged, found)
    return intervals.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def kept_bytes(data: bytes, found: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(the bytes that stay, number removed, number of removed stretches)"""
    parts, at, many, removed = [], 0, 0, 0
    for start, end in sorted(found):
        if start > at or not many:
            many += 1
            parts.append(data[at:start])
        elif end <= at:
            continue
        removed += end - max(at, start)
        at = max(at, end)
    parts.append(data[at:])
    return b"".join(parts), removed, many


def _with_spans(docs: DataFrame, how: dict[str, int]) -> tuple[DataFrame, str]:
    """docs with a column of their spans, and its name."""
    key, doc, found = fresh(docs, "key", "doc", "spans")
    rows = keyed(docs, key)
    lost = _spans(rows.select(F.col(key).alias("key"), "text"), **how)
    return rows.join(lost.select(F.col("doc").alias(doc), F.col("spans").alias(found)), F.col(key) == F.col(doc), "left"), found


def digests(docs: DataFrame, **how: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, found in zip(*batch.columns, strict=True):
                data = (text.as_py() or "").encode()
                kept, removed, many = kept_bytes(data, [(s["start"], s["end"]) for s in found.as_py() or []])
                rows.append((i.as_py(), len(data), removed, many, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined, found = _with_spans(rows, how)
    return joined.select("doc_id", "text", found).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, **how: int) -> DataFrame:
    """docs without the repeated bytes; a character that a cut splits goes as a whole. Null texts stay null."""

    @F.pandas_udf("string")
    def rest(text, found):
        out = []
        for t, f in zip(text, found, strict=True):
            out.append(t if t is None or f is None else kept_bytes(t.encode(), [(s["start"], s["end"]) for s in f])[0].decode("utf-8", "ignore"))
        return type(text)(out, dtype=object)

    joined, found = _with_spans(docs, how)
    return joined.withColumn("text", rest("text", found)).select(*docs.columns)
