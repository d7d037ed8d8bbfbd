"""Best-fit packing of tokenised documents into sequences of bounded length.

Every document becomes its token ids followed by one end id. Those longer than a sequence are cut into
full pieces, of which only the first may be shorter. Each partition packs its pieces best-fit, longest first;
bins that are nearly full are final. Underfull bins become items of the next round, where the groups of
eight partitions are merged and packed best-fit again, until one group is left or the groups reach the
size that a task may hold. Bins keep their inner order, so an item's place is the sum of its offsets.

Defined results: a null text is an empty one (a single piece of one end id); equal rows are packed each on
its own; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirespark.llm.common import settled

SPECIAL = "<|endoftext|>"
#: Pieces that a task packs at once, and underfull bins that a merging task may hold.
LOCAL_ITEMS, MERGE_ITEMS, FAN_IN = 200_000, 1_000_000, 8
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int32())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill int"


class ByteBpe:
    """Token ids of the byte-level BPE vocabulary.

    The ranks give the ids of the tokenizer file several times faster; a text that spells the special token
    goes to the tokenizer itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(_tokenizer(self.json_path).encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(2)
def byte_bpe(json_path: str, ranks_path: str) -> ByteBpe:
    import public_tokenizers

    return ByteBpe(json_path, ranks_path, public_tokenizers.PATTERN)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, but for the first."""
    if length <= capacity:
        return [(0, length)]
    first = length - (length - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: longest first, into the fullest bin that it fits.

    Open bins are listed by their free space, and an integer's bits say which lists aren't empty.
    """
    where, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_bits >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_bits ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        if room > size:
            if not free[room - size]:
                open_bits |= 1 << (room - size)
            free[room - size].append(b)
    return where, offset, np.array(fill, np.int64)


def _pack_local(json_path: str, ranks_path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, made = byte_bpe(json_path, ranks_path), TaskContext.get().partitionId() << 34
        end = np.array([end_id], "<u4")
        rows: list[tuple] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            where, offset, fill = best_fit(np.array([r[3] for r in rows]), capacity)
            cols = [list(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, PIECES.field(k).type) for k, c in enumerate(cols)), pa.array(where + made), pa.array(offset), pa.array(fill[where].astype(np.int32))], schema=PIECES)
            made += len(fill)
            rows.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([bpe.ids(text.as_py() or ""), end])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            if len(rows) >= LOCAL_ITEMS:
                yield from packed()
        if rows:
            yield from packed()

    return run


def _merge(capacity: int):
    schema = pa.schema([("bin", pa.int64()), ("parent", pa.int64()), ("shift", pa.int64()), ("fill", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            items = pa.Table.from_batches(kept).sort_by("bin")
            kept.clear()
            bins, sizes = items.column("bin").to_numpy(), items.column("fill").to_numpy()
            where, offset, fill = best_fit(sizes, capacity)
            head = np.full(len(fill), np.iinfo(np.int64).max)
            np.minimum.at(head, where, bins)  # a merged bin goes by the least of its items
            return pa.RecordBatch.from_arrays([pa.array(bins), pa.array(head[where]), pa.array(offset), pa.array(fill[where].astype(np.int32))], schema=schema)

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= MERGE_ITEMS:
                yield packed()
        if kept:
            yield packed()

    return run, "bin long, parent long, shift long, fill int"


def best_fit_pack(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = 2048, end_id: int = 0, slack: int = 16) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece. A bin with at most `slack` free tokens is final."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = settled(rows.mapInArrow(_pack_local(json_path, ranks_path, capacity, end_id), PIECES_SQL))
    underfull = F.col("fill") < capacity - slack
    bins = pieces.filter(underfull).groupBy("bin").agg(F.first("fill").alias("fill"))
    merge, schema = _merge(capacity)
    groups, moved = max(1, rows.rdd.getNumPartitions()), None
    while True:
        # All rounds look at what is left; the last one, of one group or of groups as large as a task may hold, ends it.
        waiting = bins.count()
        fewest = -(-waiting // MERGE_ITEMS)
        groups = max(1, fewest, -(-groups // FAN_IN))
        step = settled(bins.repartition(groups, F.xxhash64("bin")).mapInArrow(merge, schema))
        moved = step if moved is None else settled(
            moved.alias("m").join(step.alias("s"), F.col("m.parent") == F.col("s.bin"), "left").select(
                "m.bin",
                F.coalesce("s.parent", "m.parent").alias("parent"),
                (F.col("m.shift") + F.coalesce("s.shift", F.lit(0))).alias("shift"),
                F.coalesce("s.fill", "m.fill").alias("fill"),
            )
        )
        if groups <= max(1, fewest):
            break
        bins = step.filter(underfull).groupBy(F.col("parent").alias("bin")).agg(F.first("fill").alias("fill"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = pieces.filter(~underfull).select(*columns, F.col("bin").alias("sequence_id"), "offset")
    rest = pieces.filter(underfull).join(moved.select("bin", "parent", "shift"), "bin").select(*columns, F.col("parent").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return done.unionByName(rest)
