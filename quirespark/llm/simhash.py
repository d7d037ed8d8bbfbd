"""SimHash near-duplicates through a Gray-order hierarchical index.

A text is lower-cased (A-Z), split at ASCII white space, and its 3-word shingles, repeats included, are hashed
with XXH64 (seed 42). A fingerprint bit is 1 if it is set in over half of the hashes. Fingerprints are linked at
two or fewer differing bits; a component is what links reach.

Search: three blocks cut the 64 bits, and fingerprints within two bits share at least one block, so distinct
fingerprints are dealt by (block, value). A value that too many fingerprints share is dealt again by blocks of the
other bits, twice at most, after which no more than 2^20 fingerprints can meet. In a task each bucket is sorted by
Gray rank; runs of neighbours form nodes that hold the bits which all of them share, runs of nodes form upper
nodes, and pairs of nodes are dropped as a whole once the shared bits differ in more than two places. A bucket
yields a forest, at most one link per fingerprint, and minimum-label stars join the forests across buckets.

keep_one() has the wider rule of corpora, five-word shingles of a similarity of 0.8: two bits of 64 don't tell that, so
its fingerprints have 256 bits, groups share masked bit patterns (bands), and an exact check of the texts follows. Each text is
first checked with one other of a group; of the pairs of a group that the links so found don't join, those are checked after which
the parities of their shingles (sketches) don't prove to be unlike.

Defined results: null and empty texts have fingerprint zero and are linked like any other; equal rows share a
component; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import fresh, settled

U = np.uint64
LANES = U(0x0101010101010101)
#: Hashes that are counted at once, fingerprints of a (block, value) that aren't dealt again, children of a node.
COUNTED, BUCKET, FANOUT, FRONTIER = 1 << 18, 4096, 8, 1 << 18
#: Places of a sketch at most, and pairs that are gathered for a look at their sketches.
SKETCH, GATHERED = 1 << 14, 1 << 16
#: A fingerprint of more than one in so many rows is hot.
HOT_SHARE = 1000
#: Hot buckets that are broadcast at most; beyond, they are joined.
HOT_BROADCAST = 200_000
#: (first bit, number of bits) of the blocks: of the word, of what the first leaves, of what the second leaves.
CUTS = ((0, 21), (21, 21), (42, 22))


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    digest = xxhash.xxh64_intdigest
    return [digest(x, seed) for x in map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fingerprints of runs of hashes that begin at `starts`; empty runs give zero.

    Bits are counted eight to a word, in blocks of 255 so that no lane overflows.
    """
    ends = np.append(starts[1:], len(hashes))
    sizes = ends - starts
    out = np.zeros(len(starts), U)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    blocks = -(-sizes[full] // 255)
    owner_at = np.cumsum(blocks) - blocks
    step = np.arange(blocks.sum()) - np.repeat(owner_at, blocks)
    at = np.repeat(starts[full], blocks) + 255 * step
    for bit in range(8):
        sums = np.add.reduceat((hashes >> U(bit)) & LANES, at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), owner_at, axis=0)
        for lane in range(8):
            out[full] |= (2 * counts[:, lane] > sizes[full]).astype(U) << U(8 * lane + bit)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    for batch in batches:
        ids, hashes, starts, found, total = batch.column(0), [], [], [], 0
        for text in batch.column(1):
            h = shingle_hashes(text.as_py())
            starts.append(total)
            hashes.append(np.array(h, U))
            total += len(h)
            if total >= COUNTED:
                found.append(majority(np.concatenate(hashes), np.array(starts)))
                hashes, starts, total = [], [], 0
        if starts:
            found.append(majority(np.concatenate(hashes), np.array(starts)))
        if found:
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found).view(np.int64))], schema=schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(shift)
    return rank


def _reach(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives both ends of each link the lesser label, and whatever had the greater one."""
    while True:
        la, lb = labels[a], labels[b]
        if not (open_ := la != lb).any():
            return
        np.minimum.at(labels, np.maximum(la, lb)[open_], np.minimum(la, lb)[open_])
        while (up := labels[labels] != labels).any():
            labels[up] = labels[labels[up]]


def forest(groups: np.ndarray, codes: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, its component's first one) for all that are linked within the runs of equal `groups`.

    `groups` is sorted; codes are distinct within a group.
    """
    order = np.lexsort((gray_rank(codes), groups))
    groups, codes = groups[order], codes[order]
    n = len(codes)
    labels = np.arange(n)
    # levels[k]: value and mask of the bits that all below share, first child and one past the last child
    levels = [(codes, np.full(n, ~U(0)), np.arange(n), np.arange(n) + 1)]
    owner = groups
    while True:
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(first, len(owner)))
        if sizes.max(initial=1) == 1:
            break
        pos = np.arange(len(owner)) - np.repeat(first, sizes)
        at = np.flatnonzero(pos % FANOUT == 0)
        value, mask = levels[-1][0], levels[-1][1]
        same = np.bitwise_and.reduceat(mask, at) & ~(np.bitwise_or.reduceat(value, at) & ~np.bitwise_and.reduceat(value, at))
        levels.append((np.bitwise_and.reduceat(value, at) & same, same, at, np.append(at[1:], len(owner))))
        owner = owner[at]
    roots = np.arange(len(owner))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        if level == 0:
            pair = a < b
            _reach(labels, a[pair], b[pair])
            continue
        _, _, lo, hi = levels[level]
        wide_a, wide_b = hi[a] - lo[a], hi[b] - lo[b]
        many = wide_a * wide_b
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        width = np.repeat(wide_b, many)
        left, right = np.repeat(lo[a], many) + k // width, np.repeat(lo[b], many) + k % width
        value, mask = levels[level - 1][0], levels[level - 1][1]
        near = np.bitwise_count((value[left] ^ value[right]) & mask[left] & mask[right]) <= most
        near &= left <= right  # of a node with itself, each pair of children once
        if near.any():
            stack.append((level - 1, left[near], right[near]))
    moved = np.flatnonzero(labels != np.arange(n))
    return codes[moved], codes[labels[moved]]


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (k1, k2); whole buckets are gathered until there is enough to work on."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    kept: list[np.ndarray] = []
    size = 0

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))
        u, v = forest(np.cumsum(new), rows[:, 2].astype(np.int64).view(U))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    for batch in batches:
        kept.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
        size += batch.num_rows
        if size >= FRONTIER:
            rows = np.concatenate(kept)
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            if len(last):
                yield linked(rows[: last[-1] + 1])
                rows = rows[last[-1] + 1 :]
            kept, size = [rows], len(rows)
    if size:
        yield linked(np.concatenate(kept))


def _bits(column: str, first: int, count: int):
    return F.shiftrightunsigned(F.col(column), first).bitwiseAND(F.lit((1 << count) - 1))


def _again(column: str, free: list[tuple[int, int]]):
    """Array of the keys that deal a hot bucket again: its free bits are cut in three, and what one part leaves in three again."""
    keys = []
    positions = [p for first, count in free for p in range(first, first + count)]

    def gathered(bits: list[int]):
        # neighbouring positions move together
        out, at, runs = F.lit(0).cast("long"), 0, []
        for p in bits:
            if runs and runs[-1][0] + runs[-1][1] == p:
                runs[-1][1] += 1
            else:
                runs.append([p, 1])
        for first, count in runs:
            out = out.bitwiseOR(F.shiftleft(_bits(column, first, count), at))
            at += count
        return out

    def thirds(bits: list[int]) -> list[list[int]]:
        third = -(-len(bits) // 3)
        return [bits[:third], bits[third : 2 * third], bits[2 * third :]]

    for i, part in enumerate(thirds(positions)):
        rest = [p for p in positions if p not in set(part)]
        for j, sub in enumerate(thirds(rest)):
            code = F.lit(i * 3 + j + 1).cast("long")
            keys.append(F.shiftleft(code, 56).bitwiseOR(F.shiftleft(gathered(part), 16)).bitwiseOR(gathered(sub)))
    return F.array(*keys)


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v) of distinct fingerprints `fp`: forests that connect all that differ in at most two bits."""
    keys = F.array(*(F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(_bits("fp", *CUTS[k])) for k in range(3)))
    dealt = distinct.select("fp", F.explode(keys).alias("k1"))
    hot = dealt.groupBy("k1").count().filter(F.col("count") > bucket).select("k1", F.lit(True).alias("hot"))
    block = F.shiftright("k1", 32)
    free = [[c for c in CUTS if c != CUTS[k]] for k in range(3)]
    again = F.when(block == 0, _again("fp", free[0])).when(block == 1, _again("fp", free[1])).otherwise(_again("fp", free[2]))
    routed = dealt.join(hot, "k1", "left").select("k1", F.explode(F.when(F.col("hot"), again).otherwise(F.array(F.lit(0).cast("long")))).alias("k2"), "fp")
    return routed.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_forest_batches, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (u, v): the least node that it reaches.

    Large and small stars alternate until no link changes; every round is kept in the shared folder.
    """
    edges = settled(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = settled(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
        state = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies) of every row; component_id is the least doc_id of those linked."""
    found = settled(fingerprints(docs))
    distinct = settled(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")))
    linked = components(links(distinct.select("fp")))
    tops = linked.select("node", "label").unionByName(linked.select(F.col("label").alias("node"), "label").distinct())
    named = tops.join(distinct, tops["node"] == distinct["fp"]).select("fp", "label", "least")
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(least, "label").select("fp", "component")
    classes = settled(distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "n_copies"))
    # fingerprints of over a thousandth of all rows, which are less than a thousand, meet their rows without a shuffle
    hot = F.broadcast(classes.filter(F.col("n_copies") * HOT_SHARE > found.count()))
    rest = found.join(hot.select("fp"), "fp", "left_anti").join(classes, "fp")
    return found.join(hot, "fp").unionByName(rest).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")


@dataclass(frozen=True)
class Near:
    """Which texts are near copies, and how widely fingerprints are searched for them.

    A similarity of 0.8 leaves 15 % of a fingerprint's bits different: `most` is four deviations more. At 0.8 a pair
    shares one of the bands 96 times in 100, at 0.85 99 times, at 0.9 but for one in 2,500.
    """

    width: int = 5
    percent: int = 80
    #: 64-bit words of a fingerprint; bands, and bits of each.
    words: int = 4
    bands: int = 32
    band_bits: int = 14
    #: Differing bits of a candidate at most; of a text that is no leader itself.
    most: int = 62
    near: int = 16


#: Odd factors that mix a hash, and the weights of its other words.
MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; a text without words has a zero."""
    return np.unique(np.array(shingle_hashes(text, width) or [0], U))


def wide_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A row of `words` 64-bit words for each set; each word is the majority of the hashes, mixed anew."""
    hashes = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), words), U)
    for k in range(words):
        h = hashes + MIX[2] * U(k + 1)
        for shift, factor in ((U(30), MIX[0]), (U(27), MIX[1])):
            h ^= h >> shift
            h *= factor
        out[:, k] = majority(h ^ h >> U(31), starts)
    return out


def sketch(shingles: np.ndarray) -> bytes:
    """The parities of a set's hashes by their last bits: two places or more for each hash, 2^14 at most.

    Each place in which two sketches differ holds a hash that one set has alone, so they differ in no more places than the sets in hashes.
    """
    places = min(SKETCH, max(64, 1 << (2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & U(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def maybe_alike(pairs: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """Of the pairs (two columns of rows) those that sizes and sketches don't prove to be less similar than `percent`."""
    total = sizes[pairs].sum(axis=1)
    common = -(-percent * total // (100 + percent))
    pairs, most = (x[sizes[pairs].min(axis=1) >= common] for x in (pairs, total - 2 * common))
    # the longer sketch is folded to the shorter one's places
    width = np.array([len(x) for x in sketches])[pairs].min(axis=1)
    keep = np.zeros(len(pairs), bool)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        used, where = np.unique(pairs[at].ravel(), return_inverse=True)
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[k], U).reshape(-1, w // 8), axis=0) for k in used])
        for some, two in zip(*(np.array_split(x, -(-len(at) * w // (8 * COUNTED))) for x in (at, where.reshape(-1, 2))), strict=True):
            keep[some] = np.bitwise_count(rows[two[:, 0]] ^ rows[two[:, 1]]).sum(axis=1, dtype=np.int64) <= most[some]
    return pairs[keep]


def band_values(codes: np.ndarray, how: Near) -> np.ndarray:
    """The values of the bands: fixed choices of bits."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    draw = np.random.default_rng(42)
    places = np.concatenate([draw.permutation(64 * how.words) for _ in range(-(-how.bands * how.band_bits // (64 * how.words)))])
    chosen = places[: how.bands * how.band_bits].reshape(how.bands, how.band_bits)
    return (bits[:, chosen].astype(np.int32) << np.arange(how.band_bits, dtype=np.int32)).sum(axis=2, dtype=np.int32)


def nearest_leaders(groups: np.ndarray, codes: np.ndarray, how: Near, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, its leader) and the leaders: in each run of equal groups a row's nearest leader before it, if near enough.

    The first row of a run leads; whatever differs from a leader in more than how.near bits leads in its turn. `met`, if given, gets
    True for every row that how.most bits or fewer tell from any other of its run: its leader, or it itself, is within how.near more of it.
    """
    best, leader = np.full(len(groups), how.most + 1), np.full(len(groups), -1)
    live, leaders = np.arange(len(groups)), []
    while len(live):
        head = np.append(True, groups[live][1:] != groups[live][:-1])
        leaders.append(live[head])
        first = live[head][np.cumsum(head) - 1][~head]
        live = live[~head]
        differ = np.bitwise_count(codes[live] ^ codes[first]).sum(axis=1, dtype=np.int64)
        closer = differ < best[live]
        best[live[closer]], leader[live[closer]] = differ[closer], first[closer]
        if met is not None:
            close = differ <= how.most + how.near
            met[live[close]] = met[first[close]] = True
        live = live[differ > how.near]
    found = np.flatnonzero(leader >= 0)
    return found, leader[found], np.sort(np.concatenate(leaders))


def _leader_batches(how: Near):
    """Links of (k1, k2, content, code) rows that come sorted by (k1, k2), and (u, u) of what met others without a link.

    A bucket that goes on keeps its leaders alone, and these go on leading.
    """
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, codes, held = np.zeros((0, 2), np.int64), np.zeros(0, "V16"), np.zeros((0, how.words), U), 0

        def linked(last: bool) -> pa.RecordBatch:
            nonlocal keys, names, codes, held
            new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
            group = np.cumsum(new)
            order = np.lexsort((gray_rank(codes[:, 0]), np.arange(len(group)) >= held, group))
            keys, names, codes, group = keys[order], names[order], codes[order], group[order]
            met = np.zeros(len(group), bool)
            row, to, leaders = nearest_leaders(group, codes, how, met)
            met[row] = met[to] = False
            out = [pa.array(names[np.concatenate([k, np.flatnonzero(met)])].tolist(), pa.binary()) for k in (row, to)]
            stay = leaders[group[leaders] == group[-1]] if not last else leaders[:0]
            keys, names, codes, held = keys[stay], names[stay], codes[stay], len(stay)
            return pa.RecordBatch.from_arrays(out, schema=schema)

        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([keys, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)])
                names = np.concatenate([names, np.frombuffer(b"".join(batch.column(2).to_pylist()), "V16")])
                codes = np.concatenate([codes, np.frombuffer(b"".join(batch.column(3).to_pylist()), U).reshape(-1, how.words)])
            if len(keys) >= FRONTIER:
                yield linked(False)
        if len(keys):
            yield linked(True)

    return run, "u binary, v binary"


def _pair_batches(how: Near):
    """Of (k1, k2, content, code, label) rows that come sorted by (k1, k2): all pairs of a bucket that are near enough and have two labels.

    Rows that have (size, sketch) besides leave out the pairs that these prove to be unlike.
    """
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def paired(keys: np.ndarray, names: np.ndarray, codes: np.ndarray, labels: np.ndarray, *sketched: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
        first, step, found, gathered = np.flatnonzero(new)[np.cumsum(new) - 1], 1, [], 0
        live = np.arange(len(keys))
        while len(live) or found:
            live = live[live - step >= first[live]]
            apart = live[(labels[live] != labels[live - step]).any(axis=1)]
            near = apart[np.bitwise_count(codes[apart] ^ codes[apart - step]).sum(axis=1, dtype=np.int64) <= how.most]
            found += [np.stack([near, near - step], 1)] if len(near) else []
            gathered += len(near)
            step += 1
            if found and (gathered >= GATHERED or not len(live)):
                pairs = maybe_alike(np.concatenate(found), *sketched, how.percent) if sketched else np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(names[pairs[:, k]].tolist(), pa.binary()) for k in (0, 1)], schema=schema)
                found, gathered = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                joined = [b"".join(batch.column(k).to_pylist()) for k in (2, 3, 4)]
                rows = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1), np.frombuffer(joined[0], "V16"), np.frombuffer(joined[1], U).reshape(-1, how.words), np.frombuffer(joined[2], U).reshape(-1, 2)]
                rows += [batch.column(5).to_numpy().astype(np.int64), batch.column(6).to_numpy(zero_copy_only=False)] if batch.num_columns > 5 else []
                held = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
            if held and len(held[0]) >= FRONTIER >> 3:
                before = np.flatnonzero((held[0] != held[0][-1]).any(axis=1))
                if len(before):
                    yield from paired(*(x[: before[-1] + 1] for x in held))
                    held = [x[before[-1] + 1 :] for x in held]
        if held:
            yield from paired(*held)

    return run, "u binary, v binary"


def _dealt(contents: DataFrame, bucket: int) -> DataFrame:
    """(k1, k2, the other columns) of contents (content, code, bands, ...), once for each band.

    A bucket of more than `bucket` texts is cut in slices of about so many, and each two of them meet in a cell (k2) of their own: it
    spreads over many tasks, and any two of its texts still meet.
    """
    rest = [c for c in contents.columns if c != "bands"]
    keyed = contents.select(*rest, F.posexplode("bands").alias("band", "value"))
    hot = settled(keyed.groupBy("band", "value").count().filter(F.col("count") > bucket).select("band", "value", F.ceil(F.col("count") / bucket).alias("slices")))
    side = F.broadcast(hot) if hot.count() <= HOT_BROADCAST else hot
    k1 = F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("value").cast("long")).alias("k1")
    once = keyed.join(side, ["band", "value"], "left_anti").select(k1, F.lit(0).cast("long").alias("k2"), *rest)
    cut = keyed.join(side, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("content"), "slices"))
    cells = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("other"))
    again = cells.select(k1, (F.least("own", "other") * F.col("slices") + F.greatest("own", "other") + 1).alias("k2"), *rest)
    return once.unionByName(again).repartition("k1", "k2").sortWithinPartitions("k1", "k2")


def near_links(contents: DataFrame, how: Near = Near(), bucket: int = BUCKET) -> DataFrame:
    """(u, v): candidates among contents (content, code, bands), one a text at most in each bucket of its bands.

    Whatever could be near any other text of a bucket is there, if without a link as (u, u): rest_links() looks at these again.
    """
    run, schema = _leader_batches(how)
    return _dealt(contents, bucket).mapInArrow(run, schema).distinct()


def rest_links(contents: DataFrame, how: Near = Near(), bucket: int | None = None) -> DataFrame:
    """(u, v): the candidates among contents (content, code, bands, label, size, sketch) of which the labels differ.

    Pairs that sizes or sketches prove to be unlike aren't made: their number grows with the square of a group.
    """
    run, schema = _pair_batches(how)
    pairs = _dealt(contents, BUCKET if bucket is None else bucket).select("k1", "k2", "content", "code", "label", "size", "sketch").mapInArrow(run, schema)
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets in order is `percent` at least."""
    if 100 * min(len(one), len(other)) < percent * max(len(one), len(other)):
        return False
    common = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def _alike_batches(how: Near):
    """Of (u, v, text of u, text of v) the links of similar texts; a leader's rows stand together."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, np.zeros(0, U)
        for batch in batches:
            keep = []
            for v, one, other in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                if v != name:
                    name, held = v, shingle_set(other.as_py(), how.width)
                keep.append(alike(shingle_set(one.as_py(), how.width), held, how.percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], schema=schema)

    return run, "u binary, v binary"


def _wide_batches(how: Near):
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("code", pa.binary()), ("bands", pa.list_(pa.int32())), ("size", pa.int32()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, found, total, sizes, sketches = [], [], 0, [], []
            for text in batch.column(2):
                sets.append(shingle_set(text.as_py(), how.width))
                sizes.append(len(sets[-1]))
                sketches.append(sketch(sets[-1]))
                total += sizes[-1]
                if total >= COUNTED:
                    found.append(wide_fingerprints(sets, how.words))
                    sets, total = [], 0
            if sets:
                found.append(wide_fingerprints(sets, how.words))
            if found:
                codes = np.concatenate(found)
                lists = pa.ListArray.from_arrays(np.arange(0, how.bands * len(codes) + 1, how.bands, dtype=np.int32), band_values(codes, how).ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), lists, pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], schema=schema)

    return run, "doc_id long, content binary, code binary, bands array<int>, size int, sketch binary"


def keep_one(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """Of the rows that near copies join the one of least doc_id, with all its columns (nulls last, then the least content).

    Near copies share `how.percent` of their distinct `how.width`-word shingles at least. Wide fingerprints propose them:
    in each bucket a text is linked with the nearest one before it, then with all that are near enough and not joined to it yet, but for
    those that their sketches prove to be unlike, and the links whose texts aren't similar are dropped.
    Null, empty and blank texts are copies of each other; of equal rows one stays.
    """
    content, first, first_id = fresh(docs, "content", "first", "first_id")
    named = docs.withColumn(content, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(content).alias("content"), "text")
    contents = settled(rows.mapInArrow(*_wide_batches(how)).groupBy("content").agg(F.min("doc_id").alias("least"), F.first("code").alias("code"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.count("*").alias("n")))

    links = settled(near_links(contents.select("content", "code", "bands"), how))
    met = links.select(F.explode(F.array("u", "v")).alias("content")).distinct()
    wanted = contents.join(met, "content").select(F.col("least").alias("its_id"), F.col("content").alias("wanted"))
    texts = settled(rows.join(wanted, (F.col("content") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left_semi").select("content", "text").dropDuplicates(["content"]))

    def similar(links: DataFrame) -> DataFrame:
        pairs = links.join(texts.select(F.col("content").alias("u"), F.col("text").alias("one")), "u").join(texts.select(F.col("content").alias("v"), F.col("text").alias("other")), "v")
        return pairs.select("u", "v", "one", "other").mapInArrow(*_alike_batches(how))

    edges = settled(similar(links.filter("u <> v")))
    labels = components(edges)
    # each text was tried with one other of a bucket; what these links don't join already is tried with all that could be alike
    again = contents.join(met, "content").join(labels, F.col("content") == F.col("node"), "left").select("content", "code", "bands", F.coalesce("label", "content").alias("label"), "size", "sketch")
    rest = settled(rest_links(again, how))
    if rest.count():
        labels = components(edges.unionByName(similar(rest)))
    labelled = contents.join(labels, F.col("content") == F.col("node"), "left").select(F.coalesce("label", "content").alias("label"), F.struct(F.col("least").isNull(), F.col("least").alias("id"), F.col("content").alias("content")).alias("row"), "n")
    firsts = settled(labelled.groupBy("label").agg(F.min_by(F.struct("row.id", "row.content", "n"), "row").alias("row")).select(F.col("row.id").alias(first_id), F.col("row.content").alias(first), F.col("row.n").alias("n")))
    same = (F.col(content) == F.col(first)) & F.col("doc_id").cast("long").eqNullSafe(F.col(first_id))
    alone = named.join(firsts.filter("n = 1"), same, "left_semi")
    copies = named.join(firsts.filter("n > 1"), same, "left_semi").dropDuplicates(["doc_id", content])
    return alone.unionByName(copies).drop(content)
