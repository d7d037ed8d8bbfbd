"""Page-local algorithms whose result depends on the order of the elements: plain functions, run by Arrow maps over pages.

A page is small; a kernel sees one page at a time, and a batch holds many pages.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa

Box = tuple[float, float, float, float]


def ratio(a: Box, b: Box) -> float:
    """Intersection over the smaller area."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    smaller = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return wide * high / smaller if wide > 0 and high > 0 and smaller > 0 else 0.0


def gap(a: Box, b: Box) -> float:
    return math.hypot(max(a[0] - b[2], b[0] - a[2], 0.0), max(a[1] - b[3], b[1] - a[3], 0.0))


def union(boxes: list[Box]) -> Box:
    x1, y1, x2, y2 = zip(*boxes, strict=True)
    return min(x1), min(y1), max(x2), max(y2)


def merge_texts(texts: list[tuple[Box, str]], tables: list[Box], distance: float = 5.0) -> list[tuple[Box, str, int]]:
    """Sweeps until no two texts are nearer than `distance`; a text grows with what it takes up, and texts near a table stay apart."""
    now = [(b, c, 1) for b, c in texts]
    by_table: dict[Box, bool] = {}

    def guarded(b: Box) -> bool:
        if b not in by_table:
            by_table[b] = any(gap(b, t) < distance for t in tables)
        return by_table[b]

    changed = len(now) > 1
    while changed:
        changed, rest, out = False, now, []
        while rest:
            (grown, content, n), *others = rest
            rest = []
            for other in others:
                if gap(grown, other[0]) < distance and not guarded(grown) and not guarded(other[0]):
                    grown, content, n, changed = union([grown, other[0]]), f"{content} {other[1]}".strip(), n + other[2], True
                else:
                    rest.append(other)
            out.append((grown, content, n))
        now = out
    return now


def dense_groups(boxes: list[Box], side: float = 30.0) -> list[list[int]]:
    """Groups of elements around each element's center.

    A window's elements join the first listed window with which they share over half of themselves; windows that share an element
    are then united in one pass, so groups need not be closed under overlap.
    """
    half, listed = side / 2, []
    centers = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for b in boxes]
    for i, (cx, cy) in enumerate(centers):
        window = (cx - half, cy - half, cx + half, cy + half)
        met = {j for j, (x, y) in enumerate(centers) if j != i and ((window[0] <= x <= window[2] and window[1] <= y <= window[3]) or ratio(window, boxes[j]) > 0.1)}
        if not met:
            continue
        met.add(i)
        home = next((g for g in listed if 2 * len(met & g) > len(met)), None)
        if home is None:
            listed.append(met)
        else:
            home |= met
    groups: list[set[int]] = []
    for met in listed:
        home = next((g for g in groups if g & met), None)
        if home is None:
            groups.append(set(met))
        else:
            home |= met
    return [sorted(g) for g in groups if len(g) > 1]


def vector_graphics(elements: list[dict], side: float = 30.0, rounds: int = 10) -> list[dict]:
    """Merges groups that hold a line and an image until there is none, for so many rounds at most. Elements: type, box, idx."""
    for _ in range(rounds):
        valid = [g for g in dense_groups([e["box"] for e in elements], side) if {"original_line", "image"} <= {elements[i]["type"] for i in g}]
        if not valid:
            break
        made = []
        for k, group in enumerate(valid):
            own = [elements[i] for i in group]
            made.append({"type": "vector_graphic", "box": union([e["box"] for e in own]), "idx": k, "types": dict(Counter(e["type"] for e in own)), "details": [(e["type"], *e["box"], e["idx"]) for e in own], "count": len(own)})
        used = {i for g in valid for i in g}
        elements = made + [e for i, e in enumerate(elements) if i not in used]
    return elements


def suppressed(boxes: list[Box], threshold: float = 0.8) -> list[Box]:
    """Non-maximum suppression: largest area first (then as listed), dropping what overlaps a kept one."""
    kept: list[Box] = []
    for b in sorted(boxes, key=lambda b: (b[0] - b[2]) * (b[3] - b[1])):
        if all(ratio(k, b) <= threshold for k in kept):
            kept.append(b)
    return kept


BOX = ("x1", "y1", "x2", "y2")
Batches = Iterator[pa.RecordBatch]


def page_by_page(key: str, page_rows: Callable[[list[dict]], list[dict]], names: list[str]) -> Callable[[Batches], Batches]:
    """A map over batches that come sorted by page: page_rows() gets the rows of one page at a time, its result one batch per input batch.

    Pages may go on in the next batch; only the last one is held back.
    """

    def run(batches: Batches) -> Batches:
        held: list[dict] = []
        for batch in batches:
            rows = held + batch.to_pylist()
            done = len(rows)
            while done and rows[done - 1][key] == rows[-1][key]:
                done -= 1
            held = rows[done:]
            if done:
                yield made(rows[:done])
        if held:
            yield made(held)

    def made(rows: list[dict]) -> pa.RecordBatch:
        out = [r for _, own in groupby(rows, itemgetter(key)) for r in page_rows(list(own))]
        return pa.RecordBatch.from_pylist(out, schema=run.schema)

    run.schema = pa.schema([(n, KINDS[n]) if n in KINDS else (n, pa.int64()) for n in names])
    return run


_DETAIL = pa.struct([("type", pa.string()), *((c, pa.float64()) for c in BOX), ("idx", pa.int64())])
KINDS = {"ord": pa.int32(), **dict.fromkeys(BOX, pa.float64()), "content": pa.string(), "n_merged": pa.int32(), "type": pa.string(), "component_types": pa.map_(pa.string(), pa.int32()), "component_details": pa.list_(_DETAIL), "component_count": pa.int32()}


def _box(row: dict) -> Box:
    return row["x1"], row["y1"], row["x2"], row["y2"]


def merge_texts_of_page(page: str, distance: float) -> Callable[[list[dict]], list[dict]]:
    def of_page(rows: list[dict]) -> list[dict]:
        merged = merge_texts([(_box(r), r["content"] or "") for r in rows if r["is_text"]], [_box(r) for r in rows if not r["is_text"]], distance)
        return [{page: rows[0][page], "ord": k, **dict(zip(BOX, b, strict=True)), "content": c, "n_merged": n} for k, (b, c, n) in enumerate(merged)]

    return of_page


def vector_graphics_of_page(page: str, side: float, rounds: int) -> Callable[[list[dict]], list[dict]]:
    names = ("type", *BOX, "idx")

    def of_page(rows: list[dict]) -> list[dict]:
        out = []
        for k, e in enumerate(vector_graphics([{"type": r["type"], "box": _box(r), "idx": r["idx"]} for r in rows], side, rounds)):
            row = {page: rows[0][page], "ord": k, "type": e["type"], **dict(zip(BOX, e["box"], strict=True))}
            if "types" in e:
                row |= {"component_types": list(e["types"].items()), "component_details": [dict(zip(names, d, strict=True)) for d in e["details"]], "component_count": e["count"]}
            out.append(row)
        return out

    return of_page


def whole_page(page: str, show_lines: bool, priority: Sequence[str]) -> Callable[[list[dict]], list[dict]]:
    def of_page(rows: list[dict]) -> list[dict]:
        of = {t: [r for r in rows if r["type"] == t] for t in priority}
        images = suppressed([_box(r) for r in of["image"]])
        tables = [r for r in of["table"] if all(ratio(_box(r), b) <= 0.3 for b in images)]
        borders = [_box(r) for r in tables]
        texts = merge_texts([(_box(r), r["content"] or "") for r in of["text"]], borders)
        found = [{"type": "image", "box": b, "idx": k} for k, b in enumerate(images)]
        found += [{"type": "text", "box": b, "idx": k} for k, (b, *_) in enumerate(texts) if all(ratio(b, t) <= 0.3 for t in borders)]
        if show_lines:
            found = vector_graphics(found + [{"type": "original_line", "box": _box(r), "idx": r["idx"]} for r in of["original_line"]])
            found = [e | {"idx": k} for k, e in enumerate(found)]
        found += [{"type": r["type"], "box": _box(r), "idx": r["idx"]} for r in [*tables, *of["original_qwen_table"]]]
        found.sort(key=lambda e: (priority.index(e["type"]), e["idx"]))
        return [{page: rows[0][page], "idx": e["idx"], "type": e["type"], **dict(zip(BOX, e["box"], strict=True)), "ord": k} for k, e in enumerate(found, 1)]

    return of_page
