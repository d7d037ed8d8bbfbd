"""Element operators: hand-derived cases, and sequential models on random pages."""

import random

import pytest

from quirespark.operators import elements as E
from quirespark.operators import kernels, layout, reading_order, snapping

SCHEMA = "page long, idx long, type string, x1 double, y1 double, x2 double, y2 double"


def frame(spark, rows):
    """rows: (page, type, box); idx by order."""
    return spark.createDataFrame([(p, i, t, *map(float, b)) for i, (p, t, b) in enumerate(rows)], SCHEMA)


def random_page(rng, n, types=("text", "image", "table", "original_line")):
    out = []
    for _ in range(n):
        x, y = rng.randint(0, 500), rng.randint(0, 700)
        out.append((rng.choice(types), (x, y, x + rng.randint(1, 300), y + rng.randint(1, 80))))
    return out


def pages(spark, seed, n_pages=30, **how):
    rng = random.Random(seed)
    rows = [(p, *e) for p in range(n_pages) for e in random_page(rng, rng.randint(0, 14), **how)]
    return rows, frame(spark, rows)


def by_page(rows):
    out = {}
    for i, (p, t, b) in enumerate(rows):
        out.setdefault(p, []).append((i, t, tuple(map(float, b))))
    return out


def test_suppression_example(spark):
    rows = [(1, "image", (0, 0, 100, 100)), (1, "image", (5, 5, 95, 95)), (1, "image", (50, 0, 160, 100))]
    got = E.suppress_duplicates(frame(spark, rows)).orderBy("idx").collect()
    assert [(r.idx, r.source_idx) for r in got] == [(0, 2), (1, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_suppression_is_sequential_nms(spark, seed):
    rows, df = pages(spark, seed, types=("image",))
    got = {(r.page, r.idx): r.source_idx for r in E.suppress_duplicates(df, 0.4).collect()}
    want = {}
    for p, items in by_page(rows).items():
        kept = []
        for i, _, b in sorted(items, key=lambda e: (-(e[2][2] - e[2][0]) * (e[2][3] - e[2][1]), e[0])):
            if not any(kernels.ratio(b, k) > 0.4 for _, k in kept):
                kept.append((i, b))
        want |= {(p, k): i for k, (i, _) in enumerate(kept)}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_overlap_filters(spark, seed):
    rows, df = pages(spark, seed)
    for op, left, right in ((E.text_without_tables, "text", "table"), (E.tables_without_images, "table", "image")):
        want = {i for items in by_page(rows).values() for i, t, b in items if t == left and not any(kernels.ratio(b, o) > 0.3 for _, u, o in items if u == right)}
        assert {r.idx for r in op(df).collect()} == want


def test_text_merge_content_veto_and_closure(spark):
    texts = [((0, 0, 10, 10), "a"), ((12, 0, 20, 10), "b"), ((30, 0, 40, 10), "c"), ((22, 0, 28, 10), "d")]
    assert kernels.merge_texts(texts, []) == [((0, 0, 40, 10), "a b d c", 4)]
    assert kernels.merge_texts(texts[:2], [(0, 12, 20, 30)]) == [((0, 0, 10, 10), "a", 1), ((12, 0, 20, 10), "b", 1)]
    assert kernels.merge_texts([((0, 0, 10, 10), "a"), ((15, 0, 20, 10), "b")], []) == [((0, 0, 10, 10), "a", 1), ((15, 0, 20, 10), "b", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_text_merge_invariants(spark, seed):
    rows, df = pages(spark, seed, types=("text",))
    from pyspark.sql import functions as F

    got = {}
    for r in E.merge_texts(df.withColumn("content", F.lit("w")), df.filter("false")).collect():
        got.setdefault(r.page, []).append(r)
    for p, items in by_page(rows).items():
        boxes = [(r.x1, r.y1, r.x2, r.y2) for r in got[p]]
        assert all(kernels.gap(a, b) >= 5 for k, a in enumerate(boxes) for b in boxes[:k])
        assert all(any(o[0] <= b[0] and o[1] <= b[1] and o[2] >= b[2] and o[3] >= b[3] for o in boxes) for *_, b in items)
        assert sum(r.n_merged for r in got[p]) == len(items) == sum(len(r.content.split()) for r in got[p])


def test_vector_graphic_example(spark):
    rows = [(1, "image", (0, 0, 20, 20)), (1, "original_line", (10, 10, 30, 10)), (1, "text", (300, 300, 400, 320))]
    got = E.merge_vector_graphics(frame(spark, rows)).orderBy("ord").collect()
    assert got[0].type == "vector_graphic" and (got[0].x1, got[0].y1, got[0].x2, got[0].y2) == (0, 0, 30, 20)
    assert got[0].component_types == {"image": 1, "original_line": 1} and got[0].component_count == 2 and got[1].type == "text"
    assert [d.type for d in got[0].component_details] == ["image", "original_line"]
    only_lines = [(1, "original_line", (10, 10, 30, 10)), (1, "original_line", (10, 12, 30, 12))]
    assert all(r.type == "original_line" for r in E.merge_vector_graphics(frame(spark, only_lines)).collect())


def test_process_page_orders_by_priority(spark):
    from pyspark.sql import functions as F

    df = frame(spark, [(1, "text", (0, 0, 50, 10)), (1, "table", (0, 100, 300, 300)), (1, "image", (400, 400, 500, 500)), (1, "text", (10, 110, 100, 120))])
    of = lambda t: df.filter(F.col("type") == t).withColumn("content", F.lit("x"))
    got = E.process_page(of("text"), of("image"), of("table"), of("original_line")).orderBy("ord").collect()
    assert [r.type for r in got] == ["table", "image", "text"]
    predicted = frame(spark, [(1, "table", (2, 98, 297, 305)), (2, "table", (5, 5, 90, 90))])
    for show in (False, True):
        got = E.process_page(of("text"), of("image"), of("table"), of("original_line"), show, predicted=predicted).orderBy("page", "ord").collect()
        assert [(r.page, r.type) for r in got] == [(1, "table"), (1, "image"), (1, "text"), (1, "original_qwen_table"), (2, "original_qwen_table")]
        assert [(r.x1, r.y1, r.x2, r.y2) for r in got if r.type == "original_qwen_table"] == [(2, 98, 297, 305), (5, 5, 90, 90)]


def test_process_page_keeps_tables_out_of_vector_graphics(spark):
    from pyspark.sql import functions as F

    df = frame(spark, [(1, "image", (0, 40, 40, 60)), (1, "original_line", (15, 50, 45, 50)), (1, "table", (41, 40, 49, 70))])
    of = lambda t: df.filter(F.col("type") == t).withColumn("content", F.lit("x"))
    assert E.merge_vector_graphics(df).first().component_types == {"image": 1, "original_line": 1, "table": 1}
    got = E.process_page(of("text"), of("image"), of("table"), of("original_line"), True).orderBy("ord").collect()
    assert [(r.type, r.x1, r.y1, r.x2, r.y2) for r in got] == [("table", 41, 40, 49, 70), ("vector_graphic", 0, 40, 45, 60)]


def test_summary_and_histogram(spark):
    df = frame(spark, [(1, "text", (0, 0, 1, 1)), (1, "text", (5, 5, 9, 9)), (1, "vector_graphic", (1, 1, 2, 2)), (2, "image", (0, 0, 3, 3))])
    got = {r.page: r for r in E.summary(df).collect()}
    assert (got[1].n_text, got[1].n_elements, got[1].n_all) == (2, 2, 3)
    hist = {r.page: r for r in E.type_histogram(df).collect()}
    assert hist[1].component_types == {"text": 2, "vector_graphic": 1} and hist[1].component_count == 3 and hist[1].x2 == 9


# ---- layout ----


def model_layout(items, width=612.0, height=792.0):
    """A plain sequential model: (layout type, regions)."""
    c = width / 2
    content = [(i, t, b) for i, t, b in items if t in E.CONTENT]
    whole, halves = [("single", 0, 0, width, height)], lambda a, b: [("left_column", 0, a, c, b), ("right_column", c, a, width, b)]
    crossing = lambda b: b[0] <= c <= b[2]
    if not content:
        return "single", whole
    if not any(crossing(b) for *_, b in content):
        return "double", halves(0, height)
    pairs = [(a, b) for k, (*_, a) in enumerate(content) for *_, b in content[:k] if not (a[3] < b[1] or b[3] < a[1])]
    if all(crossing(a) and crossing(b) for a, b in pairs):
        return "single", whole
    merged = []
    for _, _, b in sorted(content, key=lambda e: e[2][1]):
        kind = "single" if crossing(b) else "double"
        if merged and merged[-1][0] == kind and b[1] <= merged[-1][2] + 20:
            merged[-1][2] = max(merged[-1][2], b[3])
        else:
            merged.append([kind, b[1], b[3]])
    out = []
    for kind, a, z in merged:
        inside = [b for *_, b in content if not (b[3] < a or b[1] > z)]
        if kind == "single":
            out.append(("single", 0, a, width, z))
        elif any(map(crossing, inside)):
            out += [("irregular_element", b[0], max(b[1], a), b[2], min(b[3], z)) for b in inside]
        else:
            out += halves(a, z)
    return "mixed", out


@pytest.mark.parametrize("seed", range(4))
def test_layout_is_the_sequential_one(spark, seed):
    rows, df = pages(spark, seed, 40)
    sizes = spark.createDataFrame([(p, 612.0, 792.0) for p in range(40)], "page long, width double, height double")
    layouts = layout.page_layout(df, sizes)
    kinds = {r.page: r.layout_type for r in layouts.collect()}
    got = {}
    for r in layout.regions(df, layouts).orderBy("page", "region_ord").collect():
        got.setdefault(r.page, []).append((r.region_type, r.x1, r.y1, r.x2, r.y2))
    items = by_page(rows)
    for p in range(40):
        kind, regions = model_layout(items.get(p, []))
        assert kinds[p] == kind and got[p] == [(k, *map(float, b)) for k, *b in regions]


@pytest.mark.parametrize(
    "boxes,kind,regions",
    [
        ([(50, 100, 290, 700), (320, 100, 560, 700)], "double", 2),
        ([(50, 50, 560, 80), (50, 100, 560, 700)], "single", 1),
        ([(50, 100, 290, 700), (320, 100, 560, 700), (50, 50, 560, 80)], "mixed", 3),
        ([], "single", 1),
        ([(50, 100, 290, 700), (320, 100, 560, 700), (50, 50, 560, 100)], "mixed", 4),
    ],
)
def test_layout_examples(spark, boxes, kind, regions):
    df = frame(spark, [(1, "text", b) for b in boxes])
    layouts = layout.page_layout(df, spark.createDataFrame([(1, 612.0, 792.0)], "page long, width double, height double"))
    assert layouts.first().layout_type == kind
    found = layout.regions(df, layouts)
    assert found.count() == regions
    cut = layout.slices(found).orderBy("region_ord").collect()
    kept = [r for r in cut if not r.discarded]
    assert [r.slice_index for r in kept] == list(range(1, len(kept) + 1)) and all(r.x2 - r.x1 > 15 and r.y2 - r.y1 > 15 for r in kept)
    assert kept[0].filename == "page_1_slice_1.jpg"


# ---- reading order ----


def model_columns(items):
    rows = {}
    for *_, b in items:
        rows.setdefault(round(b[1] / 10) * 10, []).append(b[0])
    xs = sorted(x for r in rows.values() if len(r) >= 2 for x in r)
    clusters = []
    for x in xs:
        if clusters and x - clusters[-1][-1] <= 50:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    return [sum(c) / len(c) for c in clusters], [len(c) for c in clusters]


@pytest.mark.parametrize("seed", range(3))
def test_reading_order_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    rows = [(p, "text", (x := rng.choice((20, 40, 300, 320, 500)), y := rng.randint(0, 60) * 5, x + 50, y + 10)) for p in range(25) for _ in range(rng.randint(1, 9))]
    df = frame(spark, rows)
    found = {r.page: r for r in reading_order.columns(df).collect()}
    got = {}
    for r in reading_order.reading_order(df).orderBy("page", "read_ord").collect():
        got.setdefault(r.page, []).append(r.idx)
    for p, items in by_page(rows).items():
        centers, sizes = model_columns(items)
        assert (p in found) == bool(centers)
        if centers:
            assert found[p].centers == pytest.approx(centers) and found[p].confidence == pytest.approx(sum(s >= 2 for s in sizes) / len(sizes))
        if len(centers) >= 2:
            nearest = lambda b: min(range(len(centers)), key=lambda k: (abs(b[0] - centers[k]), k))  # noqa: B023, E731
            want = sorted(items, key=lambda e: (round(e[2][1] / 20) * 20, nearest(e[2]), e[2][0]))
        else:
            want = sorted(items, key=lambda e: (e[2][1], e[2][0]))
        assert got[p] == [i for i, *_ in want]


def test_columns_example(spark):
    df = frame(spark, [(1, "text", (x, 20, x + 5, 30)) for x in (50, 60, 300)])
    r = reading_order.columns(df).first()
    assert r.centers == [55.0, 300.0] and r.confidence == 0.5 and r.is_multi_column
    assert reading_order.reorder_gate(df).first().status == "reordered"


# ---- border snapping ----

LINES = "page long, line_ord long, kind string, sx double, sy double, ex double, ey double, x1 double, y1 double, x2 double, y2 double"


def snapped(spark, table, lines):
    rows = []
    for k, (kind, *v) in enumerate(lines):
        v = list(map(float, v))
        rows.append((1, k, kind, *(v if kind == "line" else [None] * 4), min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])))
    df = spark.createDataFrame(rows, LINES)
    r = snapping.snap(frame(spark, [(1, "table", table)]), df).first()
    return (r.x1, r.y1, r.x2, r.y2), r.refined


@pytest.mark.parametrize(
    "table,lines,box,refined",
    [
        ((100, 200, 400, 400), [("line", 95, 190, 405, 190), ("line", 95, 410, 405, 410)], (95, 190, 405, 410), True),
        ((100, 200, 400, 400), [("line", 95, 190, 405, 190)], (100, 200, 400, 400), False),
        ((100, 200, 400, 400), [("rect", 110, 190, 395, 410)], (110, 190, 395, 410), True),
        ((100, 200, 400, 250), [("line", 95, 210, 405, 210), ("line", 95, 262, 405, 262)], (95, 210, 405, 262), True),
        ((100, 200, 400, 250), [("line", 95, 210, 405, 210)], (95, 210, 405, 260), True),
        ((100, 200, 400, 400), [], (100, 200, 400, 400), False),
        ((100, 200, 400, 400), [("line", 90, 180, 90, 420), ("line", 410, 180, 410, 420)], (90, 180, 410, 420), True),
        ((100, 200, 400, 400), [("line", 95, 190, 405, 190), ("line", 95, 195, 405, 195), ("line", 98, 195, 98, 395), ("line", 402, 195, 402, 395)], (98, 195, 402, 395), True),
        ((100, 200, 400, 400), [("line", 200, 300, 200, 301), ("line", 95, 190, 100, 240)], (100, 200, 400, 400), False),
    ],
)
def test_snapping(spark, table, lines, box, refined):
    assert snapped(spark, table, lines) == (tuple(map(float, box)), refined)


def test_gate_by_the_first_page(spark):
    df = frame(spark, [(1, "text", (x, 20, x + 5, 30)) for x in (50, 300)] + [(2, "text", (50, 20, 55, 30))])
    status = lambda gate: {r.page: r.status for r in reading_order.reorder_gate(df, gate=gate).collect()}
    assert status("page") == {1: "reordered", 2: "single column"} and status("first_page") == {1: "reordered", 2: "reordered"}
    assert {r.status: r.n_pages for r in reading_order.gate_counts(reading_order.reorder_gate(df)).collect()} == {"reordered": 1, "single column": 1}


def test_pages_split_over_batches():
    import pyarrow as pa

    rows = [{"page": p, "is_text": True, "idx": i, "x1": 30.0 * i, "y1": 0.0, "x2": 30.0 * i + 28, "y2": 9.0, "content": "w"} for p in range(5) for i in range(7)]
    run = kernels.page_by_page("page", kernels.merge_texts_of_page("page", 5.0), ["page", "ord", *kernels.BOX, "content", "n_merged"])
    whole = [r for b in run([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    parts = [r for b in run([pa.RecordBatch.from_pylist(rows[k : k + 3]) for k in range(0, len(rows), 3)]) for r in b.to_pylist()]
    assert whole == parts and [r["n_merged"] for r in whole] == [7] * 5
    assert list(run([])) == []
