from collections import defaultdict

from quirespark.llm import chat


def brute(rows):
    convs = defaultdict(set)
    for c, turn, role, text in rows:
        convs[c].add((turn, role, text))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] or "")
    whole = {c: tuple((r, t) for _, r, t in sorted(v, key=key)) for c, v in convs.items()}
    out = []
    for turns in set(whole.values()):
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in whole.values()):
            same = [c for c, v in whole.items() if v == turns]
            ids = [c for c in same if c is not None]
            text = "".join(f"<|{'unknown' if r is None else r}|>\n{t or ''}\n<|end|>\n" for r, t in turns)
            out.append((min(ids) if ids else None, len(turns), len(same), text))
    return sorted(out, key=str)


def verify(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in chat.render(df.selectExpr("*", "'x' as k", "1 as n", "'y' as content")).collect()), key=str)
    assert got == brute(rows)
    return got


def test_snapshots_copies_and_ties(spark):
    base = [("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", "ok")]
    rows = []
    for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)):
        rows += [(c, k, *t) for k, t in enumerate(base[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "different")]
    rows += [(7, 0, "user", None), (8, 0, "user", ""), (8, 1, None, "x"), (9, 5, "user", "hi"), (None, 0, "user", "null id"), (None, 1, "user", "z")]
    rows += rows[:3]
    got = verify(spark, rows)
    assert [g[:3] for g in got if g[0] == 3] == [(3, 4, 2)]


def test_hot_first_turn(spark):
    rows = [(c, 0, "user", "same first turn") for c in range(300)] + [(c, 1, "assistant", f"a{c % 7}") for c in range(100)]
    assert len(verify(spark, rows)) == 7


def test_small_table(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    verify(spark, rows)


def test_empty_and_native(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    assert chat.render(df.limit(0)).count() == 0
    plan = chat.render(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
