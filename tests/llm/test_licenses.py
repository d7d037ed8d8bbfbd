import random
import re

import pytest
from helpers import awkward, documents

from quirespark.llm import licenses


#: A line break with a comment's mark before white space or the end.
COMMENT = r"""(?:\r\n|[\n\v\f\r\x85\u2028\u2029])[ \t]*(?://+!?|/\*+|\*+/?|\#+:?|;+|--+|%+|>+|!+|\|+|\.\\"|<!--|dnl\b|rem\b|')(?=[ \t\n\v\f\r]|\Z)"""


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, low)
    hits = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        hits += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    found = []
    folded = re.sub(r"[ \t\n\v\f\r\xa0]+", " ", re.sub(COMMENT, " ", low))
    for rank, r in enumerate(licenses.rules()):
        found += [(m.start(), m.end(), r.priority, rank, r.label) for m in re.finditer(r.pattern, folded)]
    kept = []
    for k, d in enumerate(found):
        key = (d[1] - d[0], d[2], -d[3])
        if not any(j != k and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and ((e[1] - e[0], e[2], -e[3]) > key) for j, e in enumerate(found)):
            kept.append(d)
    starts = [i for _, i in hits]
    score = max([d[2] / 100 for d in kept] + ([0.5] if hits else []) + [0.0])
    return (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in hits})), ",".join(sorted({x for x, _ in hits} | {d[4] for d in kept})), score)


TEXTS = [
    "Licensed under the Apache License, Version 2.0.\nfoo MIT License bar.",
    "SPDX-License-Identifier: GPL-3.0-or-later\n// SPDX-License-Identifier: MIT",
    "This work is licensed under the GNU General Public License, version 3. general public license MIT  license mit-license",
    "Released under CC BY-NC 4.0, see https://creativecommons.org/licenses/by-nc/4.0/legalcode",
    "Copyright (c) 2019 X. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy",
    "MİT license mIt LiCeNsE  ſpdx Keyword general general public public license apache license apache license",
    "the apache license license mit license mit license general public license" * 40,
    "License: BSD-3-Clause; licence = isc; the MIT License (MIT); use is governed by the terms of the Mozilla Public License 2.0",
    "no keyword here 漢字 ünïcode 12 3",
    "mit\x00license apache\tlicense general\npublic\x7flicense",
]


def test_rules_are_many_and_ordered():
    table = licenses.rules()
    assert len(table) > 400 and len(licenses.WORDINGS) > 140 and len({(r.label, r.pattern) for r in table}) == len(table)
    for r in table:
        re.compile(r.pattern)
        assert all(r.literals) and any(any(g in w for g in licenses.GATE) for w in (r.keyword, *r.literals)), r


def test_literals():
    assert licenses.literals(r"apache(?: software)?(?: license)?,? (?:version |v)?2(?:\.0)?") == ["apache"]
    assert licenses.literals(r"gnu general public license,? (?:version |v)3|gpl ?v?3") == ["gnu general public license", "gpl"]
    assert licenses.literals(r"opensource\.org/licenses/mit-0") == ["opensource.org/licenses/mit-0"]


@pytest.mark.parametrize("clashing", [False, True])
def test_against_brute_force(spark, clashing):
    rows = licenses.scan(documents(spark, [*TEXTS, None, ""], clashing)).orderBy("doc_id").collect()
    for r, t in zip(rows, [*TEXTS, None, ""], strict=True):
        assert tuple(r)[1:8] == pytest.approx(brute(t)), t


def test_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan(docs).collect():
        assert tuple(r)[1:8] == pytest.approx(brute(texts[r.doc_id]))


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and all(r.n_words is not None and r.labels is not None for r in rows)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = licenses.scan(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def made(parsed, rng):
    """A match of a parsed pattern."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "BRANCH":
            out += made(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += made(arg[3], rng)
        elif name == "MAX_REPEAT":
            out += "".join(made(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], 2))))
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else "7"
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
    return out


def test_every_match_passes_the_filters():
    rng = random.Random(1)
    for r in licenses.rules():
        for _ in range(60):
            text = made(re._parser.parse(r.pattern), rng)
            assert re.search(r.pattern, text), (r, text)
            assert r.keyword in text and any(w in text for w in r.literals) and any(g in text for g in licenses.GATE), (r, text)


def test_wordings_without_other_keywords(spark):
    texts = ["Unauthorized copying of this file, via any medium, is prohibited", "Use is subject to the terms of the GPLv3.", "Usage governed by Apache 2.0"]
    rows = licenses.scan(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["proprietary", "gpl-3.0", "apache-2.0"]


NOTICES = {
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_notices_wrapped_at_every_word(spark, mark):
    """Each notice broken at each of its spaces, and at all of them, with a comment's mark before each line."""
    texts, want = [], []
    for label, notice in NOTICES.items():
        words = notice.split(" ")
        for k in [*range(1, len(words)), None]:
            lines = words if k is None else [" ".join(words[:k]), " ".join(words[k:])]
            texts.append("\n".join(mark + line for line in lines))
            want.append(label)
    rows = licenses.scan(documents(spark, texts)).orderBy("doc_id").collect()
    for r, label, text in zip(rows, want, texts, strict=True):
        assert label in r.labels.split(","), (r.labels, text)


def test_base_columns_against_sql(spark, small):
    """The base columns by DuckDB."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(
        r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents),
        places AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w),
        hits AS (
            SELECT doc_id, i, CASE WHEN words[i + 1] = 'mit' AND words[i + 2] = 'license' THEN 'mit' WHEN words[i + 1] = 'apache' AND words[i + 2] = 'license' THEN 'apache'
                WHEN words[i + 1] = 'general' AND words[i + 2] = 'public' AND words[i + 3] = 'license' THEN 'gpl' END AS label FROM places)
        SELECT w.doc_id, len(any_value(words)), count(label), min(i) FILTER (label IS NOT NULL), max(i) FILTER (label IS NOT NULL), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '')
        FROM w LEFT JOIN hits USING (doc_id) GROUP BY w.doc_id ORDER BY 1"""
    ).fetchall()
    got = licenses.scan(spark.read.parquet(f"{small}/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and sum(w[2] for w in want) > 0
