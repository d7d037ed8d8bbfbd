"""HTML, Markdown, replies, questions, model calls, files, sinks, streams and the workflow."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quirespark.operators import htmltree, inference, markdown, qa, replies
from quirespark.plans import workflow
from quirespark.sources import files, pdf, sinks
from quirespark.streaming import pages as stream


def page(spark, html, **columns):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


def md_of(spark, html):
    return [r.md for r in markdown.block_markdown(htmltree.page_blocks(page(spark, html))).orderBy("ord").collect()]


@pytest.mark.parametrize(
    "html,want",
    [
        ("<h2 data-bbox='1 2 3 4'> T <b>x</b></h2>", ["<!-- H2 bbox: 1 2 3 4 -->\n## T x\n"]),
        ("<p> a </p><p> </p><address><p>b</p></address>", ["a\n", "*b*\n"]),
        ("<div class='formula'><img src=x><div>E=mc</div></div><div class=formula></div>", ["E=mc\n", "<!-- Formula placeholder -->\n"]),
        ("<div class='abstract'><p>in</p>side</div><p>out</p>", ["## Abstract\ninside\n", "out\n"]),
        ("<img alt='A' src='s.png'><img>", ["![A](s.png)\n", "![Image](image_placeholder)\n"]),
        ("<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><td>c</td><td>d</td></tr></table>", ["| A | B | B |\n| --- | --- | --- |\n| A | c | d |\n"]),
        ("<table></table>", ["<!-- empty table -->\n"]),
        ("<table class='a b'><tr data-bbox='9'><td><p>x</p></td></tr></table><p>after</p>", ["<!-- TABLE class: a b -->\n<!-- TABLE ROW bbox: 9 -->\n| x |\n| --- |\n", "after\n"]),
        ("<ol start=3><li>x</li><li>y\n z</li></ol>", ["<!-- LIST start: 3 -->\n3. x\n4. y\n   z\n"]),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", ["- ab\n"]),
        ("<ul></ul>", ["<!-- empty list -->\n"]),
        ("<p>one<p>two", ["onetwo\n", "two\n"]),
        ("<p>a</p><p>a</p>", ["a\n", "a\n"]),
        ("<script>var x='<p>no</p>'</script><!-- <p>no</p> --><p>&lt;yes&gt;</p>", ["<yes>\n"]),
    ],
)
def test_block_markdown(spark, html, want):
    assert md_of(spark, html) == want


@pytest.mark.parametrize("html,start", [("<table><tr><td colspan=x>a</td></tr></table>", "<!-- table error"), ("<ol start=x><li>a</li></ol>", "<!-- LIST start: x -->\n<!-- list error")])
def test_bad_spans_are_comments(spark, html, start):
    assert md_of(spark, html)[0].startswith(start)


def test_statistics_count_nested_elements(spark):
    html = "<h1>a</h1><p>b</p><div class='formula x'><img></div><table><tr><td><p>c</p></td></tr></table><ul><li>d</li></ul><ol></ol>"
    s = htmltree.page_statistics(page(spark, html)).first()
    assert (s.total_elements, s.headings, s.paragraphs, s.formulas, s.images, s.tables, s.lists) == (8, 1, 2, 1, 1, 1, 2)
    t = htmltree.totals(htmltree.page_statistics(page(spark, html))).first()
    assert (t.total_pages, t.total_elements, t.total_lists) == (1, 8, 2)
    r = htmltree.element_records(page(spark, "<div class='a b'><p data-bbox='1'>" + "x" * 300 + "</p></div>")).orderBy("ord").collect()
    assert r[1].type == "p" and len(r[1].text) == 200 and r[1].parent_class == ["a", "b"] and r[1].bbox == "1"


def test_deep_pages_do_not_overflow(spark):
    html = "<div>" * 30_000 + "x"
    assert htmltree.page_statistics(page(spark, html)).first().total_elements == 30_000
    assert htmltree.parse(html).text() == "x" and htmltree.parse(html).markup().count("</div>") == 30_000


def test_clean_html():
    html = "<html><body><p style='color: red; margin:1px;' data-bbox='1' class='formula.handwritten formula'>a</p><p style='color:red'>b</p><div class='image caption'>cap</div><div class='chart' format='x'>z</div> </body></html>"
    got = htmltree.cleaned(html)
    assert got.startswith("```html\n<html><body>\n") and got.endswith("</body></html>\n```")
    assert '<p style=" margin:1px" class="formula">a</p>' in got and "<p>b</p>" in got
    assert '<div class="image"></div>' in got and '<div class="chart"></div>' in got and "bbox" not in got


def test_positions_and_reordering(spark):
    html = "".join(f"<p data-bbox='{x} {y} {x + 50} {y + 9}'>{t}</p>" for x, y, t in ((300, 10, "b"), (20, 10, "a"), (20, 100, "c"), (300, 100, "d"))) + "<p data-bbox='1 2'>no</p>"
    from quirespark.operators import reading_order

    rows = htmltree.positioned_blocks(page(spark, html)).withColumn("idx", F.col("original_index"))
    ordered = reading_order.reading_order(rows, page=("page_id",))
    assert [r.text for r in ordered.orderBy("read_ord").collect()] == ["a", "b", "c", "d"]
    out = htmltree.reordered_page(ordered).first().html
    assert [out.index(f">{t}<") for t in "abcd"] == sorted(out.index(f">{t}<") for t in "abcd") and out.count("<p") == 4


def model_clean(md):
    """The rules of cleaning, line by line."""
    lines = []
    for line in md.split("\n"):
        s = line.strip()
        if (s.startswith("<!--") and s.endswith("-->")) or s == "---":
            continue
        if s or (lines and lines[-1]):
            lines.append(line if s else "")
    out = []
    for line in lines:
        s, b = line.strip(), out[-1].strip() if out else ""
        apart = s.startswith(("#", "|", "-", "*", "!", "$", "```", ">", "[")) or s.isdigit()
        none = b.startswith(("#", "|", "-", "*", "!", "$", "```", ">"))
        if s and not apart and b and not none and s[0].islower() and s[0].isalpha() and not b.endswith((".", "?", "!")):
            out[-1] = out[-1].rstrip() + " " + s
        else:
            out.append(line)
    while out and not out[-1].strip():
        out.pop()
    return "\n".join(out)


@pytest.mark.parametrize("md,want", [("The model\nimproves accuracy.\nand more\n# H\nlower", "The model improves accuracy.\nand more\n# H\nlower"), ("<!-- a -->\n\n---\nText\n\n\nmore", "Text\n\nmore"), ("", ""), ("\n\n", ""), ("[x\nlow", "[x low"), ("12\nlow", "12 low"), ("a\n<!-- x -->\nb", "a b")])
def test_clean_examples(spark, md, want):
    assert spark.range(1).select(markdown.clean(F.lit(md))).first()[0] == want == model_clean(md)


def test_clean_is_the_sequential_one(spark):
    rng = random.Random(3)
    bits = ["", " ", "a", "low line", "Up line.", "Up line", "# h", "| t |", "- x", "* y", "```", "> q", "[ r", "$ m", "12", "<!-- c -->", "---", "end?", "  pad ", "é x", "　", "!i", "ß y,"]
    docs = ["\n".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, md string").select(markdown.clean(F.col("md")), "i").orderBy("i").collect()]
    assert got == [model_clean(d) for d in docs]
    again = spark.createDataFrame([(i, d) for i, d in enumerate(got)], "i int, md string").select(markdown.clean(F.col("md")), "i").orderBy("i").collect()
    assert [r[0] for r in again] == [model_clean(d) for d in got]


def test_page_markdown_and_merge(spark):
    rows = spark.createDataFrame([(10, "<p>last</p>"), (2, "<h1>T</h1><p>The model</p>"), (3, ""), (4, "<p>goes on.</p>")], "page_id long, html string")
    pages = markdown.page_markdown(htmltree.page_blocks(rows), rows)
    got = {r.page_id: r for r in pages.collect()}
    assert got[2].complete_md == "<!-- PAGE 2 START -->\n---\n<!-- Page 2 -->\n\n# T\n\nThe model\n\n<!-- PAGE 2 END -->\n"
    assert got[2].clean_md == "# T\n\nThe model" and got[3].clean_md == ""
    whole = markdown.merged(pages).first()
    assert whole.n_pages == 4 and whole.clean_md == "# T\n\nThe model\n\ngoes on.\n\nlast" and whole.complete_md.index("PAGE 4") < whole.complete_md.index("PAGE 10")


def test_images_by_file_name(spark):
    paths = spark.createDataFrame([("/a/doc_page_1_2.png",), ("/a/doc_page_1_1.jpg",), ("/a/other_page_1_3.png",), ("/a/doc_page_2_1.tiff",)], "path string")
    index = htmltree.image_index(paths, "doc")
    assert sorted((r.page, r.img_ord) for r in index.collect()) == [(1, 1), (1, 2)]
    rows = spark.createDataFrame([(1, "<img><p>x</p><img src='o'><img>"), (2, "<img>")], "page int, html string")
    got = {r.page: r.html for r in htmltree.insert_sources(rows, index).collect()}
    assert got == {1: '<img src="/a/doc_page_1_1.jpg"/><p>x</p><img src="/a/doc_page_1_2.png"/><img/>', 2: "<img>"}


# ---- replies ----


def test_detections(spark):
    texts = ['ok [{"bbox_2d":[1,2,3,4]}] end', "no json", '[{"bbox_2d":[1,2,3]}, {"label":"x"}, {"bbox_2d":[4,3,2,1],"label":"t","confidence":0.25}]', "[broken", None, "] [", '{"bbox_2d":[1,2,3,4]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, reply string")
    rows = {(r.id, r.det_ord): tuple(r)[2:] for r in replies.detections(df).collect()}
    assert rows == {(0, 0): (1, 2, 3, 4, "表格", 1.0), (2, 2): (4, 3, 2, 1, "t", 0.25)}


def test_other_replies(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(replies.without_fence(F.lit('x\n```json\n[1]\n```\ny'))) == "[1]\n" and one(replies.without_fence(F.lit("[2]"))) == "[2]"
    assert one(replies.repaired(F.lit('[{"a":"b"}, {"a":"c'))) == '[{"a":"b"}]' and one(replies.repaired(F.lit("[1]"))) == "[1]" and one(replies.repaired(F.lit("junk"))) is None
    p = one(replies.points(F.lit('<points x1="1.5" y1="2" x2="3" y2="4" alt="cat">a cat</points>')))
    assert [(q.x, q.y) for q in p.points] == [("1.5", "2"), ("3", "4")] and (p.alt, p.phrase) == ("cat", "a cat")
    assert one(replies.points(F.lit("<other>"))) is None
    b = one(replies.plain_box(F.lit("1,2.5, 3,4 a label")))
    assert (b.x1, b.y1, b.x2, b.y2, b.label) == (1, 2.5, 3, 4, "a label") and one(replies.plain_box(F.lit("x"))) is None


# ---- questions ----


@pytest.mark.parametrize("reply,want", [("是", True), ("否", False), ("不是", True), ("答案：是", True), ("我认为不需要是", False), (None, False), (" \n是", True)])
def test_route(spark, reply, want):
    assert spark.range(1).select(qa.needs_vision(F.lit(reply).cast("string"))).first()[0] is want


@pytest.mark.parametrize("question,n,want", [("第二张图说明了什么", 5, [2]), ("图1和表3", 5, [1, 3]), ("第十一张图", 5, [1, 2]), ("流程图", 5, [1, 2]), ("贡献", 5, []), ("图9", 5, [1, 2]), ("第1张图与图1", 5, [1])])
def test_image_selection(spark, question, n, want):
    images = F.array(*(F.lit(k) for k in range(1, n + 1)))
    row = spark.range(1).select(qa.selected_images(F.lit(question), images).alias("a"), qa.images_or_first(qa.selected_images(F.lit(question), images), images).alias("b")).first()
    assert row.a == want and row.b == (want or [1, 2, 3])


def test_history_and_prompts(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"m{k}") for k in range(26)] + [(2, 0, "user", "only"), (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "a")]
    pairs = qa.turn_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert qa.last_turns(pairs).filter("conv_id = 1").count() == 10
    got = {r.conv_id: r.history for r in qa.history(pairs).collect()}
    assert got == {1: "".join(f"Q: m{k}\nA: m{k + 1}\n\n" for k in (20, 22, 24)), 3: "Q: q\nA: a\n\n"}
    prompt = spark.range(1).select(qa.qa_prompt(F.lit("Q?"), F.lit("x" * 7000), F.lit(None).cast("string"))).first()[0]
    assert "x" * 6000 in prompt and "x" * 6001 not in prompt and "..." in prompt and "Question: Q?" in prompt and "History" not in prompt
    assert "..." not in spark.range(1).select(qa.summary_prompt(F.lit("short"))).first()[0].split("short")[1]


def test_image_references(spark):
    text = "![a](b.png) <img src='c.jpg'> ![](d) <img alt=x>"
    rows = spark.range(1).select(F.explode(qa.image_references(F.lit(text)))).select("col.*").collect()
    assert [tuple(r) for r in rows] == [("a", "b.png", "markdown"), ("", "d", "markdown"), ("", "c.jpg", "html")]


# ---- model calls ----


def test_retries():
    slept, calls = [], []
    policy = inference.RetryPolicy(max_retries=3, delay=2.0, sleep=slept.append)
    with pytest.raises(KeyError):
        policy.run(lambda: calls.append(1) or {}["x"])
    assert len(calls) == 4 and slept == [2.0, 3.0, 4.5]
    answers = iter(["", "  ", "yes"])
    assert policy.run(lambda: next(answers)) == ("yes", 3)
    with pytest.raises(inference.NoReply):
        inference.RetryPolicy(max_retries=0).run(lambda: " ")


def test_calls_isolate_failures(spark):
    rows = spark.createDataFrame([("a", "p1"), ("b", "unknown")], "request_key string, prompt string")
    got = {r.request_key: r for r in inference.call(rows, lambda: inference.ReplayClient({"p1": "r1"}), "m", policy=inference.RetryPolicy(1, 0.0), parallelism=2).collect()}
    assert got["a"].reply == "r1" and got["a"].attempts == 1 and got["b"].reply is None and "KeyError" in got["b"].error
    assert inference.api_status("secret", "http://x") == {"api_key_configured": True, "base_url": "http://x"}
    assert "secret" not in repr(inference.HttpClient("http://x", "secret"))


def test_detection_asks_only_about_pages_with_tables(spark):
    pages = spark.createDataFrame([("a", b"1"), ("b", b"2")], "request_key string, image binary")

    class Client:
        def complete(self, prompt, system, model, image=None):
            return ("是" if bytes(image) == b"1" else "否") if model == "small" else f"found {bytes(image)}"

    got = inference.detect_tables(pages, Client, "any table?", "where?", "small", "large").collect()
    assert [(r.request_key, r.reply) for r in got] == [("a", "found b'1'")]


def test_answers_by_image_or_text(spark):
    rows = [(1, "图2?", "paper", "", [("i1", b"x"), ("i2", b"y")]), (2, "what?", "paper", "Q: h", [("i1", b"x")]), (3, "图1?", "paper", "", [])]
    q = spark.createDataFrame(rows, "question_id long, question string, content string, history string, images array<struct<path string, content binary>>")

    class Client:
        def complete(self, prompt, system, model, image=None):
            return {"r": "是" if "图" in prompt.split("Question:")[1] else "否", "v": f"seen {image and bytes(image)}", "t": "text" + (" history" if "Q: h" in prompt else "")}[model]

    got = {r.question_id: r.answer for r in workflow.answer(q, Client, {"router": "r", "vision": "v", "text": "t"}).collect()}
    assert got == {1: "seen b'y'", 2: "text history", 3: "text"}


# ---- files and sinks ----


def test_html_and_markdown_files(spark, tmp_path):
    for name, text in (("page_10.html", "<p>ten</p>"), ("page_2.html", "<p>two</p>"), ("other.html", "x")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    pages = files.html_pages(spark, str(tmp_path))
    assert sorted((r.page, r.html) for r in pages.collect()) == [(2, "<p>two</p>"), (10, "<p>ten</p>")]
    status = files.html_directory_status(pages).first()
    assert status.valid and status.pages == [2, 10]
    rows = files.markdown_status(spark.createDataFrame([("a",), (" \n",), (None,)], "text string")).collect()
    assert [r.valid for r in rows] == [True, False, False]


def test_slices_in_both_orders(spark, tmp_path):
    for name in ("page_10_slice_1.jpg", "page_1_slice_2.jpg", "page_1_slice_1.jpg", "x.jpg"):
        (tmp_path / name).write_bytes(b"1")
    numeric = [r.page * 100 + r.slice for r in files.slice_images(spark, str(tmp_path)).orderBy("ord").collect()]
    by_name = [r.page * 100 + r.slice for r in files.slice_images(spark, str(tmp_path), "lexicographic").orderBy("ord").collect()]
    assert numeric == [101, 102, 1001] and by_name == [1001, 101, 102]
    assert files.available_images(spark.createDataFrame([("a.JPG",), ("b.txt",)], "path string")).count() == 1
    assert spark.range(1).select(files.encoded(F.lit(b"x" * 100))).first()[0].count("\n") == 0


def test_metadata_round_trip(spark, tmp_path):
    els = spark.createDataFrame([("d", 1, "text", 0, 1.0, 2.0, 3.0, 4.0, "c" * 300, None, None, None), ("d", 1, "table", 0, 5.0, 6.0, 7.0, 8.0, None, "T", 0.5, True), ("d", 2, "image", 0, 0.0, 0.0, 1.0, 1.0, None, None, None, None)], "doc_id string, page_number int, type string, idx int, x1 double, y1 double, x2 double, y2 double, content string, label string, confidence double, refined boolean")
    docs = spark.createDataFrame([("d", "in.pdf", "out.pdf", "2025-01-01 00:00:00", 2), ("e", "empty.pdf", "", "", 0)], "doc_id string, source_file string, output_file string, creation_time string, total_pages int")
    sinks.write_json(sinks.metadata(els, docs).drop("doc_id"), str(tmp_path / "m"))
    raw = [json.loads(line) for f in (tmp_path / "m").glob("part-*") for line in f.read_text().splitlines()]
    assert next(d for d in raw if d["source_file"] == "in.pdf")["summary"]["refined_tables"] == 1
    back = files.metadata_elements(files.metadata_documents(spark, str(tmp_path / "m"))).orderBy("page_number", "type").collect()
    assert [(r.page_number, r.type, r.x1) for r in back] == [(1, "table", 5.0), (1, "text", 1.0), (2, "image", 0.0)] and len(back[1].content) == 200 and back[0].refined


def test_small_sinks(spark, tmp_path):
    got = sinks.keep_latest(spark.createDataFrame([(f"f{k}", k) for k in range(5)], "path string, modified int"), 2).filter("keep").collect()
    assert sorted(r.path for r in got) == ["f3", "f4"]
    a = spark.createDataFrame([("table", 0, "T", 0.5, True), ("text", 1, None, None, None), ("vector_graphic", 0, None, None, None)], "type string, idx int, label string, confidence double, refined boolean")
    assert [(r.color, r.line_width, r.drawn_label) for r in sinks.annotations(a).collect()] == [("red", 4, "T 0.50"), ("blue", 2, "text 2"), ("magenta", 6, "vector_graphic 1")]
    pages, images = spark.createDataFrame([(1,), (2,)], "page_number int"), spark.createDataFrame([(1, b"x" * 2048)], "page_number int, content binary")
    assert sorted(tuple(r) for r in sinks.image_counts(pages, images).collect()) == [(1, 1), (2, 0)]
    assert sinks.image_details(images).first().size == "2.0 KB"
    sinks.write_texts(spark.createDataFrame([(1, "a\nb")], "page int, md string"), str(tmp_path / "t"), "md", ["page"])
    assert next((tmp_path / "t" / "page=1").glob("part-*")).read_text() == "a\nb\n"
    (tmp_path / "x.txt").write_text("x")
    import io
    import zipfile

    assert zipfile.ZipFile(io.BytesIO(sinks.zip_bundle([str(tmp_path / "x.txt"), "/none"]))).namelist() == ["x.txt"]


def test_pdf_reader_is_pluggable(spark):
    def reader(content):
        if content == b"bad":
            raise ValueError("broken")
        box = {"x1": 0.0, "y1": 0.0, "x2": 5.0, "y2": 5.0}
        blocks = [{"block_ord": 0, "block_type": 0, **box, "lines": [{"spans": [{"text": "a"}, {"text": "b"}]}, {"spans": [{"text": "c"}]}]}, {"block_ord": 1, "block_type": 1, **box, "lines": []}]
        drawings = [{"line_ord": 0, "kind": "line", "sx": 0.0, "sy": 0.0, "ex": 9.0, "ey": 0.0, "x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 0.0}]
        return {"info": {"title": "T"}, "pages": [{"page_number": 1, "width": 612.0, "height": 792.0, "blocks": blocks, "drawings": drawings}], "images": [{"page_number": 1, "img_ord": 1, "format": "png", "width": 2, "height": 3, "content": b"i"}]}

    from quirespark.operators import elements

    docs = pdf.documents(spark.createDataFrame([("a.pdf", b"ok"), ("b.pdf", b"bad")], "path string, content binary"), reader)
    assert {r.path: (r.pages, r.title, r.error) for r in pdf.info(docs).collect()} == {"a.pdf": (1, "T", None), "b.pdf": (None, None, "ValueError: broken")}
    got = elements.page_elements(pdf.page_items(docs)).orderBy("block_ord").collect()
    assert [(r.type, r.content) for r in got] == [("text", "a b c"), ("image", None)]
    assert pdf.page_lines(docs).first().ex == 9.0 and pdf.images(docs).first().format == "png" and pdf.page_sizes(docs).first().width == 612.0
    assert pdf.original_lines(pdf.page_lines(docs)).first().idx == 0


# ---- streams and the workflow ----


def test_stream_equals_batch(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/pages.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    out = []
    query = stream.page_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(stream.markdown_batches(lambda df: out.extend(df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = markdown.page_markdown(htmltree.page_blocks(batch.select("page_id", "html")), batch)
    assert sorted(map(str, out)) == sorted(map(str, want.collect()))
    query = stream.statistics_stream(stream.page_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table("stats").collect())) == sorted(map(str, htmltree.page_statistics(batch.select("page_id", "html")).collect()))


def test_workflow_stops_at_the_first_failure(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").limit(3)
    quiet = inference.RetryPolicy(0, 0.0)
    flow = workflow.Workflow(spark, [("html", workflow.convert_html), ("summary", workflow.summarise(lambda: inference.StubClient(lambda p: f"{len(p)} characters"), "m", quiet))])
    tables = flow.run({"html_pages": pages})
    assert tables["summary"].first().reply.endswith("characters") and [r.status for r in flow.status().collect()] == ["success", "success"]
    bad = workflow.Workflow(spark, [("layout", workflow.analyse_layout), ("html", workflow.convert_html)])
    bad.run({"html_pages": pages})
    assert [(r.stage, r.status) for r in bad.status().collect()] == [("layout", "error")]


def test_slices_to_pages_leaves_gaps(spark):
    rows = spark.createDataFrame([(1, b"a"), (2, b"bad"), (3, b"c")], "ord int, content binary")

    class Client:
        def complete(self, prompt, system, model, image=None):
            if bytes(image) == b"bad":
                raise RuntimeError("no")
            return f"<html><body><p data-bbox='1'>{bytes(image).decode()}</p></body></html>"

    stage = workflow.parse_slices(Client, "m", "to html", inference.RetryPolicy(0, 0.0), parallelism=2, clean=True)
    got = {r.page_id: r.html for r in stage({"slice_images": rows})["html_pages"].collect()}
    assert sorted(got) == [1, 3] and "<p>a</p>" in got[1]


def test_rasters_slices_and_conversion(spark):
    from quirespark.sources import images

    def render(content, zoom):
        if content == b"bad":
            raise ValueError("broken")
        return [(content + str(k).encode(), int(612 * zoom), int(792 * zoom)) for k in (1, 2)]

    rows = images.rasters(spark.createDataFrame([("a", b"x"), ("b", b"bad")], "path string, content binary"), 300.0, render).collect()
    assert [(r.path, r.page_number, r.width, r.height) for r in rows if r.path == "a"] == [("a", 1, 2550, 3300), ("a", 2, 2550, 3300)]
    assert [r.error for r in rows if r.path == "b"] == ["ValueError: broken"]
    cut = spark.createDataFrame([(1, False, 0, 1, 2, 3), (1, True, 0, 0, 1, 1)], "page int, discarded boolean, px1 int, py1 int, px2 int, py2 int")
    pages = spark.createDataFrame([(1, b"page")], "page int, content binary")
    got = images.cut_slices(cut, pages, crop=lambda content, box: content + bytes(box)).collect()
    assert [bytes(r.image) for r in got] == [b"page\x00\x01\x02\x03"] and got[0].image_error is None
    bad = images.as_jpeg(pages, convert=lambda content: 1 / 0).first()
    assert bad.jpeg is None and bad.jpeg_error.startswith("ZeroDivisionError")


def test_merged_is_cleaned_by_page(spark):
    """The same as cleaning the joined text, without an array of all of its lines; a comment that joined lines make goes with its page."""
    texts = ["one\n\n", None, "<!-- a\nb -->", "two,\nthree", " \n", "four\n<!-- x\ny -->\n\nfive", "lower\n---\n", "<!-- c\n\nd -->", "---", "- item\nnext\n\n<!-- e\nf -->"]
    for own in (texts, texts[::-1], texts[2:3], texts[4:6]):
        pages = spark.createDataFrame(list(enumerate(own)), "page_id long, complete_md string").withColumn("clean_md", markdown.clean(F.col("complete_md")))
        rows = [r.clean_md for r in pages.orderBy("page_id").collect()]
        joined = "\n\n".join(c for c in rows if c is not None and c.strip())
        want = spark.createDataFrame([(joined,)], "md string").select(markdown.clean(F.col("md"))).first()[0]
        out = markdown.merged(pages)
        assert out.first().clean_md == want
    lines = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in next(x for x in lines.splitlines() if "Aggregate" in x)
