import re
from html import unescape

import duckdb
import pytest

from quirespark.llm import mainhtml

SCHEMA = "page_id long, url string, html string"
WEIGHTS = mainhtml.weights_of({})
ARTICLE = "<h1>Head line</h1><p>First   paragraph with <b>bold</b>er words &amp; more.<br>New line</p><p>Second one, &eacute;t&#233; with a <a href='x'>link</a> in it.</p><ul><li>One item</li><li>Other item</li></ul><blockquote>Quoted words here.</blockquote>"
TEXT = "Head line First paragraph with bolder words & more. New line Second one, été with a link in it. One item Other item Quoted words here."
AROUND = [
    ("<html><head><title>T t t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home page</a></li></ul></nav><article>", "</article><footer>&copy; a footer with many words in it, really many words</footer></body></html>"),
    ("<body><header><a href=/>Site name of many words</a></header><main>", "</main><aside><p>Side bar words " + "x y z " * 40 + "</p></aside>"),
    ("<body><div class='cookie-notice'><p>We use cookies. " + "Accept them. " * 30 + "</p></div><div id=content>", "</div><div class=sidebar><h3>Popular</h3><p>Some other text " * 5 + "</p></div>"),
    ("<body><article><div class='ad'>Buy now this thing</div>", "<form action=x><label>Name</label><input name=a><button>Send it</button></form><section class='comments'><article class='comment'><p>Reader says a lot " + "bla " * 50 + "</p></article></section></article>"),
    ("<body><script>var t='</p><article>';</script><!-- <p>hidden</p> --><article>", "</article><footer>&copy; cut o"),
    ("<body class='has-sidebar'><div class='post with-sidebar no-ads'>", "</div><div id='siteFooter'><p>Words of the footer, some more of them</p></div>"),
    ("<body><div role=navigation><a>a b c</a></div><article>", "<div class='share-buttons'><a>Tweet this</a></div><div class='related'><h2>Related</h2><p>" + "word " * 60 + "</p></div></article>"),
]


LONG = "<h1>Head line</h1><p>" + " ".join(f"word{k}" for k in range(80)) + ".</p>"
LONG_TEXT = "Head line " + " ".join(f"word{k}" for k in range(80)) + "."
#: Names that mislead: builders' widgets, words with another meaning, a page in one form.
MISLEADING = [
    ("<body><div class='elementor-widget elementor-widget-text-editor'><div class='elementor-widget-container'>", "</div></div><footer>&copy; some footer words</footer>"),
    ("<body><nav><a href=/>Home</a></nav><div class='ad-free'>", "</div>"),
    ("<body><div class='legal-news'>", "</div><div class='ad'>Buy this</div>"),
    ("<body><form method=post action=x><input type=hidden name=v><div>", "</div></form></body>"),
    ("<body><div class=widget><ul><li><a href=x>One</a></li></ul></div><div class='search-engine-history'>", "</div><aside><p>Side words</p></aside>"),
]


def learned():
    """Weights as fit() counts them, from the test pages."""
    counts = {}
    for (html,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        for at, found in enumerate(mainhtml.counted(html)):
            for kind, n in found.items():
                counts.setdefault(kind, [0, 0])[at] += n
    return mainhtml.weights_of({k: tuple(v) for k, v in counts.items()})


@pytest.mark.parametrize("by", ["fixed", "learned"])
@pytest.mark.parametrize("before,after", AROUND)
def test_templates(before, after, by):
    weights = WEIGHTS if by == "fixed" else learned()
    assert mainhtml.main_text(before + ARTICLE + after, weights) == TEXT


@pytest.mark.parametrize("by", ["fixed", "learned"])
@pytest.mark.parametrize("before,after", MISLEADING)
def test_misleading_names_keep_their_article(before, after, by):
    weights = WEIGHTS if by == "fixed" else learned()
    assert mainhtml.main_text(before + LONG + after, weights) == LONG_TEXT


def test_without_the_marks_of_articles():
    """Weights of marked pages find the articles of pages whose marks are taken away."""
    weights, same, n = learned(), 0, 0
    for (html,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        n += 1
        same += mainhtml.main_text(re.sub("<(/?)article>", r"<\1div>", html), weights) == truth(html)
    assert same >= 0.95 * n


def truth(html):
    """The article of the test pages: what their article element holds."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
    return " ".join(unescape(re.sub(r"<(?:/?(?:p|h1|br)\b)[^>]*>", " ", inner)).replace("<b>", "").replace("</b>", "").split())


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_pages(spark, scale):
    pages = spark.read.parquet(f"/root/testdata/sf{scale}/pages.parquet")
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    rows = mainhtml.extract(pages).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_region_is_the_best_one():
    html = AROUND[0][0] + ARTICLE + AROUND[0][1]
    parts = mainhtml.parts(html)
    score = [(WEIGHTS.get(p.kind, WEIGHTS["w:" if p.words else "t:"]) * (p.words or 1)) if p.words or p.kind[0] == "t" else 0.0 for p in parts]
    best = max(((sum(score[a:b]), -a, -b) for a in range(len(parts)) for b in range(a, len(parts) + 1)))
    a, b = -best[1], -best[2]
    assert " ".join(unescape("".join(p.text for p in parts[a:b] if p.shown)).split()) == mainhtml.main_text(html, WEIGHTS)


def test_weights_have_the_right_signs():
    assert all((v > 0) if k[0] == "w" else (v < 0) for k, v in mainhtml.weights_of({"w:x": (0, 90), "t:x": (90, 0)}).items())


def test_awkward(spark):
    html = ["", None, "plain words only", "<", "<p", "<<<>>>", "<p>unclosed <b>words &am", "<nav>only a menu</nav>", "&lt;p&gt; <script>x", "<article>" + "<p>long words</p>" * 20_000 + "</article>"]
    pages = spark.createDataFrame([(i, None, h, "x", "y") for i, h in enumerate(html)] + [(None, "u", "<p>null id</p>", "x", "y")] * 2, SCHEMA + ", text string, n_chars string")
    rows = {r.page_id: r for r in mainhtml.extract(pages).collect()}
    assert rows[0].text == rows[1].text == "" and rows[2].text == "plain words only" and rows[7].text == ""
    assert rows[9].n_chars == len("long words ") * 20_000 - 1 and rows[None].text == "null id"
    assert mainhtml.extract(pages).count() == len(html) + 2
    assert mainhtml.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "before",
    ["<head><title>T t t</title><script>var t='<p>';</script><body>", "<head><meta charset=x><title>T</title>", "<body><svg class='ad' width=1 />", "<body><math/>", "<body><video-player src=x></video-player>", "<body><iframe class=ad src=x>"],
)
def test_elements_without_end_tags(before):
    assert mainhtml.main_text(before + "<article>" + ARTICLE + "</article></body>", WEIGHTS) == TEXT


def test_unclosed_script_hides_the_rest():
    assert mainhtml.main_text("<article>" + ARTICLE + "</article><script>var more = 'words';<p>of it", WEIGHTS) == TEXT
