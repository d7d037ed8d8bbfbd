"""Main text of web pages by maximum-scoring subsequence segmentation.

A page is a sequence of words and tags. Words score positive and tags negative, by weights learned from labelled pages:
the log odds of a word (by the element that holds it) or a tag to lie in the article. One linear scan finds
the contiguous region of greatest score, and its text is the page's main text.

Within the region some elements are no article: menus, adverts, forms, comments and the like. A name (element, role, class)
only makes an element a candidate. It is left out if its name says nothing else and it doesn't hold the bulk of
the page's prose; where the name says other things too ("legal-news", "ad-free"), if its own words and tags
score less than a paragraph of LEAST words.

Labelled pages are those that mark their article with an article or main element; weights are counted on at most
`rows` of them (least hash of page_id). The fixed counts below are used for kinds of words and tags that these don't show.

Defined results: a null or empty page has an empty text; a page without words in its region too; equal rows get
equal texts; an empty table gives no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in a page.
RAW = "script style textarea noscript template svg math iframe object canvas select video audio title".split()
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_ARTICLE = frozenset("nav footer aside form menu dialog button fieldset label".split())
MARKED = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id and role that name an element that is no article; those of the second set hold whole articles of others.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing toolbar pagination pager widget search copyright legal disclaimer masthead topbar complementary contentinfo".split())
FOREIGN = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended recommendations teaser teasers".split())
#: Fixed counts, as if seen in labelled pages: (inside, outside) of words by element and of tags.
SEEN = {"w:p": (400, 40), "w:h1": (30, 10), "w:h2": (30, 10), "w:h3": (20, 10), "w:blockquote": (30, 5), "w:pre": (30, 5), "w:li": (40, 15), "w:td": (30, 15), "w:div": (60, 60), "w:section": (40, 40), "w:article": (60, 10), "w:a": (5, 40), "w:hint": (1, 80), "t:p": (60, 20), "t:br": (20, 10), "t:div": (10, 40), "t:h1": (20, 10), "t:h2": (20, 10), "t:h3": (20, 10), "t:ul": (20, 10), "t:ol": (20, 10), "t:li": (20, 10), "t:blockquote": (20, 10), "t:pre": (20, 10), "t:table": (20, 15), "t:tr": (20, 15), "t:td": (20, 15), "t:b": (20, 10), "t:i": (20, 10), "t:em": (20, 10), "t:strong": (20, 10), "t:span": (20, 20), "t:a": (10, 20), "t:hint": (1, 40), "t:article": (1, 20), "t:main": (1, 20), "t:body": (1, 20)}
#: Parts of names that tell of a page's layout, not of the element ("has-sidebar").
ABOUT = frozenset("no not has with without".split())
#: Parts of names that say where or how an element stands, and leave the meaning to the other parts.
NEUTRAL = frozenset("a all area article bar block blocks body bottom box btn button buttons center column container content control entry fixed form global group header inner item items left link links list main middle mini outer page panel post primary right row secondary section site slot small story sticky sub the top unit wide wrap wrapper ui".split())
#: Elements that hold whole pages at times; shares of the page's prose that make one, or an element with a telling name, a wrapper; words.
HOLDERS, HALF, BULK, LEAST = frozenset("form fieldset label button dialog menu header".split()), 0.5, 0.8, 30
ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
#: Without an end tag only a script, a style or a text area goes on to the end of the page; svg and math may be empty.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?!(?:svg|math)(?=[\s/>])" + ATTRIBUTES + r"/>)((script|style|textarea)|" + "|".join(RAW[3:]) + r")(?=[\s/>])" + ATTRIBUTES + r">(?:.*?</\1\s*>|(?(2).*\Z|(?!)))|<(/?)([a-zA-Z][^\s/>]*)(" + ATTRIBUTES + r")>|<(?=[/!?a-zA-Z])[^<>]*\Z|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Part(NamedTuple):
    """A text or a tag. kind: its weight's name; shown: it isn't in an element that is no article."""

    kind: str
    words: int
    text: str
    shown: bool
    marked: bool


class Name(NamedTuple):
    """What class, id and role say. telling: a hint and nothing else; vague: a hint among other words; foreign: of others' articles."""

    telling: bool = False
    vague: bool = False
    foreign: bool = False


def named(attributes: str) -> Name:
    telling = vague = foreign = False
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            for token in (m[2] or m[3] or m[4] or "").split():
                words = {p.lower() for p in PARTS.findall(token)}
                hints = words & (HINTS | FOREIGN)
                if not hints or words & ABOUT:
                    continue
                if words - hints <= NEUTRAL:
                    telling = True
                    foreign = foreign or bool(hints & FOREIGN)
                else:
                    vague = True
    return Name(telling, vague, foreign)


class Candidate(NamedTuple):
    """An element that may be no article, from one part to before another."""

    first: int
    end: int
    element: str
    name: Name


def _sequence(html: str) -> tuple[list[Part], list[Candidate], list[bool]]:
    """The page's texts and tags in order, the elements that may be no article, and whether a part is of a heading of the article.

    An element ends with its own end tag, a paragraph or list item with the next block, or else with the page.
    """
    out: list[Part] = []
    heads: list[bool] = []
    opened: dict[str, list[int]] = {}  # by name, the open elements: a candidate's place, or -1
    found: list[list] = []
    loose: list[int] = []  # candidates that the next block ends
    block, link = "body", 0
    marked = heading = 0
    for m in TOKEN.finditer(html):
        name = m[4]
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                out.append(Part("w:a" if link else "w:" + block, len(text.split()), text, True, bool(marked)))
                heads.append(bool(marked and heading))
            elif m[1]:
                out.append(Part("t:raw", 0, " ", True, bool(marked)))
                heads.append(False)
            continue
        name, closing = name.lower(), bool(m[3])
        is_block = name in BLOCKS
        if is_block and loose:
            for c in loose:
                if found[c][1] is None:
                    found[c][1] = len(out) + (closing and name == found[c][2])
            loose.clear()
        its = Name()
        if closing:
            if opened.get(name) and (c := opened[name].pop()) >= 0 and found[c][1] is None:
                found[c][1] = len(out) + 1
        elif name not in VOID and name not in RAW and name not in ("html", "head", "body"):  # here a raw element has no end tag
            its = named(m[5])
            c = -1
            if name in NOT_ARTICLE or name == "header" or its.foreign or ((its.telling or its.vague) and name not in MARKED and name not in HEADINGS):
                c = len(found)
                found.append([len(out), None, name, its])
                if name in ("p", "li"):
                    loose.append(c)
            opened.setdefault(name, []).append(c)
        if name in MARKED and not its.foreign:
            marked = max(0, marked + (-1 if closing else 1))
        if name in HEADINGS:
            heading = 0 if closing else 1
        if name == "a":
            link = 0 if closing else 1
        elif is_block:
            link = 0
            if name != "br":
                block = "body" if closing else name
        out.append(Part("t:" + name, 0, " " if is_block else "", True, bool(marked) and name not in MARKED))
        heads.append(False)
    return out, [Candidate(a, len(out) if b is None else b, e, n) for a, b, e, n in found], heads


def parts(html: str, weights: dict[str, float] | None = None) -> list[Part]:
    """The page's texts and tags in order; those in elements that are no article aren't shown, and are of the kind `hint`."""
    weights = weights or weights_of({})
    out, candidates, heads = _sequence(html)
    if not candidates:
        return out
    prose, links, value = [0], [0], [0.0]
    marks = [k for k, p in enumerate(out) if p.kind in ("t:article", "t:main") and p.kind[2:] in MARKED]
    for p in out:
        word = p.words > 0
        prose.append(prose[-1] + (p.words if word and p.kind != "w:a" else 0))
        links.append(links[-1] + (p.words if word and p.kind == "w:a" else 0))
        value.append(value[-1] + score(p, weights))
    least = LEAST * weights.get("w:p", weights["w:"])
    until = 0
    for first, end, element, name in candidates:
        if first < until:
            continue
        foreign = name.foreign
        own = prose[end] - prose[first]
        if element not in NOT_ARTICLE and element != "header" and not name.telling:  # a vague name: its words decide
            if value[end] - value[first] >= least and own > links[end] - links[first]:
                continue
        elif not foreign and own >= LEAST and own > (HALF if element in HOLDERS and not name.telling else BULK) * prose[-1] and element not in ("nav", "footer", "aside"):
            continue  # a wrapper of the page
        if not foreign and (element not in NOT_ARTICLE) and (at := bisect_right(marks, first)) < len(marks) and marks[at] < end:
            end = marks[at]  # a wrapper with a misleading name
        for k in range(first, end):
            p = out[k]
            if p.kind[0] == "t":
                out[k] = p._replace(kind="t:hint", shown=True)
            elif not (element == "header" and heads[k]):
                out[k] = p._replace(kind="w:hint", shown=False)
        if element not in ("p", "li") and end < len(out) and out[end - 1].kind == "t:hint":
            out[end - 1] = out[end - 1]._replace(text=" " if element in BLOCKS else out[end - 1].text)
        until = end
    return out


def score(p: Part, weights: dict[str, float]) -> float:
    """What a part adds to a region."""
    if p.words:
        return weights.get(p.kind, weights["w:"]) * p.words
    return weights.get(p.kind, weights["t:"]) if p.kind[0] == "t" else 0.0


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The text of the region of greatest score; the first one of equal ones."""
    found = parts(html or "", weights)
    best = total = 0.0
    start = a = b = 0
    for k, p in enumerate(found):
        total += score(p, weights)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, a, b = total, start, k + 1
    return " ".join(unescape("".join(p.text for p in found[a:b] if p.shown)).split())


def weights_of(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log odds of the counts (inside, outside) by kind: positive for words, negative for tags. SEEN has those of kinds without counts."""
    out = {"w:": 0.5, "t:": -1.0}
    for kind, (inside, outside) in {**SEEN, **counts}.items():
        odds = math.log((inside + 1) / (outside + 1))
        out[kind] = max(0.01, odds) if kind[0] == "w" else min(-0.05, odds)
    return out


def counted(html: str | None) -> tuple[Counter, Counter]:
    """Words and tags by kind, (inside, outside) of the marked article; none if the page marks nothing."""
    found = parts(html or "")
    inside, outside = Counter(), Counter()
    if any(p.marked for p in found):
        for p in found:
            if n := p.words or p.kind[0] == "t":
                (inside if p.marked and p.kind not in ("w:hint", "t:hint") else outside)[p.kind] += n
    return inside, outside


def fit(pages: DataFrame, rows: int = 512) -> dict[str, float]:
    """Weights from at most `rows` pages that mark their article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for html in batch.column(0):
                a, b = counted(html.as_py())
                inside += a
                outside += b
        kinds = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "inside", "outside"])

    some = pages.select("page_id", "html")
    ids = some.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(rows)
    sample = some.join(F.broadcast(ids.distinct()), "page_id").select("html")  # at most `rows` ids
    counts = sample.mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return weights_of({r.kind: (r.inside, r.outside) for r in counts.collect()})


def extract(pages: DataFrame, rows: int = 512) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = fit(pages, rows)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), weights) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


#: For pages whose article is what their article element holds, and holds no more than headings, paragraphs and inline tags.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
