"""HTML pages as rows of nodes.

The tree keeps what the page says: an end tag closes the nearest open element of its name and all within it, void
elements close at once, and no end tag is implied, so an unclosed paragraph holds what follows it. Text is taken without
scripts, styles and comments. Parsing is one Python pass per page, in Arrow batches; everything after it is columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.names import unused

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = ("ol", "ul")
#: Element names that become blocks, and those that statistics count.
BLOCKS = (*HEADINGS, "p", "div", "address", "img", "table", *LISTS)
COUNTED = (*HEADINGS, "p", "div", "img", "table", *LISTS)


class Node:
    """An element: children are elements and strings."""

    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            one = stack.pop()
            if isinstance(one, str):
                out.append(one)
            elif isinstance(one, Node) and one.name not in HIDDEN:
                stack.extend(reversed(one.children))
        return "".join(out)

    def above(self, *names: str) -> Node | None:
        node = self.parent
        while node is not None and node.name not in names:
            node = node.parent
        return node

    def markup(self) -> str:
        """The element written out again; a loop, as pages may be deep."""
        out: list[str] = []
        stack: list[Node | str | tuple[str]] = [self]
        while stack:
            one = stack.pop()
            if isinstance(one, tuple):
                out.append(one[0])
            elif isinstance(one, str):
                out.append(escape(one, quote=False))
            else:
                attributes = "".join(f' {k}="{escape(v)}"' for k, v in one.attributes.items())
                if one.name in VOID:
                    out.append(f"<{one.name}{attributes}/>")
                else:
                    out.append(f"<{one.name}{attributes}>")
                    stack.append((f"</{one.name}>",))
                    stack.extend(reversed(one.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# ---- rows of blocks ----


def table_grid(table: Node) -> tuple[list[list[str]], list[str]]:
    """(cells by row, each row as wide as the widest; the rows' bbox). Spanning cells are repeated in every place they take up."""
    rows = [n for n in table.walk() if n.name == "tr"]
    taken: dict[tuple[int, int], str] = {}
    widest = 0
    for r, row in enumerate(rows):
        c = 0
        for cell in (n for n in row.walk() if n.name in ("td", "th")):
            while (r, c) in taken:
                c += 1
            text = cell.text().strip()
            down, right = int(cell.attributes.get("rowspan") or 1), int(cell.attributes.get("colspan") or 1)
            taken.update({(i, j): text for i in range(r, r + down) for j in range(c, c + right)})
            c += right
            widest = max(widest, c)
    height = max([len(rows), *(r + 1 for r, _ in taken)])
    wide = max([widest, *(c + 1 for _, c in taken)]) if taken else widest
    grid = [[taken.get((r, c), "") for c in range(max(widest, max((j + 1 for i, j in taken if i == r), default=0)))] for r in range(height)] if wide else [[] for _ in range(height)]
    return grid, [row.attributes.get("data-bbox", "") for row in rows] + [""] * (height - len(rows))


def _inside(node: Node, root: Node, consumed: set[int]) -> bool:
    return id(node) in consumed or (node.name not in ("table", *LISTS) and node.above("table", *LISTS) is not None)


BLOCK = pa.struct(
    [("ord", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("bbox", pa.string()), ("text", pa.string()), ("classes", pa.list_(pa.string())), ("in_address", pa.bool_()), ("alt", pa.string()), ("src", pa.string()), ("start", pa.string()), ("error", pa.string()),
     ("rows", pa.list_(pa.struct([("bbox", pa.string()), ("cells", pa.list_(pa.string()))]))), ("items", pa.list_(pa.struct([("bbox", pa.string()), ("text", pa.string())])))]
)
BLOCK_SQL = "struct<ord int, kind string, tag string, bbox string, text string, classes array<string>, in_address boolean, alt string, src string, start string, error string, rows array<struct<bbox string, cells array<string>>>, items array<struct<bbox string, text string>>>"


def blocks(html: str | None) -> list[dict]:
    """The page's blocks in order, one each: heading, paragraph, formula, abstract, image, table or list. What a table, list or abstract has taken in isn't listed again."""
    root, out = parse(html), []
    consumed: set[int] = set()
    for node in root.walk():
        if node.name not in BLOCKS or _inside(node, root, consumed):
            continue
        row = {"tag": node.name, "bbox": node.attributes.get("data-bbox", ""), "classes": node.classes, "text": None}
        if node.name in HEADINGS:
            row |= {"kind": "heading", "text": node.text().strip()}
        elif node.name == "p":
            row |= {"kind": "paragraph", "text": node.text().strip(), "in_address": node.parent is not None and node.parent.name == "address"}
            if not row["text"]:
                continue
        elif node.name == "div" and "formula" in row["classes"]:
            inner = next((n for n in node.walk() if n.name == "div"), None)
            row |= {"kind": "formula", "text": inner.text().strip() if inner is not None else None}
        elif node.name == "div" and "abstract" in row["classes"]:
            row |= {"kind": "abstract", "text": node.text().strip()}
            consumed.update(id(n) for n in node.walk())
        elif node.name == "img":
            box = node.above("div")
            if box is not None and "formula" in box.classes:
                continue
            row |= {"kind": "image", "alt": node.attributes.get("alt", "Image"), "src": node.attributes.get("src", "")}
        elif node.name == "table":
            row["kind"] = "table"
            try:
                grid, boxes = table_grid(node)
                has_rows = any(n.name == "tr" for n in node.walk())
                row["rows"] = [{"bbox": b, "cells": cells} for cells, b in zip(grid, boxes, strict=True)] if has_rows else []
            except ValueError as e:
                row["error"] = str(e)
            consumed.update(id(n) for n in node.walk())
        elif node.name in LISTS:
            row |= {"kind": "list", "start": node.attributes.get("start", "")}
            items = [c for c in node.children if isinstance(c, Node) and c.name == "li"]
            try:
                int(row["start"] or 1)
                row["items"] = [{"bbox": i.attributes.get("data-bbox", ""), "text": i.text().strip()} for i in items]
            except ValueError as e:
                row["error"] = str(e)
            consumed.update(id(n) for n in node.walk())
        else:
            continue
        out.append(row | {"ord": len(out)})
    return out


def statistics(html: str | None) -> dict[str, int]:
    """Counts of a page's elements, nested ones too."""
    out = dict.fromkeys(("total_elements", "headings", "paragraphs", "formulas", "images", "tables", "lists"), 0)
    for node in parse(html).walk():
        if node.name in COUNTED:
            out["total_elements"] += 1
            kind = "headings" if node.name in HEADINGS else {"p": "paragraphs", "img": "images", "table": "tables", "ol": "lists", "ul": "lists"}.get(node.name)
            if node.name == "div" and "formula" in node.classes:
                kind = "formulas"
            if kind:
                out[kind] += 1
    return out


def records(html: str | None) -> list[dict]:
    """type, bbox, text (200 characters at most), class, parent_class of every counted element."""
    return [{"type": n.name, "bbox": n.attributes.get("data-bbox", ""), "text": n.text().strip()[:200], "class": n.classes, "parent_class": n.parent.classes if n.parent is not None else []} for n in parse(html).walk() if n.name in COUNTED]


def bbox_blocks(html: str | None) -> list[dict]:
    """Elements with a data-bbox of four numbers: tag_name, bbox_str, text (100 characters at most), original_index, and whether another one holds it."""
    out = []
    for n in parse(html).walk():
        value = n.attributes.get("data-bbox")
        if value is None:
            continue
        try:
            numbers = [float(x) for x in re.findall(r"[\d.]+", value)[:4]]
        except ValueError:
            continue
        if len(numbers) == 4:
            out.append(dict(zip(("x1", "y1", "x2", "y2"), numbers, strict=True)) | {"tag_name": n.name, "bbox_str": value, "text": n.text().strip()[:100], "original_index": len(out), "markup": n.markup()})
    return out


#: Fixed values of cleaning: attributes that go, classes that are formulas, classes whose elements are emptied.
POSITIONS, FORMULAS, EMPTIED = ("data-bbox", "data-polygon"), ("formula.machine_printed", "formula.handwritten"), ("music sheet", "chemical formula", "chart")
COLOR = re.compile(r"\bcolor:[^;]+;?")


def cleaned(html: str | None) -> str:
    """A page without colors and positions, with formula classes made one, and image captions, scores, structures and charts emptied, as a fenced block."""
    root = parse(html)
    for n in root.walk():
        if n.attributes.get("style"):
            style = COLOR.sub("", n.attributes["style"])
            if style.strip():
                n.attributes["style"] = style.rstrip(";")
            else:
                del n.attributes["style"]
        for name in POSITIONS:
            n.attributes.pop(name, None)
        if n.classes:
            n.attributes["class"] = " ".join(dict.fromkeys("formula" if c in FORMULAS else c for c in n.classes))
        whole = n.attributes.get("class", "")
        if n.name == "div" and whole == "image caption":
            n.children, n.attributes["class"] = [], "image"
        elif whole in EMPTIED or "chart" in n.classes:
            n.children = []
            n.attributes.pop("format", None)
    body = next((n for n in root.walk() if n.name == "body"), None)
    children = body.children if body is not None else []
    inside = " ".join(x for c in children for x in (c.markup() if isinstance(c, Node) else str(c), "\n"))
    return f"```html\n<html><body>\n{inside}</body></html>\n```"


def with_sources(html: str | None, sources: dict[int, str]) -> str:
    """The page with the n-th image's source from `sources`; images without one stay as they are."""
    root = parse(html)
    for k, n in enumerate((n for n in root.walk() if n.name == "img"), 1):
        if k in sources:
            n.attributes["src"] = sources[k]
    return "".join(c.markup() if isinstance(c, Node) else escape(c, quote=False) for c in root.children)


# ---- DataFrame operators ----


def _mapped(pages: DataFrame, html: str, function: Callable[[str | None], object], arrow: pa.DataType, sql: str, name: str) -> DataFrame:
    """pages with a column of what a function makes of each page, by batches, instead of the HTML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, arrow)], names=[*batch.schema.names[:-1], name])

    kept = [c for c in pages.columns if c != html]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` {sql}"])
    return pages.select(*kept, html).mapInArrow(run, schema)


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a row for each block (ord, kind, tag, ...) instead of the HTML."""
    kept, name = [c for c in pages.columns if c != html], unused(pages, "blocks")
    return _mapped(pages, html, blocks, pa.list_(BLOCK), f"array<{BLOCK_SQL}>", name).select(*kept, F.explode(name).alias(unused(pages, "block"))).select(*kept, f"{unused(pages, 'block')}.*")


#: Names of a page's statistics.
STATISTICS = ("total_elements", "headings", "paragraphs", "formulas", "images", "tables", "lists")


def page_statistics(pages: DataFrame, html: str = "html") -> DataFrame:
    kept, name = [c for c in pages.columns if c != html], unused(pages, "found")
    return _mapped(pages, html, statistics, pa.struct([(n, pa.int64()) for n in STATISTICS]), "struct<" + ", ".join(f"{n}: bigint" for n in STATISTICS) + ">", name).select(*kept, f"{name}.*")


def totals(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return stats.groupBy(*by).agg(F.count("*").alias("total_pages"), *(F.sum(n).alias(n if n.startswith("total_") else f"total_{n}") for n in STATISTICS))


def element_records(pages: DataFrame, html: str = "html") -> DataFrame:
    kept, name = [c for c in pages.columns if c != html], unused(pages, "found")
    texts = pa.list_(pa.string())
    arrow = pa.list_(pa.struct([("type", pa.string()), ("bbox", pa.string()), ("text", pa.string()), ("class", texts), ("parent_class", texts)]))
    found = _mapped(pages, html, records, arrow, "array<struct<type: string, bbox: string, text: string, class: array<string>, parent_class: array<string>>>", name)
    return found.select(*kept, F.posexplode(name).alias("ord", f"{name}_")).select(*kept, "ord", f"{name}_.*")


def positioned_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    kept, name = [c for c in pages.columns if c != html], unused(pages, "found")
    arrow = pa.list_(pa.struct([*((c, pa.float64()) for c in ("x1", "y1", "x2", "y2")), *((c, pa.string()) for c in ("tag_name", "bbox_str", "text")), ("original_index", pa.int32()), ("markup", pa.string())]))
    found = _mapped(pages, html, bbox_blocks, arrow, "array<struct<x1: double, y1: double, x2: double, y2: double, tag_name: string, bbox_str: string, text: string, original_index: int, markup: string>>", name)
    return found.select(*kept, F.explode(name).alias(f"{name}_")).select(*kept, f"{name}_.*")


def clean_html(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([cleaned(t) for t in texts], dtype=object)

    return run(html)


def insert_sources(pages: DataFrame, images: DataFrame, page: str = "page", html: str = "html") -> DataFrame:
    """pages with the sources of images (page, img_ord, path): a left join on the page, so that pages without images stay."""
    sources = unused(pages, "sources")
    by_page = images.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct(F.col("img_ord").cast("int"), "path"))).alias(sources))

    @F.udf("string", useArrow=True)
    def rewritten(text, sources):
        return text if not sources else with_sources(text, dict(sources))

    return pages.join(by_page, page, "left").withColumn(html, rewritten(F.col(html), F.col(sources))).select(*pages.columns)


def image_index(paths: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """(page, img_ord, path) of extracted images by their file names {prefix}_page_{page}_{ord}.{ext}."""
    name = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    pattern = rf"^{re.escape(prefix)}_page_(\d+)_(\d+)\.(?:jpg|jpeg|png|gif|bmp)"
    return paths.filter(name.rlike(pattern)).select(F.regexp_extract(name, pattern, 1).cast("int").alias("page"), F.regexp_extract(name, pattern, 2).cast("int").alias("img_ord"), F.col(path).alias("path"))


def reordered_page(blocks_in_order: DataFrame, page: str = "page_id") -> DataFrame:
    """Pages written again with each positioned block once, by read_ord."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_ord", "markup"))), lambda b: b["markup"]), "\n")
    return blocks_in_order.groupBy(page).agg(F.concat(F.lit("<html><body>\n"), body, F.lit("\n</body></html>")).alias("html"))
