"""PDF documents as tables, by a reader that the caller names.

A reader is a function of a file's bytes that returns what the file holds (see Document). The default one needs PyMuPDF,
which is imported where it runs; without it a file becomes an error row, as a broken file does, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Document(TypedDict):
    """info: title, author, created, modified. pages: number, width, height, blocks (block_type, box, lines), drawings (kind, points, box). images: page_number, img_ord, format, width, height, content."""

    info: dict[str, str]
    pages: list[dict]
    images: list[dict]


Reader = Callable[[bytes], Document]
SPAN = pa.struct([("text", pa.string())])
LINE = pa.struct([("spans", pa.list_(SPAN))])
XYXY = [(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]
BLOCK = pa.struct([("block_ord", pa.int32()), ("block_type", pa.int32()), *XYXY, ("lines", pa.list_(LINE))])
DRAWING = pa.struct([("line_ord", pa.int32()), ("kind", pa.string()), *((c, pa.float64()) for c in ("sx", "sy", "ex", "ey")), *XYXY])
PAGE = pa.struct([("page_number", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("blocks", pa.list_(BLOCK)), ("drawings", pa.list_(DRAWING))])
IMAGE = pa.struct([("page_number", pa.int32()), ("img_ord", pa.int32()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary())])
FILE = pa.schema([("path", pa.string()), ("info", pa.map_(pa.string(), pa.string())), ("pages", pa.list_(PAGE)), ("images", pa.list_(IMAGE)), ("error", pa.string())])
FILE_SQL = (
    "path string, info map<string, string>, "
    "pages array<struct<page_number int, width double, height double, blocks array<struct<block_ord int, block_type int, x1 double, y1 double, x2 double, y2 double, lines array<struct<spans array<struct<text string>>>>>>, "
    "drawings array<struct<line_ord int, kind string, sx double, sy double, ex double, ey double, x1 double, y1 double, x2 double, y2 double>>>>, "
    "images array<struct<page_number int, img_ord int, format string, width int, height int, content binary>>, error string"
)


def pymupdf_reader(content: bytes) -> Document:
    import fitz  # PyMuPDF

    names = ("x1", "y1", "x2", "y2")
    with fitz.open(stream=content, filetype="pdf") as doc:
        info = {k: str(v) for k, v in (doc.metadata or {}).items() if v}
        pages, images = [], []
        for number, page in enumerate(doc, 1):
            blocks = [{"block_ord": k, "block_type": b["type"], **dict(zip(names, b["bbox"], strict=True)), "lines": [{"spans": [{"text": s["text"]} for s in line["spans"]]} for line in b.get("lines", [])]} for k, b in enumerate(page.get_text("dict")["blocks"])]
            drawings = []
            for path in page.get_drawings():
                for item in path["items"]:
                    if item[0] == "l":
                        (sx, sy), (ex, ey) = item[1], item[2]
                        drawings.append({"line_ord": len(drawings), "kind": "line", "sx": sx, "sy": sy, "ex": ex, "ey": ey, "x1": min(sx, ex), "y1": min(sy, ey), "x2": max(sx, ex), "y2": max(sy, ey)})
                    elif item[0] == "re":
                        r = item[1]
                        drawings.append({"line_ord": len(drawings), "kind": "rect", "x1": r.x0, "y1": r.y0, "x2": r.x1, "y2": r.y1})
            pages.append({"page_number": number, "width": page.rect.width, "height": page.rect.height, "blocks": blocks, "drawings": drawings})
            for k, found in enumerate(page.get_images(full=True), 1):
                try:
                    one = doc.extract_image(found[0])
                except Exception:  # a broken image is left out
                    continue
                images.append({"page_number": number, "img_ord": k, "format": one["ext"], "width": one["width"], "height": one["height"], "content": one["image"]})
    return {"info": info, "pages": pages, "images": images}


def documents(files: DataFrame, reader: Reader = pymupdf_reader) -> DataFrame:
    """(path, info, pages, images, error) of files (path, content), such as those of the binaryFile source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                row = {"path": path.as_py(), "info": None, "pages": None, "images": None, "error": None}
                try:
                    found = reader(content.as_py())
                    row |= {"info": list(found["info"].items()), "pages": found["pages"], "images": found["images"]}
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=FILE)

    return files.select("path", "content").mapInArrow(run, FILE_SQL)


def page_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.explode("pages").alias("p")).select("path", "p.page_number", "p.width", "p.height")


def page_items(docs: DataFrame) -> DataFrame:
    """Text and image blocks: (path, page_number, block_ord, block_type, x1, y1, x2, y2, lines)."""
    return docs.select("path", F.explode("pages").alias("p")).select("path", "p.page_number", F.explode("p.blocks").alias("b")).select("path", "page_number", "b.*")


def page_lines(docs: DataFrame) -> DataFrame:
    """Lines and rectangles that are drawn: (path, page_number, line_ord, kind, sx, sy, ex, ey, x1, y1, x2, y2)."""
    return docs.select("path", F.explode("pages").alias("p")).select("path", "p.page_number", F.explode("p.drawings").alias("d")).select("path", "page_number", "d.*")


def original_lines(lines: DataFrame) -> DataFrame:
    """Lines as elements, numbered from 0 within the page."""
    from pyspark.sql import Window

    order = Window.partitionBy("path", "page_number").orderBy("line_ord")
    return lines.select("path", "page_number", (F.row_number().over(order) - 1).alias("idx"), F.lit("original_line").alias("type"), F.col("kind").alias("line_type"), "x1", "y1", "x2", "y2")


def info(docs: DataFrame) -> DataFrame:
    names = {"title": "title", "author": "author", "creationDate": "created", "modDate": "modified"}
    return docs.select("path", F.size("pages").alias("pages"), *(F.try_element_at("info", F.lit(k)).alias(v) for k, v in names.items()), "error")


def images(docs: DataFrame) -> DataFrame:
    """Embedded images: (path, page_number, img_ord, format, width, height, content)."""
    return docs.select("path", F.explode("images").alias("i")).select("path", "i.*")
