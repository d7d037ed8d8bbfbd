"""Page images: rasters of documents, slices cut from them, and other formats as JPEG, by functions that the caller names.

The default ones need PyMuPDF or Pillow, imported where they run. What fails becomes a row with its error.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (content, zoom) -> (JPEG, width, height) of each page.
Renderer = Callable[[bytes, float], list[tuple[bytes, int, int]]]
RASTER = pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
RASTER_SQL = "path string, page_number int, width int, height int, content binary, error string"


def pymupdf_renderer(content: bytes, zoom: float) -> list[tuple[bytes, int, int]]:
    import fitz  # PyMuPDF

    out = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            made = page.get_pixmap(matrix=fitz.Matrix(zoom, zoom))
            out.append((made.tobytes("jpeg"), made.width, made.height))
    return out


def rasters(files: DataFrame, dpi: float = 150.0, render: Renderer = pymupdf_renderer) -> DataFrame:
    """(path, page_number, width, height, content, error) of files (path, content): a page a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                try:
                    rows = [(path.as_py(), k, w, h, jpeg, None) for k, (jpeg, w, h) in enumerate(render(content.as_py(), dpi / 72.0), 1)]
                except Exception as e:
                    rows = [(path.as_py(), None, None, None, None, f"{type(e).__name__}: {e}")]
                for row in rows:  # one page a batch: pages may be large
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, RASTER, strict=True)], schema=RASTER)

    return files.select("path", "content").mapInArrow(run, RASTER_SQL)


def pillow_crop(content: bytes, box: tuple[int, int, int, int]) -> bytes:
    from PIL import Image

    out = io.BytesIO()
    Image.open(io.BytesIO(content)).crop(box).save(out, "JPEG", quality=95, dpi=(300, 300))
    return out.getvalue()


def pillow_jpeg(content: bytes) -> bytes:
    """Any image as JPEG; transparency becomes white."""
    from PIL import Image

    found = Image.open(io.BytesIO(content))
    if found.mode in ("RGBA", "LA", "P"):
        found = found.convert("RGBA")
        ground = Image.new("RGB", found.size, "white")
        ground.paste(found, mask=found.split()[-1])
        found = ground
    out = io.BytesIO()
    found.convert("RGB").save(out, "JPEG", quality=95)
    return out.getvalue()


def _applied(rows: DataFrame, name: str, function: Callable[..., bytes], *columns: str) -> DataFrame:
    """rows with `name`: the function of the columns, or null, and why."""

    @F.udf("struct<value: binary, error: string>", useArrow=True)
    def run(*values):
        try:
            return {"value": function(*values), "error": None}
        except Exception as e:
            return {"value": None, "error": f"{type(e).__name__}: {e}"}

    made = rows.withColumn("__made", run(*map(F.col, columns)))
    return made.withColumns({name: F.col("__made.value"), f"{name}_error": F.col("__made.error")}).drop("__made")


def cut_slices(slices: DataFrame, pages: DataFrame, page: str = "page", crop: Callable[[bytes, tuple[int, int, int, int]], bytes] = pillow_crop) -> DataFrame:
    """Kept slices (page, px1, py1, px2, py2, ...) with `image`, cut from the pages' images (page, content)."""
    rows = slices.filter(~F.col("discarded")).join(pages.select(page, "content"), page)
    return _applied(rows, "image", lambda content, *box: crop(bytes(content), tuple(box)), "content", "px1", "py1", "px2", "py2").drop("content")


def as_jpeg(images: DataFrame, convert: Callable[[bytes], bytes] = pillow_jpeg) -> DataFrame:
    """images (content, ...) with `jpeg`."""
    return _applied(images, "jpeg", lambda content: convert(bytes(content)), "content")
