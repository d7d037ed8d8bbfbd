"""Geometry of boxes as column expressions. y grows downwards; a box is four DOUBLE columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirespark.functions.text import strip


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)

    @property
    def center_x(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def center_y(self) -> Column:
        return (self.y1 + self.y2) / 2


def box(of: str = "") -> Box:
    """The box of a row, or of an aliased side of a join, or of a struct."""
    at = f"{of}." if of else ""
    return Box(*(F.col(f"{at}{c}") for c in ("x1", "y1", "x2", "y2")))


def struct_box(value: Column) -> Box:
    return Box(*(value[c] for c in ("x1", "y1", "x2", "y2")))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 for touching boxes and for boxes without area."""
    wide, high = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    smaller = F.least(a.area, b.area)
    return F.when((wide > 0) & (high > 0) & (smaller > 0), wide * high / smaller).otherwise(F.lit(0.0))


def overlaps(a: Box, b: Box, threshold: float = 0.3) -> Column:
    return overlap_ratio(a, b) > threshold


def min_distance(a: Box, b: Box) -> Column:
    """0 for boxes that meet, else the gap along one axis, or the distance of the nearest corners."""
    dx = F.greatest(a.x1 - b.x2, b.x1 - a.x2, F.lit(0.0))
    dy = F.greatest(a.y1 - b.y2, b.y1 - a.y2, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def near(a: Box, b: Box, distance: float = 5.0) -> Column:
    return min_distance(a, b) < distance


def crosses(a: Box, x: Column) -> Column:
    return x.between(a.x1, a.x2)


def meets_rows(a: Box, y1: Column, y2: Column) -> Column:
    """The y ranges overlap; ends count."""
    return ~((a.y2 < y1) | (a.y1 > y2))


def in_dense_window(center: Box, other: Box, side: float = 30.0, threshold: float = 0.1) -> Column:
    """The other's center lies in the square around the center of the first, or they overlap."""
    cx, cy, h = center.center_x, center.center_y, side / 2
    window = Box(cx - h, cy - h, cx + h, cy + h)
    return (other.center_x.between(window.x1, window.x2) & other.center_y.between(window.y1, window.y2)) | overlaps(window, other, threshold)


def smart_resize(height: Column, width: Column, least: int = 512 * 28 * 28, most: int = 2048 * 28 * 28, patch: int = 28) -> tuple[Column, Column]:
    """(height, width) scaled into the range of pixels and rounded up to whole patches."""
    pixels = (height * width).cast("double")
    scale = F.when(pixels < least, F.sqrt(F.lit(float(least)) / pixels)).when(pixels > most, F.sqrt(F.lit(float(most)) / pixels))

    def one(v: Column) -> Column:
        scaled = F.coalesce((v * scale).cast("long"), v.cast("long"))
        return (F.floor((scaled + patch - 1) / patch) * patch).cast("long")

    return one(height), one(width)


def model_to_page(b: Box, model: tuple[Column, Column], image: tuple[Column, Column], page: tuple[Column, Column]) -> Box:
    """A box in model pixels, corners in any order, as a box on the page; sizes are (width, height)."""
    x1, x2 = (v / model[0] * image[0] for v in (b.x1, b.x2))
    y1, y2 = (v / model[1] * image[1] for v in (b.y1, b.y2))
    sx, sy = page[0] / image[0], page[1] / image[1]
    return Box(F.least(x1, x2) * sx, F.least(y1, y2) * sy, F.greatest(x1, x2) * sx, F.greatest(y1, y2) * sy)


def pixel_crop(b: Box, scale_x: Column, scale_y: Column, width: Column, height: Column) -> Box:
    """A page box in pixels: truncated, and clamped to the image."""
    return Box(F.greatest((b.x1 * scale_x).cast("int"), F.lit(0)), F.greatest((b.y1 * scale_y).cast("int"), F.lit(0)), F.least((b.x2 * scale_x).cast("int"), width), F.least((b.y2 * scale_y).cast("int"), height))


def too_small(b: Box, least: float = 15.0) -> Column:
    return (b.x2 - b.x1 <= least) | (b.y2 - b.y1 <= least)


def parse_box(text: Column) -> Box:
    """The first four numbers of a text, signs ignored; nulls unless all four parse."""
    found = F.regexp_extract_all(strip(text), F.lit(r"([\d.]+)"), F.lit(1))
    numbers = [F.get(found, k).try_cast("double") for k in range(4)]
    whole = numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull() & numbers[3].isNotNull()
    return Box(*(F.when(whole, v) for v in numbers))


def dpi_zoom(dpi: Column) -> Column:
    return dpi / 72.0


def rescaled(b: Box, width: Column, height: Column, to_width: Column, to_height: Column) -> Box:
    """A box of one image size on another one, in whole pixels."""
    return Box((b.x1 / width * to_width).cast("int"), (b.y1 / height * to_height).cast("int"), (b.x2 / width * to_width).cast("int"), (b.y2 / height * to_height).cast("int"))


def line_box(sx: Column, sy: Column, ex: Column, ey: Column) -> Box:
    return Box(F.least(sx, ex), F.least(sy, ey), F.greatest(sx, ex), F.greatest(sy, ey))
