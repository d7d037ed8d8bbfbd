"""Scalar expressions against hand-derived values and plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from quirespark.functions import geometry as G
from quirespark.functions import text as T


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def lit_box(*v):
    return G.Box(*(F.lit(float(x)) for x in v))


@pytest.mark.parametrize("a,b,want", [((0, 0, 10, 10), (5, 5, 25, 25), False), ((0, 0, 10, 10), (4, 4, 30, 30), True), ((0, 0, 10, 10), (10, 0, 20, 10), False), ((0, 0, 0, 10), (0, 0, 10, 10), False)])
def test_overlaps(spark, a, b, want):
    assert one(spark, G.overlaps(lit_box(*a), lit_box(*b)))[0] is want


def test_min_distance_is_strict(spark):
    a, b = lit_box(0, 0, 10, 10), lit_box(13, 14, 20, 20)
    assert tuple(one(spark, G.min_distance(a, b), G.near(a, b))) == (5.0, False)
    assert one(spark, G.min_distance(a, lit_box(12, 3, 20, 5)))[0] == 2.0


@pytest.mark.parametrize("h,w,want", [(2200, 1700, (1456, 1120)), (100, 100, (644, 644)), (1000, 1000, (1008, 1008))])
def test_smart_resize(spark, h, w, want):
    assert tuple(one(spark, *G.smart_resize(F.lit(h), F.lit(w)))) == want


def test_pixels_and_small_regions(spark):
    crop = G.pixel_crop(lit_box(306, -5, 700, 10), F.lit(2550 / 612), F.lit(3300 / 792), F.lit(2550), F.lit(3300))
    assert tuple(one(spark, *crop)) == (1275, 0, 2550, 41)
    assert tuple(one(spark, G.too_small(lit_box(0, 0, 15, 99)), G.too_small(lit_box(0, 0, 15.1, 99)))) == (True, False)


@pytest.mark.parametrize("text,want", [("10, 20 30,40", (10, 20, 30, 40)), ("-5 1 2 3", (5, 1, 2, 3)), ("1 2 3", (None,) * 4), ("1.2.3 1 1 1", (None,) * 4), ("", (None,) * 4), ("1 2 3 4 5", (1, 2, 3, 4))])
def test_parse_box(spark, text, want):
    assert tuple(one(spark, *G.parse_box(F.lit(text)))) == want


def test_model_to_page_swaps_corners(spark):
    size = (F.lit(100.0), F.lit(200.0))
    assert tuple(one(spark, *G.model_to_page(lit_box(80, 20, 10, 10), size, size, (F.lit(50.0), F.lit(100.0))))) == (5, 5, 40, 10)


def test_other_geometry(spark):
    row = one(spark, G.dpi_zoom(F.lit(300)), G.crosses(lit_box(0, 0, 5, 5), F.lit(5.0)), G.meets_rows(lit_box(0, 0, 5, 5), F.lit(5.0), F.lit(6.0)), G.in_dense_window(lit_box(0, 0, 20, 20), lit_box(10, 10, 30, 10)))
    assert math.isclose(row[0], 300 / 72) and row[1:] == (True, True, True)
    assert tuple(one(spark, *G.line_box(*(F.lit(float(x)) for x in (9, 1, 2, 7))))) == (2, 1, 9, 7)
    assert tuple(one(spark, *G.rescaled(lit_box(10, 10, 20, 20), F.lit(100), F.lit(100), F.lit(55), F.lit(200)))) == (5, 20, 11, 40)


@pytest.mark.parametrize("text", ["", " a ", "　x y\x1c", "\x85", "\t\n z", "\xa0b\xa0"])
def test_strip_is_unicode(spark, text):
    assert tuple(one(spark, T.strip(F.lit(text)), T.rstrip(F.lit(text)), T.is_blank(F.lit(text)))) == (text.strip(), text.rstrip(), not text.strip())


@pytest.mark.parametrize("text,want", [("三", 3), ("十", 10), ("12", 12), ("十一", None), ("x", None)])
def test_numerals(spark, text, want):
    assert one(spark, T.numeral(F.lit(text)))[0] == want


def test_truncate_and_preview(spark):
    assert tuple(one(spark, T.truncate(F.lit("abcdef"), 3), T.truncate(F.lit("abc"), 3))) == ("abc...", "abc")
    assert one(spark, T.preview(F.lit("a\nb\nc\nd\n"), 2))[0] == "a\nb\n\n... (2 more lines)"
    assert one(spark, T.preview(F.lit("a\nb\n"), 2))[0] == "a\nb\n"
    assert tuple(one(spark, T.starts_lower(F.lit("éa")), T.starts_lower(F.lit("Éa")), T.starts_lower(F.lit("1a")))) == (True, False, False)
