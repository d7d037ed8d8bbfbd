"""Column layout of pages: classification, regions and slices.

A page has few elements, so they are gathered once, in order, and folded: whatever is asked of a page takes one
shuffle of the elements and one of the pages.
"""


from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.geometry import box, crosses, meets_rows, pixel_crop, struct_box, too_small
from quirespark.operators.elements import CONTENT, PAGE

#: Regions of a kind are one if the gap is no more than this.
REGION_GAP = 20.0


def content_of(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("type").isin(*CONTENT))


def _gathered(elements: DataFrame, pages: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, width, height, center_line, content): the content elements of each page as an array by (y1, idx)."""
    one = F.struct("y1", "idx", "type", "x1", "x2", "y2")
    found = content_of(elements).groupBy(*page).agg(F.array_sort(F.collect_list(one)).alias("content"))
    rows = pages.select(*page, "width", "height").join(found, list(page), "left")
    return rows.select(*page, "width", "height", (F.col("width") / 2).alias("center_line"), F.coalesce("content", F.array()).alias("content"))


def _crossing(e: Column) -> Column:
    return crosses(struct_box(e), F.col("center_line"))


def _layout_type() -> Column:
    """No element crosses the center line: double. Else mixed, if two elements share a row and one of them doesn't cross; else single.

    By y1, an element shares a row with an earlier one if the furthest y2 so far reaches its y1, so running maxima stand for
    the pairs.
    """
    low = F.lit(float("-inf"))

    def step(s: Column, e: Column) -> Column:
        off = F.when(~_crossing(e), e["y2"])
        met = F.when(_crossing(e), s["off"]).otherwise(s["reach"]) >= e["y1"]
        return F.struct(F.greatest(s["reach"], e["y2"]).alias("reach"), F.greatest(s["off"], off).alias("off"), (s["multi"] | met).alias("multi"))

    multi = F.aggregate("content", F.struct(low.alias("reach"), low.alias("off"), F.lit(False).alias("multi")), step, lambda s: s["multi"])
    return F.when(F.size("content") == 0, "single").when(~F.exists("content", _crossing), "double").when(multi, "mixed").otherwise("single")


def page_layout(elements: DataFrame, pages: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """(page, width, height, center_line, layout_type, n_content, n_crossing) of every page of pages (page, width, height)."""
    rows = _gathered(elements, pages, page)
    return rows.select(*page, "width", "height", "center_line", _layout_type().alias("layout_type"), F.size("content").cast("long").alias("n_content"), F.size(F.filter("content", _crossing)).cast("long").alias("n_crossing"))


def layout_distribution(layouts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return layouts.groupBy(*by, "layout_type").agg(F.count("*").alias("n_pages"))


def _merged_regions(gap: float) -> Column:
    """Array of (kind, y1, y2): neighbouring elements of a kind, as long as the next begins within the gap of the furthest one of their turn."""
    none = F.struct(F.expr("cast(array() as array<struct<kind: string, y1: double, y2: double>>)").alias("done"), F.lit(None).cast("double").alias("far"))

    def step(s: Column, e: Column) -> Column:
        kind = F.when(_crossing(e), "single").otherwise("double")
        last = F.get(s["done"], F.size(s["done"]) - 1)
        same = F.coalesce(last["kind"] == kind, F.lit(False))
        longer = F.struct(kind.alias("kind"), last["y1"].alias("y1"), F.greatest(last["y2"], e["y2"]).alias("y2"))
        another = F.struct(kind.alias("kind"), e["y1"].alias("y1"), e["y2"].alias("y2"))
        done = F.when(same & (e["y1"] <= s["far"] + gap), F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(longer))).otherwise(F.concat(s["done"], F.array(another)))
        return F.struct(done.alias("done"), F.when(same, F.greatest(s["far"], e["y2"])).otherwise(e["y2"]).alias("far"))

    return F.aggregate("content", none, step, lambda s: s["done"])


def regions(elements: DataFrame, pages: DataFrame, page: Sequence[str] = PAGE, gap: float = REGION_GAP) -> DataFrame:
    """(page, region_ord, region_type, x1, y1, x2, y2, element_type, element_index, width, height, layout_type) of every page, in order.

    A double region that an element crosses is irregular: it gives one region per element in its rows, cut to them.
    """
    zero, width, height, center = F.lit(0.0), F.col("width"), F.col("height"), F.col("center_line")

    def part(kind: str, x1: Column, y1: Column, x2: Column, y2: Column, element: Column | None = None, index: Column | None = None) -> Column:
        element = F.lit(None).cast("string") if element is None else element
        index = F.lit(None).cast("int") if index is None else index
        return F.struct(F.lit(kind).alias("region_type"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), element.alias("element_type"), index.alias("element_index"))

    halves = lambda y1, y2: F.array(part("left_column", zero, y1, center, y2), part("right_column", center, y1, width, y2))

    def cut(r: Column) -> Column:
        met = F.filter("by_idx", lambda e: meets_rows(struct_box(e), r["y1"], r["y2"]))
        pieces = lambda m: F.transform(m, lambda e, i: part("irregular_element", e["x1"], F.greatest(e["y1"], r["y1"]), e["x2"], F.least(e["y2"], r["y2"]), e["type"], i))
        # an array of one, so that the elements are looked for once
        double = F.get(F.transform(F.array(met), lambda m: F.when(F.exists(m, _crossing), pieces(m)).otherwise(halves(r["y1"], r["y2"]))), F.lit(0))
        return F.when(r["kind"] == "single", F.array(part("single", zero, r["y1"], width, r["y2"]))).otherwise(double)

    rows = _gathered(elements, pages, page).withColumn("layout_type", _layout_type())
    by_idx = F.array_sort(F.transform("content", lambda e: F.struct(*(e[c].alias(c) for c in ("idx", "type", "x1", "y1", "x2", "y2")))))
    rows = rows.withColumn("by_idx", by_idx).withColumn("merged", F.when(F.col("layout_type") == "mixed", _merged_regions(gap)))
    found = F.when(F.col("layout_type") == "mixed", F.flatten(F.transform("merged", cut))).when(F.col("layout_type") == "double", halves(zero, height)).otherwise(F.array(part("single", zero, zero, width, height)))
    flat = rows.select(*page, "width", "height", "layout_type", F.posexplode(found).alias("at", "r"))
    return flat.select(*page, (F.col("at") + 1).alias("region_ord"), "r.*", "width", "height", "layout_type")


def slices(found: DataFrame, dpi: float = 300.0, page: Sequence[str] = PAGE) -> DataFrame:
    """Regions with their pixel boxes; slice_index counts those that stay, and is null for those that are too small (discarded)."""
    scale = dpi / 72.0
    rows = found.withColumns({"image_width": (F.col("width") * scale).cast("int"), "image_height": (F.col("height") * scale).cast("int")})
    crop = pixel_crop(box(), F.col("image_width") / F.col("width"), F.col("image_height") / F.col("height"), F.col("image_width"), F.col("image_height"))
    rows = rows.withColumn("discarded", too_small(box()))
    kept = F.sum(F.when(F.col("discarded"), 0).otherwise(1)).over(Window.partitionBy(*page).orderBy("region_ord"))
    rows = rows.withColumns({"slice_index": F.when(~F.col("discarded"), kept), "px1": crop.x1, "py1": crop.y1, "px2": crop.x2, "py2": crop.y2})
    name = F.when(~F.col("discarded"), F.concat(F.lit("page_"), F.col(page[-1]).cast("string"), F.lit("_slice_"), F.col("slice_index").cast("string"), F.lit(".jpg")))
    return rows.select(*page, "region_ord", "region_type", "slice_index", "discarded", "x1", "y1", "x2", "y2", "px1", "py1", "px2", "py2", name.alias("filename"), "width", "height", "layout_type")


def slice_summary(cut: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slices, discarded and irregular ones, pages, and slices per page."""
    kept = F.count_if(~F.col("discarded"))
    return cut.groupBy(*by).agg(
        kept.alias("total_slices"), F.count_if("discarded").alias("total_discarded"), F.count_if((F.col("region_type") == "irregular_element") & ~F.col("discarded")).alias("total_irregular"), F.count_distinct("page").alias("processed_pages"), (kept / F.greatest(F.count_distinct("page"), F.lit(1))).alias("slices_per_page")
    )


def slice_info(cut: DataFrame, dpi: float = 300.0, page: Sequence[str] = PAGE) -> DataFrame:
    """The slice document of each page: layout, sizes, scale factors, its slices and what was discarded, with the reason. Every page has a region."""
    b = F.array("x1", "y1", "x2", "y2")
    one = F.struct("region_ord", "slice_index", "region_type", b.alias("pdf_bbox"), F.array("px1", "py1", "px2", "py2").alias("image_bbox"), "filename", (F.col("px2") - F.col("px1")).alias("width"), (F.col("py2") - F.col("py1")).alias("height"))
    size = F.format_string("PDF box too small (%.1fx%.1fpx)", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    gone = F.struct("region_ord", "region_type", b.alias("pdf_bbox"), (F.col("x2") - F.col("x1")).alias("pdf_width"), (F.col("y2") - F.col("y1")).alias("pdf_height"), size.alias("reason"))
    of_page = [F.first(c).alias(c) for c in ("layout_type", "width", "height")]
    whole = cut.groupBy(*page).agg(*of_page, F.array_sort(F.collect_list(F.when(~F.col("discarded"), one))).alias("slices"), F.array_sort(F.collect_list(F.when(F.col("discarded"), gone))).alias("discarded_slices"))
    wide, high = (F.col("width") * dpi / 72.0).cast("int"), (F.col("height") * dpi / 72.0).cast("int")
    return whole.select(*page, "layout_type", F.array("width", "height").alias("page_size"), F.array(wide, high).alias("image_size"), F.array(wide / F.col("width"), high / F.col("height")).alias("scale"), "slices", "discarded_slices")
