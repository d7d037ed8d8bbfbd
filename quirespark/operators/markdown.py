"""Markdown of HTML blocks, its cleaning, and merged documents: columns only once the blocks are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import is_blank, rstrip, starts_lower, strip

#: How lines begin that take no line after them.
TAKES_NONE = r"^(?:[#|\-*!$>]|```)"
NO_TABLE, NO_LIST = "<!-- empty table -->", "<!-- empty list -->"


def _note(kind: Column, bbox: Column) -> Column:
    return F.when(bbox != "", F.concat(F.lit("<!-- "), kind, F.lit(" bbox: "), bbox, F.lit(" -->")))


def table_lines(rows: Column) -> Column:
    """Lines of a table from its rows (bbox, cells): the first one is the head; spans are filled in already."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def one(row: Column, k: Column) -> Column:
        rule = F.when(k == 0, line(F.transform(row["cells"], lambda _: F.lit("---"))))
        return F.array_compact(F.array(F.when(row["bbox"] != "", F.concat(F.lit("<!-- TABLE ROW bbox: "), row["bbox"], F.lit(" -->"))), line(row["cells"]), rule))

    return F.when(F.size(rows) == 0, F.array(F.lit(NO_TABLE))).otherwise(F.flatten(F.transform(rows, one)))


def list_lines(items: Column, ordered: Column, start: Column) -> Column:
    """Lines of a list from its items (bbox, text): further lines of an item are indented by three spaces."""

    def one(item: Column, k: Column) -> Column:
        marker = F.when(ordered, F.concat((start + k).cast("string"), F.lit(". "))).otherwise(F.lit("- "))
        lines = F.split(item["text"], "\n", -1)
        first = F.concat(marker, F.when(F.size(lines) > 1, strip(F.get(lines, F.lit(0)))).otherwise(item["text"]))
        more = F.transform(F.filter(F.slice(lines, 2, 2_000_000_000), lambda x: ~is_blank(x)), lambda x: F.concat(F.lit("   "), strip(x)))
        return F.concat(F.array_compact(F.array(F.when(item["bbox"] != "", F.concat(F.lit("<!-- LIST ITEM bbox: "), item["bbox"], F.lit(" -->"))), first)), more)

    return F.when(F.size(items) == 0, F.array(F.lit(NO_LIST))).otherwise(F.flatten(F.transform(items, one)))


def block_markdown(blocks: DataFrame) -> DataFrame:
    """blocks with `md`: the lines of each block, an empty one last, joined."""
    kind, text, tag, bbox = F.col("kind"), F.col("text"), F.col("tag"), F.col("bbox")
    failed = lambda what: F.array(F.concat(F.lit(f"<!-- {what} error: "), F.col("error"), F.lit(" -->")))
    start = F.coalesce(F.when(F.col("start") != "", F.col("start").try_cast("int")), F.lit(1))
    classes = F.when(F.size("classes") > 0, F.concat(F.lit("<!-- TABLE class: "), F.array_join("classes", " "), F.lit(" -->")))
    notes = F.when(kind == "list", F.when(F.col("start") != "", F.concat(F.lit("<!-- LIST start: "), F.col("start"), F.lit(" -->")))).when(kind == "table", classes)
    lines = (
        F.when(kind == "heading", F.array(F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "), text)))
        .when(kind == "paragraph", F.array(F.when(F.col("in_address"), F.concat(F.lit("*"), text, F.lit("*"))).otherwise(text)))
        .when(kind == "formula", F.array(F.coalesce(text, F.lit("<!-- Formula placeholder -->"))))
        .when(kind == "abstract", F.array(F.lit("## Abstract"), text))
        .when(kind == "image", F.array(F.concat(F.lit("!["), F.col("alt"), F.lit("]("), F.when(F.col("src") != "", F.col("src")).otherwise("image_placeholder"), F.lit(")"))))
        .when(kind == "table", F.when(F.col("error").isNotNull(), failed("table")).otherwise(table_lines(F.col("rows"))))
        .when(kind == "list", F.when(F.col("error").isNotNull(), failed("list")).otherwise(list_lines(F.col("items"), tag == "ol", start)))
    )
    names = F.when(kind == "heading", F.upper(tag)).when(kind == "list", F.concat(F.lit("LIST "), F.upper(tag))).when(kind == "abstract", F.lit("ABSTRACT BLOCK")).otherwise(F.upper(kind))
    return blocks.withColumn("md", F.array_join(F.concat(F.array_compact(F.array(_note(names, bbox), notes)), lines, F.array(F.lit(""))), "\n"))


def page_markdown(blocks: DataFrame, pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, complete_md, clean_md) of every page of pages; pages without blocks have their markers only."""
    body = block_markdown(blocks).groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda b: b["md"]), "\n").alias("body"))
    number = F.col(page).cast("string")
    head = F.concat(F.lit("<!-- PAGE "), number, F.lit(" START -->\n---\n<!-- Page "), number, F.lit(" -->\n"))
    foot = F.concat(F.lit("<!-- PAGE "), number, F.lit(" END -->\n"))
    whole = F.concat_ws("\n", head, "body", foot)
    return pages.select(page).distinct().join(body, page, "left").select(page, whole.alias("complete_md")).withColumn("clean_md", clean(F.col("complete_md")))


def clean(md: Column) -> Column:
    """Markdown without comments, rules and runs of blank lines, and with paragraphs that pages cut in two joined again.

    A line joins the one before if it begins in lower case and that one is plain text that ends no sentence. Whether it does only
    depends on the two lines, so the document is one array expression: no rows, no shuffle. Each step binds its array as the
    element of an array of one, so that it is made once, and each line is looked at once.
    """
    lines = F.transform(F.split(md, "\n", -1), lambda x: F.struct(x.alias("line"), strip(x).alias("s")))
    kept = F.filter(lines, lambda x: ~((x["s"].startswith("<!--") & x["s"].endswith("-->")) | (x["s"] == "---")))
    return F.get(F.transform(F.array(kept), _squeezed), F.lit(0))


def _squeezed(lines: Column) -> Column:
    """Of a run of blank lines the first, unless it comes first of all."""
    kept = F.filter(lines, lambda x, k: (x["s"] != "") | ((k > 0) & (F.get(lines, k - 1)["s"] != "")))
    # opens: the line may join the one before (what keeps lines apart never is a lower-case letter); takes: the next one may join it
    looked_at = F.transform(
        kept,
        lambda x: F.struct(
            F.when(x["s"] == "", F.lit("")).otherwise(x["line"]).alias("line"),
            x["s"].alias("s"),
            starts_lower(x["s"]).alias("opens"),
            ((x["s"] != "") & ~x["s"].rlike(TAKES_NONE) & ~x["s"].rlike(r"[.?!]\z")).alias("takes"),
        ),
    )
    return F.get(F.transform(F.array(looked_at), _paragraphs), F.lit(0))


def _paragraphs(lines: Column) -> Column:
    def one(x: Column, k: Column) -> Column:
        here = x["opens"] & (k > 0) & F.coalesce(F.get(lines, k - 1)["takes"], F.lit(False))
        after = x["takes"] & F.coalesce(F.get(lines, k + 1)["opens"], F.lit(False))
        text = F.when(here, x["s"]).when(after, rstrip(x["line"])).otherwise(x["line"])
        return F.concat(F.when(k == 0, "").when(here, " ").otherwise("\n"), text)

    # a last blank line goes
    return F.regexp_replace(F.array_join(F.transform(lines, one), ""), r"\n+\z", "")


def merged(pages: DataFrame, by: tuple[str, ...] = (), order: str = "page_id") -> DataFrame:
    """(complete_md, clean_md, n_pages) of documents of pages (complete_md, clean_md): pages in order; empty clean pages are left out, and the whole is cleaned again.

    That is done by page: blank lines stand between pages, over which no lines join, and a page that this empties leaves none.
    """
    pages = pages.withColumn("clean_md", clean(F.col("clean_md")))

    def ordered(column: str, separator: str, skip_empty: bool) -> Column:
        rows = F.array_sort(F.collect_list(F.when(~is_blank(F.col(column)), F.struct(order, column)) if skip_empty else F.struct(order, column)))
        return F.array_join(F.transform(rows, lambda r: r[column]), separator)

    return pages.groupBy(*by).agg(ordered("complete_md", "\n\n", False).alias("complete_md"), ordered("clean_md", "\n\n", True).alias("clean_md"), F.count("*").alias("n_pages"))
