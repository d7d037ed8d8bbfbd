"""Parsing of model replies: detections in prose, fenced JSON, points in XML. Malformed replies give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.geometry import Box, model_to_page

#: Fixed value: the label of a detection that names none.
DEFAULT_LABEL = "表格"


def json_array(reply: Column) -> Column:
    """From the first `[` to the last `]`; null if there is none."""
    first, last = F.instr(reply, "["), F.length(reply) - F.instr(F.reverse(reply), "]") + 1
    return F.when((first > 0) & (F.instr(reply, "]") > 0) & (last > first), F.substring(reply, first, last - first + 1))


def detections(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows of replies with det_ord, x1, y1, x2, y2, label, confidence for each item that has a bbox_2d."""
    value = F.try_parse_json(json_array(F.col(reply)))
    items = F.try_variant_get(value, "$", "array<variant>")
    kept = [c for c in replies.columns if c != reply]
    rows = replies.select(*kept, F.posexplode(items).alias("det_ord", "item"))
    box = F.try_variant_get("item", "$.bbox_2d", "array<double>")
    rows = rows.select(*kept, "det_ord", box.alias("box"), F.try_variant_get("item", "$.label", "string").alias("label"), F.try_variant_get("item", "$.confidence", "double").alias("confidence"))
    return rows.filter(F.size("box") >= 4).select(*kept, "det_ord", *(F.get("box", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))), F.coalesce("label", F.lit(DEFAULT_LABEL)).alias("label"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def on_page(found: DataFrame, model: tuple[Column, Column], image: tuple[Column, Column], page: tuple[Column, Column]) -> DataFrame:
    """Detections with their boxes on the page instead of model pixels."""
    b = model_to_page(Box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), model, image, page)
    return found.withColumns(dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)))


def without_fence(reply: Column) -> Column:
    """What stands within a ```json fence, or the whole reply."""
    inner = F.regexp_extract(reply, r"(?s)(?:^|\n)```json\n(.*?)(?:```|\z)", 1)
    return F.when(reply.rlike(r"(?:^|\n)```json(?:\n|\z)"), inner).otherwise(reply)


def repaired(text: Column) -> Column:
    """A JSON list; one that was cut off ends after its last whole item."""
    cut = F.length(text) - F.instr(F.reverse(text), '}"')
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.instr(text, '"}') > 0, F.concat(F.substring(text, 1, cut + 1), F.lit("]")))


def points(reply: Column) -> Column:
    """Struct (points, alt, phrase) of <points x1= y1= ... alt=>phrase</points>; null if it isn't one."""
    head, n = F.regexp_extract(reply, r"^\s*<points([^<>]*)>", 1), F.lit(r'\b([xy]\d+)\s*=\s*"([^"]*)"')
    names, values = F.regexp_extract_all(head, n, F.lit(1)), F.regexp_extract_all(head, n, F.lit(2))
    by = F.map_from_arrays(names, values)
    count = F.floor(F.size(names) / 2).cast("int")
    pairs = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(F.try_element_at(by, F.concat(F.lit("x"), k.cast("string"))).alias("x"), F.try_element_at(by, F.concat(F.lit("y"), k.cast("string"))).alias("y"))))
    alt = F.regexp_extract(head, r'\balt\s*=\s*"([^"]*)"', 1)
    phrase = F.trim(F.regexp_extract(reply, r"(?s)^\s*<points[^<>]*>(.*?)</points>\s*$", 1))
    return F.when(reply.rlike(r"(?s)^\s*<points[^<>]*>.*</points>\s*$"), F.struct(pairs.alias("points"), F.when(alt != "", alt).alias("alt"), F.when(phrase != "", phrase).alias("phrase")))


def plain_box(reply: Column) -> Column:
    """Struct (x1, y1, x2, y2, label) of a line `x1,y1,x2,y2 label`; null if it isn't one."""
    pattern = r"^\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*(.*)$"
    number = lambda k: F.regexp_extract(reply, pattern, k).try_cast("double")
    return F.when(reply.rlike(pattern), F.struct(number(1).alias("x1"), number(2).alias("y1"), number(3).alias("x2"), number(4).alias("y2"), F.regexp_extract(reply, pattern, 5).alias("label")))
