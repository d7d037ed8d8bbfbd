"""Snapping predicted table borders to the page's lines.

Every line is weighed for every side of every table of its page at once; the nearest line of a side is a minimum of structs
(distance, order), and the corrections are one CASE per table. One equi-join on the page and one aggregation; no loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits: straightness of a line, height of a small table, share of a side that a line may lie inside, smallest and largest correction.
STRAIGHT, SMALL, INSIDE, LEAST, MOST = 2.0, 75.0, 0.25, 2.0, 30.0


def _min_of(met: Column, *fields: Column) -> Column:
    return F.min(F.when(met, F.struct(*fields)))


def candidates(tables: DataFrame, lines: DataFrame, tolerance: float = 30.0, page: str = "page") -> DataFrame:
    """Per table (page, idx, x1, y1, x2, y2): the nearest line of each side as a struct (dist, ord, pos, lo, hi), the first rect that matches, and its horizontal lines.

    tables: page, idx, box. lines: page, line_ord, kind (line, rect), sx, sy, ex, ey, box.
    """
    t = tables.select(page, "idx", "x1", "y1", "x2", "y2").alias("t")
    m = lines.alias("m")
    joined = t.join(m, F.col(f"t.{page}") == F.col(f"m.{page}"), "left")
    x1, y1, x2, y2 = (F.col(f"t.{c}") for c in ("x1", "y1", "x2", "y2"))
    sx, sy, ex, ey, order = (F.col(f"m.{c}") for c in ("sx", "sy", "ex", "ey", "line_ord"))
    width, height = x2 - x1, y2 - y1
    is_line = F.col("m.kind") == "line"
    upright = is_line & (F.abs(sx - ex) <= STRAIGHT)
    level = is_line & ~(F.abs(sx - ex) <= STRAIGHT) & (F.abs(sy - ey) <= STRAIGHT)
    flat = is_line & (F.abs(sy - ey) <= STRAIGHT)

    def long_enough(lo: Column, hi: Column, a: Column, b: Column) -> Column:
        return F.least(hi, b + tolerance) - F.greatest(lo, a - tolerance) >= F.least((b - a) * 0.5, (hi - lo) * 0.5)

    ylo, yhi, xlo, xhi = F.least(sy, ey), F.greatest(sy, ey), F.least(sx, ex), F.greatest(sx, ex)
    tall, broad = long_enough(ylo, yhi, y1, y2), long_enough(xlo, xhi, x1, x2)
    x, y = (sx + ex) / 2, (sy + ey) / 2
    small = height < SMALL
    down = F.when(small, F.greatest(height * 0.85, F.lit(30.0))).otherwise(height * INSIDE)
    up = F.when(small, F.greatest(height * 0.5, F.lit(30.0))).otherwise(height * INSIDE)

    def side(met: Column, pos: Column, edge: Column, lo: Column, hi: Column) -> Column:
        return _min_of(met & (F.abs(pos - edge) <= tolerance), F.abs(pos - edge).alias("dist"), order.alias("ord"), pos.alias("pos"), lo.alias("lo"), hi.alias("hi"))

    rect = (F.col("m.kind") == "rect") & (F.abs(x1 - F.col("m.x1")) <= tolerance) & (F.abs(y1 - F.col("m.y1")) <= tolerance) & (F.abs(x2 - F.col("m.x2")) <= tolerance) & (F.abs(y2 - F.col("m.y2")) <= tolerance)
    return joined.groupBy(f"t.{page}", "t.idx", "t.x1", "t.y1", "t.x2", "t.y2").agg(
        side(upright & tall & (x <= x1 + width * INSIDE), x, x1, ylo, yhi).alias("left"),
        side(upright & tall & (x >= x2 - width * INSIDE), x, x2, ylo, yhi).alias("right"),
        side(level & broad & (y <= y1 + down), y, y1, xlo, xhi).alias("top"),
        side(level & broad & (y >= y2 - up), y, y2, xlo, xhi).alias("bottom"),
        _min_of(rect, order.alias("ord"), *(F.col(f"m.{c}").alias(c) for c in ("x1", "y1", "x2", "y2"))).alias("rect"),
        # only small tables look for their lower border again
        F.collect_list(F.when(flat & broad & small, F.struct(order.alias("ord"), y.alias("pos"), xlo.alias("lo"), xhi.alias("hi")))).alias("levels"),
    )


def snap(tables: DataFrame, lines: DataFrame, tolerance: float = 30.0, page: str = "page") -> DataFrame:
    """(page, idx, x1, y1, x2, y2, refined): the snapped box where two sides are found at least, else the predicted one."""
    c = candidates(tables, lines, tolerance, page)
    height = F.col("y2") - F.col("y1")
    small = height < SMALL
    # small tables: the upper border first, then the line nearest to where the height puts the lower one
    target = F.col("top.pos") + height
    again = F.array_min(
        F.transform(
            F.filter("levels", lambda v: (F.abs(v["pos"] - target) <= min(tolerance * 0.99, 30.0)) & (v["pos"] >= target - F.greatest(height * 0.5, F.lit(30.0)))),
            lambda v: F.struct(F.abs(v["pos"] - target).alias("dist"), v["ord"].alias("ord"), v["pos"].alias("pos")),
        )
    )
    c = c.withColumns({"moved": small & F.col("top").isNotNull(), "again": again})
    found = {s: F.col(s).isNotNull() for s in ("left", "right", "top")} | {"bottom": F.col("moved") | F.col("bottom").isNotNull()}
    c = c.withColumns(
        {
            "l0": F.coalesce("left.pos", "x1"),
            "r0": F.coalesce("right.pos", "x2"),
            "t0": F.coalesce("top.pos", "y1"),
            "b0": F.when(F.col("moved"), F.coalesce("again.pos", F.col("top.pos") + height)).otherwise(F.coalesce("bottom.pos", "y2")),
            "across": F.when(found["top"], F.struct("top.lo", "top.hi")).when(found["bottom"], F.struct("bottom.lo", "bottom.hi")),
            "n_found": sum(f.cast("int") for f in found.values()),
        }
    )

    def by_ends(now: str, predicted: str, end: str, has: Column) -> Column:
        """The end of the upper (else lower) border, where no upright line was found or where it is nearer to the prediction."""
        end_at, step = F.col(f"across.{end}"), F.abs(F.col(f"across.{end}") - F.col(now))
        better = ~has | (F.abs(end_at - F.col(predicted)) < F.abs(F.col(now) - F.col(predicted)))
        return F.when(F.col("across").isNotNull() & (step <= MOST) & (step > LEAST) & better, end_at).otherwise(F.col(now))

    lowest, highest = F.least("left.lo", "right.lo"), F.greatest("left.hi", "right.hi")

    def by_uprights(now: str, predicted: str, end: Column, has: Column) -> Column:
        """The reach of the upright lines, likewise."""
        better = ~has | (F.abs(end - F.col(predicted)) < F.abs(F.col(now) - F.col(predicted)))
        return F.when(end.isNotNull() & better & (F.abs(end - F.col(now)) > LEAST), end).otherwise(F.col(now))

    c = c.withColumns({"l": by_ends("l0", "x1", "lo", found["left"]), "r": by_ends("r0", "x2", "hi", found["right"]), "t": by_uprights("t0", "y1", lowest, found["top"]), "b": by_uprights("b0", "y2", highest, found["bottom"])})
    rect = F.col("rect").isNotNull()
    refined = rect | (F.col("n_found") >= 2)

    def pick(of_rect: str, snapped: Column, predicted: str) -> Column:
        return F.when(rect, F.col(of_rect)).when(F.col("n_found") >= 2, snapped).otherwise(F.col(predicted)).alias(predicted)

    return c.select(page, "idx", pick("rect.x1", F.least("l", "r"), "x1"), pick("rect.y1", F.least("t", "b"), "y1"), pick("rect.x2", F.greatest("l", "r"), "x2"), pick("rect.y2", F.greatest("t", "b"), "y2"), refined.alias("refined"))
