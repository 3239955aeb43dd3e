"""Selection by geometry: the box at a point, the boxes and the text in a rectangle, boxes around a range.

Joins are by cells of a grid in levels: a box lies on the level whose cells are as wide
as the box at least, so it touches four of them at most, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paginarium.functions.arrays import let, runs

#: Width of a cell on level 0.
CELL = 32.0
#: Points of a cell that one key of the join holds.
CROWD = 2000


def _corner(box: Column, low: bool) -> tuple[Column, Column]:
    pick = F.least if low else F.greatest
    return pick(box["x0"], box["x1"]), pick(box["y0"], box["y1"])


def level_of(box: Column, margin_x: float = 0.0, margin_y: float = 0.0) -> Column:
    """The level on which a box, widened by the margins on every side, is no wider than a cell."""
    side = F.greatest(F.abs(box["x1"] - box["x0"]) + 2 * margin_x, F.abs(box["y1"] - box["y0"]) + 2 * margin_y)
    return F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(CELL)) / CELL)), F.lit(0)).cast("int")


def cells_of(box: Column, level: Column, margin_x: float = 0.0, margin_y: float = 0.0) -> Column:
    """(cx, cy) of the cells that a box touches on a level that is its own or above."""
    (x0, y0), (x1, y1) = _corner(box, True), _corner(box, False)
    at = lambda v: F.floor(v / (CELL * F.pow(F.lit(2.0), level))).cast("long")
    over = lambda a, b: F.sequence(at(a), at(b))
    return F.flatten(F.transform(over(x0 - margin_x, x1 + margin_x), lambda cx: F.transform(over(y0 - margin_y, y1 + margin_y), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def sound(box: Column) -> Column:
    """Whether all four numbers are finite."""
    return F.coalesce(*[F.when(F.coalesce(F.abs(box[k].cast("double")) < 1e18, F.lit(False)), F.lit(None)).otherwise(False) for k in ("x0", "y0", "x1", "y1")], F.lit(True))


def boxes_at_points(points: DataFrame, boxes: DataFrame, page: str, point: str, index: str, tolerance: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``points`` (``x``, ``y`` on a page) with the ``index`` of the box they hit, or null.

    A box that holds the point wins, of several the one with the smallest index; edges
    belong to the box, and a box with swapped corners holds no point. Else, where a tolerance is given, the nearest box that
    holds the point when widened by half the tolerance, by the sum of the distances
    to its nearest edges (below 10,000), ties to the smallest index. Points on a page are told apart by ``point``.

    The join's keys are a page's cells; a cell with many points is dealt over several keys.
    """
    mx, my = max(tolerance[0], 0.0) / 2, max(tolerance[1], 0.0) / 2
    near = tolerance[0] > 0 or tolerance[1] > 0
    level = level_of(F.col("box"), mx, my)
    laid = boxes.where(sound(F.col("box"))).select(F.col(page).alias("_page"), F.col(index).alias("_index"), "box", level.alias("_level"))
    top = laid.agg(F.max("_level")).first()[0]  # one number
    if top is None:
        return points.withColumn(index, F.lit(None).cast(dict(boxes.dtypes)[index]))
    laid = laid.withColumn("_cell", F.explode(cells_of(F.col("box"), F.col("_level"), mx, my)))
    asked = points.where("x IS NOT NULL AND y IS NOT NULL AND abs(x) < 1e18 AND abs(y) < 1e18").select(F.col(page).alias("_page"), F.col(point).alias("_point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_level"))
    width = CELL * F.pow(F.lit(2.0), F.col("_level"))
    asked = asked.withColumn("_cell", F.struct(F.floor(F.col("x") / width).cast("long").alias("cx"), F.floor(F.col("y") / width).cast("long").alias("cy")))
    keys = ["_page", "_level", "_cell"]
    crowds = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("_parts"))
    asked = asked.join(crowds, keys).withColumn("_part", F.pmod(F.xxhash64("_point"), "_parts").cast("int")).drop("_parts")
    laid = laid.join(crowds, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    x, y, box = F.col("x"), F.col("y"), F.col("box")
    inside = (x >= box["x0"]) & (x <= box["x1"]) & (y >= box["y0"]) & (y <= box["y1"])
    (x0, y0), (x1, y1) = _corner(box, True), _corner(box, False)
    widened = (x >= x0 - mx) & (x <= x1 + mx) & (y >= y0 - my) & (y <= y1 + my)
    away = F.least(F.abs(x - x0), F.abs(x - x1)) + F.least(F.abs(y - y0), F.abs(y - y1))
    met = asked.join(laid, [*keys, "_part"]).where(inside | (widened & (away < 10_000) if near else F.lit(False)))
    best = met.groupBy("_page", "_point").agg(F.min(F.struct((~inside).alias("far"), F.when(inside, 0.0).otherwise(away).alias("away"), F.col("_index").alias("index"))).alias("b"))
    found = best.select("_page", "_point", F.col("b.index").alias(index))
    return points.join(found, points[page].eqNullSafe(found["_page"]) & points[point].eqNullSafe(found["_point"]), "left").drop("_page", "_point")


def boxes_in_rects(rects: DataFrame, boxes: DataFrame, page: str, rect: str, index: str) -> DataFrame:
    """(page, rect, index) of the boxes that share area with each rectangle (struct ``area``) of their page.

    A pair meets on the higher of its two levels: there each of both touches four cells at most.
    """
    def laid(rows: DataFrame, box: str, name: str, top: int) -> DataFrame:
        own = rows.where(sound(F.col(box))).select(F.col(page).alias("_page"), F.col(name).alias(f"_{name}"), F.col(box), level_of(F.col(box)).alias("_own"))
        on = own.withColumn("_level", F.explode(F.sequence(F.col("_own"), F.greatest(F.lit(top), "_own"))))
        return on.withColumn("_cell", F.explode(cells_of(F.col(box), F.col("_level"))))

    top = max((r[0] or 0) for r in (f.where(sound(F.col(b))).agg(F.max(level_of(F.col(b)))).first() for f, b in ((rects, "area"), (boxes, "box"))))  # two numbers
    left, right = laid(rects, "area", rect, top).withColumnRenamed("_own", "_a"), laid(boxes, "box", index, top).withColumnRenamed("_own", "_b")
    met = left.join(right, ["_page", "_level", "_cell"]).where(F.col("_level") == F.greatest("_a", "_b"))
    area, box = F.col("area"), F.col("box")
    shared = (F.least(area["x1"], box["x1"]) > F.greatest(area["x0"], box["x0"])) & (F.least(area["y1"], box["y1"]) > F.greatest(area["y0"], box["y0"]))
    return met.where(shared).select(F.col("_page").alias(page), F.col(f"_{rect}").alias(rect), F.col(f"_{index}").alias(index)).distinct()


def text_of_selected(characters: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, text): what the selected characters of each selection read.

    ``characters`` has, for each selection, all characters of its page: ``index``, ``char``, ``line``
    (the height they stand on) and ``selected``. A space left out right after a selected
    character still counts, once; where another character is left out and the next
    selected one stands on another line than the last such, a line break comes between.
    """
    order = Window.partitionBy(*keys).orderBy(index)
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("selected"), F.col(index))).over(back)
    other = F.max(F.when(~F.col("selected") & (F.col("char") != " "), F.col(index))).over(back)
    seen = characters.withColumn("_last", last).withColumn("_armed", F.col("selected") & (other.isNotNull() & (other > F.coalesce(F.col("_last"), F.lit(-1)))))
    # the line of the last selected character before which something else was left out; 0 to begin with
    base = F.coalesce(F.last(F.when(F.col("_armed"), F.col("line")), ignorenulls=True).over(back), F.lit(0.0))
    said = (
        F.when(F.col("selected"), F.concat(F.when(F.col("_armed") & (F.col("line") != base) & F.col("_last").isNotNull(), "\r\n").otherwise(""), F.col("char")))
        .when((F.col("char") == " ") & (F.lag("selected").over(order)), " ").otherwise("")
    )
    each = seen.select(*keys, index, said.alias("said")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, "said"))).alias("all"))
    return each.select(*keys, F.array_join(F.transform("all", lambda c: c["said"]), "").alias("text"))


def around_range(boxes: Column, first: Column, last: Column, least: float = 0.01) -> Column:
    """Boxes around the characters from ``first`` up to ``last`` (from 0, left out): one for each run drawn by one object.

    ``boxes`` is an array of (x0, y0, x1, y1, object, made) in order; made characters and boxes narrower or lower than ``least``
    are passed over. A range in which all are gives one empty box; an empty range or one beyond the end gives none.
    """
    def within(all_boxes: Column) -> Column:
        end = F.least(last, F.size(all_boxes))
        return F.when((first < F.size(all_boxes)) & (end > first), F.slice(all_boxes, first + 1, end - first))

    def of(kept: Column) -> Column:
        def edge(own: Column, name: str, pick) -> Column:
            return pick(F.transform(own, lambda b: b[name])).cast("double").alias(name)

        def one(run: Column) -> Column:
            sides = (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))
            return let(F.slice(kept, run["first"] + 1, run["n"]), lambda own: F.struct(*[edge(own, name, pick) for name, pick in sides]))

        nothing = F.array(F.struct(*[F.lit(0.0).alias(k) for k in ("x0", "y0", "x1", "y1")]))
        return F.when(F.size(kept) > 0, F.transform(runs(F.transform(kept, lambda b: b["object"])), one)).otherwise(nothing)

    kept = lambda p: F.filter(p, lambda b: ~b["made"] & (b["x1"] - b["x0"] >= least) & (b["y1"] - b["y0"] >= least))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    # boxes, the range and what is kept of it are worked out once each
    return let(let(boxes, within), lambda part: F.when(part.isNull(), none).otherwise(let(kept(part), of)))
