"""Sweeps over intervals: groups that overlap, rows of a page's boxes, columns of a row.

A sweep is a running maximum in order. It runs in two steps, so that one page with a
third of all boxes is no single task: ends are first summed up by equal start, then by
strip of the axis; the maxima of the strips before one are a window over strips (few),
and only within a strip does a window go over starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paginarium.functions.wrapping import TRAILING


def islands(intervals: DataFrame, keys: list[str], start: str, end: str, name: str, slack: Column | float = 0.0, strip: float | None = 64.0) -> DataFrame:
    """``intervals`` with ``name``: within each key the number, from 0, of the island an interval is in.

    An interval begins an island if it starts no earlier than ``slack`` beyond every end so
    far. Intervals that touch don't overlap (a slack below zero asks for an overlap of so
    much, one above zero bridges gaps smaller than it). Intervals of one start are in
    one island, whatever their ends, and an empty interval lies in the island it starts
    within. Rows whose start or end is null or NaN are in none (null). Without a
    ``strip`` one window goes over all of a key's starts, for keys that are small.
    """
    sound = F.col(start).isNotNull() & F.col(end).isNotNull() & ~F.isnan(F.col(start).cast("double")) & ~F.isnan(F.col(end).cast("double"))
    rows = intervals.where(sound)
    starts = rows.groupBy(*keys, F.col(start).alias("_s")).agg(F.max(F.greatest(start, end)).alias("_e"))
    if strip is None:
        order = Window.partitionBy(*keys).orderBy("_s")
        met = starts.withColumn("_reached", F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        new = F.when(F.col("_reached").isNull() | (F.col("_s") >= F.col("_reached") + slack), 1).otherwise(0)
        numbered = met.withColumn("_new", new).select(*keys, F.col("_s").alias(start), (F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int").alias(name))
        return _numbered(intervals, numbered, [*keys, start], sound, name)
    starts = starts.withColumn("_strip", F.floor(F.col("_s") / strip))
    strips = starts.groupBy(*keys, "_strip").agg(F.max("_e").alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.select(*keys, "_strip", F.max("_most").over(earlier).alias("_before"))
    own = Window.partitionBy(*keys, "_strip").orderBy("_s")
    reached = F.greatest("_before", F.max("_e").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    begun = _together(starts, strips, [*keys, "_strip"]).withColumn("_reached", reached)
    begun = begun.withColumn("_new", F.when(F.col("_reached").isNull() | (F.col("_s") >= F.col("_reached") + slack), 1).otherwise(0))
    sums = begun.groupBy(*keys, "_strip").agg(F.sum("_new").alias("_n"))
    sums = sums.select(*keys, "_strip", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_sum"))
    numbered = _together(begun, sums, [*keys, "_strip"]).select(*keys, F.col("_s").alias(start), (F.col("_sum") + F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int").alias(name))
    return _numbered(intervals, numbered, [*keys, start], sound, name)


def _numbered(intervals: DataFrame, numbered: DataFrame, keys: list[str], sound: Column, name: str) -> DataFrame:
    found = _together(intervals, numbered.withColumnRenamed(name, "_found"), keys, "left")
    return found.select(*intervals.columns, F.when(sound, F.col("_found")).alias(name))


def _together(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join on ``keys`` where null equals null; ``left``'s keys stay."""
    other = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return left.join(other, on, how).drop(*[f"_r{i}" for i in range(len(keys))])


def visual_lines(boxes: DataFrame, page: str, wide: Column | float, strip: float = 64.0, row_strip: float | None = None) -> DataFrame:
    """``boxes`` (with a struct ``box`` of x0, y0, x1, y1, y upwards) with ``row`` and ``part``.

    A row is a set of boxes whose heights overlap in a chain, from the top; where it has
    a gap of at least ``wide`` from left to right, a new part of it begins (columns of a
    page, cells of a table). Both count from 0 within a page or a row. A box that lacks
    a number is in none. A page is swept by strips of ``strip`` points; a row by a window, or by strips
    of ``row_strip`` where rows may be huge.
    """
    number = lambda k: F.coalesce(~F.isnan(F.col(f"box.{k}").cast("double")) & F.col(f"box.{k}").isNotNull(), F.lit(False))
    whole = number("x0") & number("y0") & number("x1") & number("y1")
    flat = boxes.withColumn("_top", F.when(whole, -F.greatest("box.y0", "box.y1"))).withColumn("_bottom", F.when(whole, -F.least("box.y0", "box.y1")))
    rows = islands(flat, [page], "_top", "_bottom", "row", 0.0, strip).drop("_top", "_bottom")
    flat = rows.withColumn("_left", F.when(F.col("row").isNotNull(), F.least("box.x0", "box.x1"))).withColumn("_right", F.when(F.col("row").isNotNull(), F.greatest("box.x0", "box.x1")))
    return islands(flat, [page, "row"], "_left", "_right", "part", wide, row_strip).drop("_left", "_right")


def line_texts(lines: DataFrame, page: str, text: str, place: str) -> DataFrame:
    """One row for each page, row and part of ``visual_lines``: its words from left to right and the box around them."""
    word = F.struct(F.least("box.x0", "box.x1").alias("x"), F.col(place).alias("place"), F.col(text).alias("text"))
    around = F.struct(F.min(F.least("box.x0", "box.x1")).alias("x0"), F.min(F.least("box.y0", "box.y1")).alias("y0"), F.max(F.greatest("box.x0", "box.x1")).alias("x1"), F.max(F.greatest("box.y0", "box.y1")).alias("y1"))
    found = lines.where("part IS NOT NULL").groupBy(page, "row", "part").agg(F.array_sort(F.collect_list(word)).alias("words"), around.alias("box"))
    return found.select(page, "row", "part", F.array_join(F.transform("words", lambda w: w.text), " ").alias("text"), F.size("words").alias("words"), "box")


def layout_rows(lines: DataFrame, page: str, body: Column, left: Column) -> DataFrame:
    """The lines of a page as rows of character cells: (page, row, text, top, bottom).

    A cell is half the body size wide. Lines whose lower edges are within half the body size of
    a row's first line share its row, from the top down; each is placed by its left
    edge, or after one space where the row has come that far already. ``lines`` has
    ``box`` and ``text``; ``body`` (at least 1) and ``left``, the page's left edge, are
    columns of it. A page's layout is one text in the end, so its distinct lower edges fit
    a row, too: the rows' first edges are found in their sorted list.
    """
    flat = lines.where("box.x0 IS NOT NULL AND box.y0 IS NOT NULL").select(F.col(page), F.col("box.x0").alias("x"), F.col("box.y0").alias("y"), F.col("box.y1").alias("top"), "text", F.greatest(body.cast("double"), F.lit(1.0)).alias("size"), left.cast("double").alias("edge"))
    per_page = flat.groupBy(page).agg(F.sort_array(F.collect_set("y"), asc=False).alias("edges"), F.max("size").alias("body"))
    first = F.aggregate(
        "edges", F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<double>").alias("of")),
        lambda s, y: F.when(F.abs(s.y - y) < F.col("body") * 0.5, F.struct(s.y.alias("y"), F.array_append(s.of, s.y).alias("of"))).otherwise(F.struct(y.alias("y"), F.array_append(s.of, y).alias("of"))),
        lambda s: s.of,
    )
    rows = per_page.withColumn("first", first).select(F.col(page).alias("_page"), F.explode(F.arrays_zip("edges", "first")).alias("z")).select("_page", F.col("z.edges").alias("_y"), F.col("z.first").alias("first"))
    placed = flat.join(rows, flat[page].eqNullSafe(F.col("_page")) & (F.col("y") == F.col("_y"))).drop("_page", "_y")
    cell = F.least(F.greatest(F.floor((F.col("x") - F.col("edge")) / (F.col("size") * 0.5) + 0.5), F.lit(0)), F.lit(4096)).cast("int")
    line = F.struct((-F.col("y")).alias("down"), "x", "text", "top", cell.alias("cell"))
    each = placed.groupBy(page, "first").agg(F.array_sort(F.collect_list(line)).alias("own"), F.max("size").alias("size"))
    put = F.aggregate(
        "own", F.lit(""),
        lambda out, w: F.concat(
            F.when(w.cell > F.length(out), F.rpad(out, w.cell, " ")).when(F.length(out) > 0, F.concat(out, F.lit(" "))).otherwise(out), w.text
        ),
    )
    order = Window.partitionBy(page).orderBy(F.desc("first"))
    return each.select(page, (F.row_number().over(order) - 1).alias("row"), F.regexp_replace(put, TRAILING, "").alias("text"), F.get("own", F.lit(0)).top.alias("top"), F.col("first").alias("bottom"), "size")


def layout_text(rows: DataFrame, page: str) -> DataFrame:
    """One text a page from ``layout_rows``: between two rows as many empty ones, at most
    three, as fit the space between them (1.2 body sizes each); every row ends in a line feed."""
    above = F.lag("bottom").over(Window.partitionBy(page).orderBy("row"))
    blank = F.least(F.greatest(F.floor((above - F.col("top")) / (F.col("size") * 1.2)), F.lit(0)), F.lit(3)).cast("int")
    spaced = rows.withColumn("said", F.concat(F.repeat(F.lit("\n"), F.coalesce(blank, F.lit(0))), "text", F.lit("\n")))
    return spaced.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "said"))), lambda r: r.said), "").alias("text"))
