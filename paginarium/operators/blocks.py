"""Blocks of a document: runs of lines of one class, rendered as Markdown; repeats, margins and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paginarium.functions import text, wrapping
from paginarium.functions.arrays import let, runs


def blocks(lines: Column) -> Column:
    """(kind, lines) of each run of lines of one class, in order."""
    found = lambda ls: F.transform(
        runs(F.transform(ls, text.line_class)), lambda r: F.struct(r["value"].alias("kind"), F.slice(ls, r["first"] + 1, r["n"]).alias("lines"))
    )
    return let(lines, found)


def rendered(block: Column, whole: Column) -> Column:
    """A block as Markdown: a paragraph in one line (``whole``: its lines joined), items one by one under their marks."""
    paragraph = wrapping.escaped(wrapping.stripped(whole))
    plain = lambda x: wrapping.escaped(wrapping.stripped(text.item_text(x)))
    bullet = lambda x: F.concat(F.lit("- "), plain(x))
    number = lambda x: F.regexp_extract(text.leading_number(x), "([0-9０-９〇零一二三四五六七八九十百]+)[^0-9０-９〇零一二三四五六七八九十百]*$", 1)
    item = lambda x: F.concat(F.translate(number(x), "０１２３４５６７８９", "0123456789"), F.lit(". "), plain(x))
    return (
        F.when(block["kind"] == "body", paragraph).when(block["kind"] == "bullet", F.array_join(F.transform(block["lines"], bullet), "\n"))
        .otherwise(F.array_join(F.transform(block["lines"], item), "\n"))
    )


def markdown(documents: DataFrame, key: str) -> DataFrame:
    """(key, blocks, markdown): every document's blocks, a blank line between two. Within the row, no shuffle."""
    found = documents.select(key, F.coalesce(blocks(text.lines(F.col("text"))), F.array().cast("array<struct<kind:string,lines:array<string>>>")).alias("found"))
    body = F.transform("found", lambda b: F.when(b["kind"] == "body", b["lines"]))
    found = found.select(key, "found", wrapping.joined_each(body).alias("whole"))
    return found.select(key, F.size("found").alias("blocks"), F.array_join(F.zip_with("found", "whole", rendered), "\n\n").alias("markdown"))


def without_repeats(lines: Column, back: int = 5) -> Column:
    """Lines that don't equal one of the ``back`` lines before them."""
    return let(lines, lambda ls: F.filter(ls, lambda x, i: ~F.array_contains(F.slice(ls, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), x)))


def without_margins(lines: Column, band: float = 0.12) -> Column:
    """Lines but for folios in the top and bottom band of the page."""

    def kept(ls: Column) -> Column:
        depth = F.greatest(F.lit(1), F.ceil(F.size(ls) * band).cast("int"))
        return F.filter(ls, lambda x, i: ~(((i < depth) | (i >= F.size(ls) - depth)) & wrapping.is_folio(x)))

    return let(lines, kept)


def text_slice(body: Column, first: Column, last: Column) -> Column:
    """The characters from ``first`` up to ``last`` (from 0, the last left out); empty where the range leaves the text."""
    return F.when((first >= 0) & (first < last) & (last <= F.length(body)), F.substring(body, first + 1, last - first)).otherwise("")


def text_index(body: Column, char: Column) -> Column:
    """Where a character of the page stands in the text that search sees, which lacks soft hyphens and carriage returns.

    A character that isn't there has the place of the next one that is.
    """
    return F.length(F.regexp_replace(F.substring(body, F.lit(1), char), r"[\x{AD}\r]", ""))


def reading_order(boxes: DataFrame, by: str, key: str) -> DataFrame:
    """``boxes`` (struct ``box``) with ``place``: from the top down, then from the left, ties by key. The bound is a page."""
    order = Window.partitionBy(by).orderBy(F.desc("box.y1"), "box.x0", key)
    return boxes.withColumn("place", F.row_number().over(order))


def calculation_order(fields: DataFrame, by: str, listed: str, key: str) -> DataFrame:
    """Fields with ``turn``: those that the order lists first, as listed, then the others by key. The bound is a form."""
    return fields.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(F.col(listed).asc_nulls_last(), key)))
