"""Page selection, reordering, imposition and labels over tables of (document, page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selected_numbers(spec: str, count: Column) -> Column:
    """The page numbers (from 1) that a specification such as ``2,5,3-end`` names, in order, repeats kept.

    ``end`` is the last page. A specification that names page 0 or runs backwards is
    an error whatever the document; pages beyond a document's last are null.
    """
    parts = []
    for entry in spec.split(","):
        low, dash, high = (x.strip() for x in entry.partition("-"))
        for x in (low, high) if dash else (low,):
            if x != "end" and not (x.isdigit() and int(x) > 0):
                raise ValueError(f"no page {x!r} in {spec!r}")
        if dash and low != "end" and high != "end" and int(high) < int(low):
            raise ValueError(f"backwards range in {spec!r}")
        at = lambda x: count if x == "end" else F.lit(int(x))
        if not dash:
            parts.append(F.array(at(low).cast("int")))
        else:
            first, last = at(low).cast("int"), at(high).cast("int")
            parts.append(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    return F.filter(F.flatten(F.array(*parts)), lambda n: n <= count)


def select_pages(pages: DataFrame, doc: str, page: str, spec: str) -> DataFrame:
    """The selected pages with ``position`` (from 1). ``page`` counts from 1 in each document."""
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).cast("int").alias("count"))
    wanted = counts.select(doc, F.posexplode(selected_numbers(spec, F.col("count"))).alias("position", page))
    return wanted.withColumn("position", F.col("position") + 1).join(pages, [doc, page])


def delete_pages(pages: DataFrame, doc: str, page: str, spec: str) -> DataFrame:
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).cast("int").alias("count"))
    gone = counts.select(doc, F.explode(selected_numbers(spec, F.col("count"))).alias(page))
    return pages.join(gone, [doc, page], "left_anti")


def booklet(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, position, page, blank): saddle-stitch order of each document, padded to whole sheets of four.

    A sheet's front is last and first, its back second and second to last, inwards.
    """
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("count"))
    padded = (F.ceil(F.col("count") / 4) * 4).cast("int")
    place = counts.withColumn("padded", padded).select(doc, "count", "padded", F.explode(F.sequence(F.lit(0), F.col("padded") - 1)).alias("k"))
    sheet = F.floor(F.col("k") / 4)
    page = (
        F.when(F.col("k") % 4 == 0, F.col("padded") - 2 * sheet).when(F.col("k") % 4 == 1, 2 * sheet + 1)
        .when(F.col("k") % 4 == 2, 2 * sheet + 2).otherwise(F.col("padded") - 1 - 2 * sheet)
    )
    return place.select(doc, (F.col("k") + 1).alias("position"), page.cast("int").alias("page"), (page > F.col("count")).alias("blank"))


def n_up(pages: DataFrame, page: str, columns: int, rows: int) -> DataFrame:
    """Each page with its sheet and its cell (row, column) there, all from 0."""
    cell = (F.col(page) - 1) % (columns * rows)
    return (
        pages.withColumn("sheet", F.floor((F.col(page) - 1) / (columns * rows)).cast("int"))
        .withColumn("sheet_row", F.floor(cell / columns).cast("int")).withColumn("sheet_column", (cell % columns).cast("int"))
    )


def merge(pages: DataFrame, into: str, doc: str, page: str, chunk: int = 1024) -> DataFrame:
    """Pages of several documents as pages of one (``merged_page`` from 1), by numeric document id and page.

    Pages are numbered within their document only; what comes before a document is the sum
    of page counts, added up over chunks of ids and then within a chunk. So a volume that
    holds a third of all pages meets in no task.
    """
    counts = pages.groupBy(into, doc).agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", F.floor(F.col(doc) / chunk))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    chunks = counts.groupBy(into, "chunk").agg(F.sum("n").alias("n"))
    chunks = chunks.select(into, "chunk", F.coalesce(F.sum("n").over(before(into).orderBy("chunk")), F.lit(0)).alias("chunks_before"))
    placed = counts.withColumn("within", F.coalesce(F.sum("n").over(before(into, "chunk").orderBy(doc)), F.lit(0))).join(chunks, [into, "chunk"])
    placed = placed.select(into, doc, (F.col("chunks_before") + F.col("within")).alias("pages_before"))
    numbered = pages.withColumn("own", F.row_number().over(Window.partitionBy(into, doc).orderBy(page)))
    return numbered.join(placed, [into, doc]).withColumn("merged_page", (F.col("pages_before") + F.col("own")).cast("int")).drop("pages_before", "own")


def page_labels(pages: DataFrame, ranges: list[tuple[int, str, str, int]], page: str) -> DataFrame:
    """Each page's label by the last range that starts at or before it.

    ``ranges``: (start, style, prefix, first), a few that hold for all documents;
    styles D, R, r, A, a, anything else gives the prefix alone. They become one
    literal array, so there is no join.
    """
    from paginarium.functions.text import letters, roman

    names = ("start", "style", "prefix", "first")
    held = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in sorted(ranges)])
    r = F.get(F.filter(held, lambda x: x["start"] <= F.col(page)), F.size(F.filter(held, lambda x: x["start"] <= F.col(page))) - 1)
    number = F.col(page) - F.col("r.start") + F.col("r.first")
    portion = (
        F.when(F.col("r.style") == "D", number.cast("string")).when(F.col("r.style") == "r", roman(number)).when(F.col("r.style") == "R", F.upper(roman(number)))
        .when(F.col("r.style") == "a", letters(number)).when(F.col("r.style") == "A", F.upper(letters(number))).otherwise("")
    )
    return pages.withColumn("r", r).withColumn("label", F.concat("r.prefix", portion)).drop("r")
