"""Running lines, list groups, links, outlines, comparison and digests of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paginarium.functions.arrays import runs
from paginarium.functions.text import line_class, lines, running_key
from paginarium.functions.wrapping import candidates, simple_lower, web_address

HEADING = r"(?is)<h[1-6][ >].*?</h[1-6]>"
MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"


def band_lines(pages: DataFrame, doc: str, page: str, depth: int = 1) -> DataFrame:
    """(doc, page, band, key, line): the first and last ``depth`` lines of each page."""
    cut = pages.select(doc, page, lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    top = F.transform(F.slice("lines", 1, depth), lambda x: F.struct(F.lit("top").alias("band"), x.alias("line")))
    n = F.least(F.lit(depth), F.size("lines"))
    bottom = F.transform(F.slice("lines", -n, n), lambda x: F.struct(F.lit("bottom").alias("band"), x.alias("line")))
    each = cut.select(doc, page, F.explode(F.concat(top, bottom)).alias("x"))
    return each.select(doc, page, "x.band", running_key(F.col("x.line")).alias("key"), "x.line")


def running_lines(pages: DataFrame, doc: str, page: str, min_pages: int = 3, share: float = 0.5, depth: int = 1) -> DataFrame:
    """(doc, band, key, pages): keys in the band of at least ``min_pages`` and more than ``share`` of the pages."""
    total = pages.groupBy(doc).agg(F.countDistinct(page).alias("total"))
    keys = band_lines(pages, doc, page, depth).select(doc, page, "band", "key").distinct()
    counted = keys.groupBy(doc, "band", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return counted.join(total, doc).where(F.col("pages") > F.col("total") * share).select(doc, "band", "key", "pages")


def list_groups(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, group, class, first_line, n_lines): runs of lines of one class, found within the row."""
    found = runs(F.transform(lines(F.col("text")), line_class))
    each = docs.select(doc, F.posexplode(found).alias("g", "run"))
    return each.select(doc, (F.col("g") + 1).cast("long").alias("group"), F.col("run.value").alias("class"), F.col("run.first").alias("first_line"), F.col("run.n").cast("long").alias("n_lines"))


def web_links(pages: DataFrame, key: str, marked_up: Column) -> DataFrame:
    """(key, n, uri): the addresses of a marked-up page, where quotes and angle brackets also end a candidate."""
    return web_addresses(pages, key, F.regexp_replace(marked_up, "[\"'<>]", " "))


def mail_links(rows: DataFrame, key: str, text: Column) -> DataFrame:
    found = F.regexp_extract_all(text, F.lit(f"({MAIL})"))
    return rows.select(key, F.posexplode(F.transform(found, lambda u: F.concat(F.lit("mailto:"), u))).alias("n", "uri"))


def outline(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, n, depth, title): the headings of a page's mark-up in order of place, without mark-up inside them."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(f"({HEADING})"), F.lit(1))).alias("n", "tag"))
    title = F.trim(F.regexp_replace(F.regexp_replace("tag", "<[^>]*>", ""), r"[ \t\r\n]+", " "))
    return found.select(key, "n", F.substring("tag", 3, 1).cast("int").alias("depth"), title.alias("title"))


#: What of a marked-up page holds no elements, the tags looked for, and tags that never hold others (fixed values).
NO_ELEMENTS, TAG = "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "</?[a-z][a-z0-9]*"
VOID = ["<br", "<hr", "<img", "<input", "<link", "<meta"]


def tags(html: str) -> Column:
    """The opening and closing tags of a marked-up page in order, outside scripts, styles and comments."""
    return F.regexp_extract_all(F.regexp_replace(html, NO_ELEMENTS, ""), F.lit(TAG), F.lit(0))


def elements(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, n, tag, depth): the elements of marked-up pages in order, depth 1 at the top.

    The depth is what stands open before a tag, so pages whose tags don't pair still have one (0 or less after
    too many closing tags). The window over a page holds what its one row held.
    """
    each = pages.select(page, F.posexplode(tags(html)).alias("n", "tag")).where(~F.col("tag").isin(VOID))
    change = F.when(F.col("tag").startswith("</"), -1).otherwise(1)
    before = F.sum(change).over(Window.partitionBy(page).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    found = each.withColumn("depth", (F.coalesce(before, F.lit(0)) + 1).cast("int"))
    return found.where(~F.col("tag").startswith("</")).withColumn("tag", F.substring("tag", 2, 100))


def line_changes(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page, removed, added): how each page's lines differ from the page before, as sets in order."""
    before = F.lag("lines", 1).over(Window.partitionBy(doc).orderBy(page))
    each = pages.select(doc, page, lines(F.col("text")).alias("lines")).withColumn("before", F.coalesce(before, F.array().cast("array<string>")))
    return each.select(doc, page, F.array_except("before", "lines").alias("removed"), F.array_except("lines", "before").alias("added"))


def longest_common(left: list[str], right: list[str]) -> tuple[list[str], list[str]]:
    """Lines only left and only right of a longest common subsequence; on ties left lines go first.

    Of the table of lengths a row at a time is kept, and of each cell one bit: whether the
    left line goes. Equal first lines are skipped beforehand.
    """
    same = 0
    while same < min(len(left), len(right)) and left[same] == right[same]:
        same += 1
    left, right = left[same:], right[same:]
    index: dict[str, int] = {}
    a, b = (np.array([index.setdefault(x, len(index)) for x in side], np.int64) for side in (left, right))
    n, m = len(a), len(b)
    row, goes = np.zeros(m + 1, np.int32), [np.zeros(0, np.uint8)] * n
    for i in range(n - 1, -1, -1):
        reach = np.append(np.maximum(row[:-1], np.where(b == a[i], row[1:] + 1, 0)), 0)
        new = np.maximum.accumulate(reach[::-1])[::-1]
        goes[i] = np.packbits(row[:-1] >= new[1:])
        row = new.astype(np.int32)
    removed, added, i, j = [], [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif goes[i][j >> 3] >> (7 - (j & 7)) & 1:
            removed.append(left[i])
            i += 1
        else:
            added.append(right[j])
            j += 1
    return removed + left[i:], added + right[j:]


def line_diff(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """The order-sensitive line difference of two arrays of lines."""
    rows = [longest_common(list(a), list(b)) for a, b in zip(left, right)]
    return pd.DataFrame({"removed": [r for r, _ in rows], "added": [a for _, a in rows]})


def consecutive_diff(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page, removed, added): the line difference of each page to the one before."""
    before = F.lag("lines", 1).over(Window.partitionBy(doc).orderBy(page))
    each = pages.select(doc, page, lines(F.col("text")).alias("lines")).withColumn("before", F.coalesce(before, F.array().cast("array<string>")))
    diff = F.pandas_udf(line_diff, "struct<removed: array<string>, added: array<string>>")
    return each.select(doc, page, diff("before", "lines").alias("d")).select(doc, page, "d.removed", "d.added")


def document_digest(pages: DataFrame, doc: str, page: str, parts: list[str]) -> DataFrame:
    """(doc, digest): SHA-256 over all pages' parts in page order."""
    row = F.struct(F.col(page).alias("page"), F.concat_ws("\u001f", *parts).alias("body"))
    ordered = F.transform(F.sort_array(F.collect_list(row)), lambda x: x["body"])
    return pages.groupBy(doc).agg(F.sha2(F.array_join(ordered, "\u001e"), 256).alias("digest"))


def weighted_mode(rows: DataFrame, by: str, value: str, weight: Column) -> DataFrame:
    """(by, value): the value with the greatest total weight, ties to the greater value."""
    votes = rows.groupBy(by, value).agg(F.sum(weight).alias("votes"))
    return votes.groupBy(by).agg(F.max(F.struct("votes", value))[value].alias(value))


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; later entries shadow earlier ones.

    An aggregate, so a key with a third of all rows is summed up where its rows lie. The
    null key is a key; of rows equal in ``order`` the greatest by their other columns stays.
    """
    row = F.struct(*order, *[c for c in rows.columns if c != key and c not in order])
    return rows.groupBy(key).agg(F.max(row).alias("row")).select(key, "row.*").select(*rows.columns)


def capped_counts(rows: DataFrame, kind: str, cap: int = 4096) -> DataFrame:
    """(kind, kept, dropped): events of each kind that a log of ``cap`` entries a kind keeps and drops."""
    n = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return n.select(kind, F.least("n", F.lit(cap)).alias("kept"), F.greatest(F.col("n") - cap, F.lit(0)).alias("dropped"))


def web_addresses(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, n, uri): the address in each candidate of a text (n is the candidate's number), by the whole rule:
    any case of the scheme, bare ``www.``, halves joined at a line end, brackets opened before, hosts trimmed."""
    each = rows.select(key, F.posexplode(candidates(text)).alias("n", "candidate"))
    return each.where(simple_lower(F.col("candidate")).rlike(r"http|www\.")).select(key, "n", web_address(F.col("candidate")).alias("uri")).where("uri IS NOT NULL")


def without_running(pages: DataFrame, doc: str, page: str, band: float = 0.12, min_pages: int = 3, share: float = 0.5) -> DataFrame:
    """(doc, page, lines): each page's lines without running headers and footers.

    A line in the top or bottom ``band`` of its page goes if its key stands in that band of at
    least ``min_pages`` pages and of more than ``share`` of the document's. Pages without a
    line left don't appear.
    """
    cut = pages.select(doc, page, lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    n, depth = F.size("lines"), F.greatest(F.lit(1), F.ceil(F.size("lines") * band).cast("int"))
    each = cut.select(doc, page, n.alias("n"), depth.alias("depth"), F.posexplode("lines").alias("i", "line"))
    place = F.when(F.col("i") < F.col("depth"), "top").when(F.col("i") >= F.col("n") - F.col("depth"), "bottom")
    each = each.select(doc, page, "i", "line", place.alias("place"), running_key(F.col("line")).alias("key"))
    # counted by page first: a document's pages never meet in one task as rows
    of_page = each.where("place IS NOT NULL").select(doc, page, "place", "key").distinct()
    total = pages.select(doc, page).distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("total"))
    running = of_page.groupBy(doc, "place", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    running = running.join(total, doc).where(F.col("pages") > F.col("total") * share).select(doc, "place", "key")
    kept = each.join(running, [doc, "place", "key"], "left_anti")
    return kept.groupBy(doc, page).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("lines"))


def as_of_revision(entries: DataFrame, key: str, revision: str, place: str, value: str, last: int) -> DataFrame:
    """(key, revision, value, versions): every key's newest entry of the revisions up to ``last``."""
    newest = F.max(F.struct(revision, place, F.col(value).alias("value")))
    found = entries.where(F.col(revision) <= last).groupBy(key).agg(newest.alias("x"), F.count(F.lit(1)).alias("versions"))
    return found.select(key, F.col(f"x.{revision}").alias("revision"), "x.value", "versions")
