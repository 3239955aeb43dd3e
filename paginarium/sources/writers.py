"""Sinks: JSON lines, texts with form feeds between pages, a file for each page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORM_FEED = "\f"


def with_form_feeds(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text): each document's pages in order with a form feed between two. A null page counts as empty.

    The pages of one document meet in one row: the bound is a document, not the table.
    """
    row = F.struct(F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(row)), lambda x: x["text"])
    return pages.groupBy(doc).agg(F.array_join(ordered, FORM_FEED).alias("text"))


def write_texts(pages: DataFrame, doc: str, page: str, text: str, path: str) -> None:
    """One text file part per task, a document a record; records end with a line break after a form feed."""
    with_form_feeds(pages, doc, page, text).select(F.concat("text", F.lit(FORM_FEED)).alias("value")).write.text(path)


def write_json_lines(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Every row as one JSON object; fields that are null are written as null."""
    rows.select(*(columns or rows.columns)).write.option("ignoreNullFields", "false").json(path)


def write_pages(pages: DataFrame, doc: str, page: str, text: str, path: str) -> None:
    """A folder for each document and page. Only for selections that users want as files: it makes a file a page."""
    pages.select(F.col(doc), F.col(page), F.coalesce(F.col(text), F.lit("")).alias("value")).write.partitionBy(doc, page).text(path)


def as_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
