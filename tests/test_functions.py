"""Text, form and page functions on small literal rows, and the stream operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paginarium.functions import forms, text
from paginarium.operators import pages, search, structure
from paginarium.streaming import windows


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column).collect()]


def test_running_key(spark):
    assert values(spark, text.running_key(F.col("x")), ["Page 3 of 11", "  Quick   Guide ", "v2.10a", None]) == ["Page # of #", "Quick Guide", "v#.#a", None]


def test_markers_and_ligatures(spark):
    assert values(spark, text.line_class(F.col("x")), ["• a", "- b", "12. c", "3) d", "-e", "plain"]) == ["bullet", "bullet", "numbered", "numbered", "body", "body"]
    assert values(spark, text.short_leaders(text.without_ligatures(F.col("x"))), ["ﬁnd ﬂow ....... 7"]) == ["find flow ... 7"]


def test_numerals(spark):
    assert values(spark, text.roman(F.col("x")), [0, 4, 1994], "int") == ["", "iv", "mcmxciv"]
    assert values(spark, text.letters(F.col("x")), [0, 1, 26, 27], "int") == ["", "a", "z", "aa"]


def test_form_formats(spark):
    assert values(spark, forms.number_format(F.col("x"), 2, 2, 2, "€", False), [-1234.5, 0.0], "double") == ["(1.234,50€)", "0,00€"]
    assert values(spark, forms.percent_format(F.col("x"), 1), [0.125, -0.5], "double") == ["12.5%", "-50.0%"]
    assert values(spark, forms.special_format(F.col("x"), 2), ["5551234", "a555-123-4567"]) == ["555-1234", "(555) 123-4567"]
    assert values(spark, forms.extract_numbers(F.col("x")), [".5 and 12", "none"]) == [["0", "5", "12"], None]
    assert values(spark, forms.make_number(F.col("x")), ["1,5", "junk", ""]) == [1.5, 0.0, 0.0]
    with pytest.raises(ValueError):
        forms.simple_calculate("MEDIAN", F.col("x"))


def test_empty_group_gives_the_identity(spark):
    empty = spark.createDataFrame([], "x double")
    assert empty.agg(forms.simple_calculate("PRD", F.col("x"))).first()[0] == 1.0
    assert empty.agg(forms.simple_calculate("SUM", F.col("x"))).first()[0] == 0.0


def test_hits(spark):
    docs = spark.createDataFrame([(1, "aXa aXa\nxa aXaXa"), (2, None), (3, "nothing")], "doc_id long, text string")
    found = sorted(map(tuple, search.hits(docs, "aXa").select("start", "end", "line").collect()))
    assert found == [(0, 3, "aXa aXa"), (4, 7, "aXa aXa"), (11, 14, "xa aXaXa")]
    assert [r["start"] for r in search.hits(docs, "AXA", ignore_case=True, whole_word=True).orderBy("start").collect()] == [0, 4]


def test_page_selection(spark):
    rows = spark.createDataFrame([(1, p) for p in range(1, 6)], "doc int, page int")
    picked = pages.select_pages(rows, "doc", "page", "2,5,3-end").orderBy("position").collect()
    assert [r["page"] for r in picked] == [2, 5, 3, 4, 5]
    assert {r["page"] for r in pages.delete_pages(rows, "doc", "page", "1,4-end").collect()} == {2, 3}
    for bad in ("0", "3-2", "x", ""):
        with pytest.raises(ValueError):
            pages.selected_numbers(bad, F.lit(5))


def test_booklet(spark):
    rows = spark.createDataFrame([(1, p) for p in range(1, 7)], "doc int, page int")
    assert [r["page"] for r in pages.booklet(rows, "doc").orderBy("position").collect()] == [8, 1, 2, 7, 6, 3, 4, 5]


def test_running_lines(spark):
    rows = [(1, p, f"Guide\nbody {chr(96 + p)} one\nPage {p} of 4") for p in range(1, 5)]
    found = structure.running_lines(spark.createDataFrame(rows, "doc int, page int, text string"), "doc", "page").collect()
    assert {(r["band"], r["key"], r["pages"]) for r in found} == {("top", "Guide", 4), ("bottom", "Page # of #", 4)}


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.counted(windows.stream_of(spark, str(tmp_path / "in"), events))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, windows.counted(events).collect()))


def test_streamed_documents_come_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").withColumn("seen", F.current_timestamp())
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.first_seen(windows.stream_of(spark, str(tmp_path / "in"), docs), "seen", "1 hour")
    query = stream.writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["text"] for r in spark.table("once").collect()) == ["a", "b"]


def test_as_of_and_reachability(spark):
    from paginarium.operators import lookup

    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, at int, name string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 6, 60), (3, 1, 1)], "k int, at int, v int")
    assert {(r["name"], r["seen"]) for r in lookup.as_of(left, right, "k", "at", "v", "seen").collect()} == {("a", 50), ("b", None), ("c", None)}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    found = lookup.reachable(edges, spark.createDataFrame([(1,)], "node int"))
    assert {(r["node"], r["steps"]) for r in found.collect()} == {(1, 0), (2, 1), (3, 2)}
