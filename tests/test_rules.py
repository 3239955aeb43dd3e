"""Line, mask, date, number and geometry rules by stated values; arrays and differences by brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paginarium.functions import arrays, dates, geometry, masks, numbers, text, wrapping
from paginarium.operators import pages, search, structure
from paginarium.sources import readers, writers

NOW = 1_399_672_130_000  # 9 May 2014 21:48:50


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r["y"] for r in rows.select("k", column.alias("y")).orderBy("k").collect()]


X = None


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


def test_lines_are_joined(spark):
    cases = {
        ("hyphen-", "ated"): "hyphenated", ("state-of-", "the-art"): "state-of-the-art", ("non-", "English"): "non-English", ("COVID-", "19"): "COVID-19", ("a", "b"): "a b",
        ("日本", "語"): "日本語", ("한국", "어"): "한국 어", ("x-", "-y"): "x- -y", ("state-", "of-", "the-art"): "state-of-the-art", ("end  ", "  next  "): "end next  ", (): "", ("only",): "only",
    }
    assert values(spark, wrapping.joined(X), [list(k) for k in cases], "array<string>") == list(cases.values())


def test_words_folios_and_leaders(spark):
    assert values(spark, wrapping.word_count(X), ["two words", "日本語の文章", "a 漢", "", "...", "ไทย"]) == [2, 3, 2, 0, 1, 2]
    assert values(spark, wrapping.is_folio(X), ["7", "- 7 -", "1 / 11 www.example.com", "PAGE 3 of 9", "Page three", "", "http://x.y"]) == [True, True, True, True, False, False, True]
    assert values(spark, wrapping.is_leader_entry(X), ["Intro ..... 4", "Intro .... 4", "1.2 x . . . . . 12 ", "no"]) == [True, False, True, False]
    assert values(spark, wrapping.table_cell(X), [" a|b\n# c ", "*x*"]) == ["a\\|b \\# c", "\\\\*x\\*"]


def test_printx(spark):
    assert values(spark, masks.printx("(999) 999-9999", X), ["5558675309", "555-867-53", ""]) == ["(555) 867-5309", "(555) 867-53", "() -"]
    assert values(spark, masks.printx(">AA<X=*\\9", X), ["a1bCd-e", "Z"]) == ["ABcd-e9", "Z9"]
    assert values(spark, masks.printf("%5d|%-5d|%05d|%+d|%x", *[X] * 5), [42, -7], "int") == ["   42|42   |00042|+42|2a", "   -7|-7   |-0007|-7|fffffff9"]
    assert values(spark, masks.printf("%,2.2f %%", X), [1234567.891, -0.5], "double") == ["1.234.567,89 %", "-0,50 %"]
    with pytest.raises(ValueError):
        masks.printf("%d %d", X)
    with pytest.raises(ValueError):
        masks.printf("%q", X)
    assert values(spark, F.array_join(masks.split_fields(X), "|"), ["a, b ,c", "a,", "", ","]) == ["a|b|c", "a", "", ""]


def test_dates(spark):
    scan = lambda pattern, inputs: values(spark, dates.scanned(X, pattern, NOW), inputs)
    at = 1_482_270_530_000  # 20 December 2016 21:48:50
    assert scan("mm/dd/yyyy", ["12/20/2016", "", "13/01/2016", "x"]) == [at, NOW, None, None]
    assert scan("dd/mm/yyyy", ["20/12/2016"]) == scan("yyyy/mm/dd", ["2016/12/20"]) == scan("mmm d, yy", ["dec 20, 16"]) == [at]
    assert scan("d/m/yy", ["31/12/85"]) == [504_913_730_000]  # 1985
    assert scan("HH:MM", ["7:05"]) == [NOW - ((21 - 7) * 60 + 48 - 5) * 60_000]
    assert values(spark, dates.pdf_date(X), [1_700_000_000_000], "long") == ["D:20231114221320Z00'00'"]
    assert values(spark, dates.pdf_date_to_iso(X), ["D:199812231952-08'00'", "D:2001", "x"]) == ["1998-12-23T19:52:00-08:00", "2001", "x"]
    assert values(spark, dates.printed(X, "h:MM tt, mmmmm"), [0, 43_200_000], "long") == ["12:00 am, mJanuary", "12:00 pm, mJanuary"]
    assert values(spark, dates.day_number(X), [-1, 0, 86_400_000], "long") == [-1, 0, 1]


def test_numbers(spark):
    assert values(spark, numbers.c_atof(X), ["12abc", " -3.5e2x", "e5", "1e", "."]) == [12.0, -350.0, 0.0, 1.0, 0.0]
    assert values(spark, numbers.js_number(X), ["0x1F", "", "12abc", "Infinity", " 7 "]) == [31.0, None, None, float("inf"), 7.0]
    assert values(spark, numbers.narrow_to_signed32(X), [2**31, -1, 2**32 + 5], "long") == [-(2**31), -1, 5]
    halves = numbers.stitching(X, (lambda v: v, lambda v: v + 10), (0.5,), ((0, 1), (1, 0)))
    assert values(spark, halves, [0.25, 0.5, 1.0, 9.0], "double") == [0.5, 11.0, 10.0, 10.0]


def test_geometry(spark):
    quad = values(spark, geometry.quad_box(X, 1), [[float(k) for k in range(16)], [1.0]], "array<double>")
    assert [tuple(r) for r in quad] == [(12.0, 13.0, 10.0, 11.0), (0.0, 0.0, 0.0, 0.0)]
    matrix = geometry.as_matrix(X)
    assert [tuple(r) for r in values(spark, geometry.inverse_or_zero(matrix), [[2.0, 0.0, 0.0, 4.0, 6.0, 8.0], [0.0] * 6, [1.0]], "array<double>")] == [(0.5, 0.0, 0.0, 0.25, -3.0, -2.0), (0.0,) * 6, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    white = values(spark, geometry.lab_to_rgb(X, F.lit(0.0), F.lit(0.0)), [0.0, 100.0], "double")
    assert max(white[0]) < 0.01 and min(white[1]) > 0.98


def test_running_sums_and_runs(spark):
    r = random.Random(1)
    inputs = [[], [5], [1] * 24, [r.randrange(9) for _ in range(1000)]]
    expected = [[sum(v[:k]) for k in range(len(v))] for v in inputs]
    assert values(spark, arrays.running_sums(X), inputs, "array<int>") == expected
    found = values(spark, arrays.runs(X), [["a", "a", "b", "a"], [], ["z"]], "array<string>")
    assert [[tuple(x) for x in f] if f else f for f in found] == [[(0, 2, "a"), (2, 1, "b"), (3, 1, "a")], None, [(0, 1, "z")]]


def naive_difference(left, right):
    """The recurrence as it is stated, over suffixes."""
    n, m = len(left), len(right)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            size[i][j] = size[i + 1][j + 1] + 1 if left[i] == right[j] else max(size[i + 1][j], size[i][j + 1])
    removed, added, i, j = [], [], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i] == right[j]:
            i, j = i + 1, j + 1
        elif j == m or (i < n and size[i + 1][j] >= size[i][j + 1]):
            removed.append(left[i])
            i += 1
        else:
            added.append(right[j])
            j += 1
    return removed, added


def test_line_difference_by_brute_force():
    r = random.Random(2)
    for _ in range(400):
        left, right = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        assert structure.longest_common(left, right) == naive_difference(left, right)
    long = [str(k) for k in range(3000)]
    assert structure.longest_common(long, long[:1500] + ["new"] + long[1501:]) == (["1500"], ["new"])


def test_search_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "aaa aa\nAa x"), (2, None), (3, "")], "doc_id int, text string")
    found = search.hits(docs, "aa", ignore_case=True)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2, "aaa aa"), (1, 4, 6, "aaa aa"), (1, 7, 9, "Aa x")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, search.words_with_offsets(docs).collect())) == [(1, "Aa", 7, 9), (1, "aa", 4, 6), (1, "aaa", 0, 3), (1, "x", 10, 11)]


def test_roman_beyond_four_thousand(spark):
    assert values(spark, text.roman(X), [4, 3999, 4002, 1_000_001, 0, None], "int") == ["iv", "mmmcmxcix", "mmmmii", "i", "", ""]


def test_merge_numbers_pages_across_chunks(spark):
    rows = [(v, d, p) for v in (0, 1) for d in (3, 1500, 4000) for p in (1, 2)]
    found = pages.merge(spark.createDataFrame(rows, "volume int, doc long, page int"), "volume", "doc", "page").collect()
    assert sorted((r["volume"], r["doc"], r["page"], r["merged_page"]) for r in found) == [(v, d, p, 2 * k + p) for v in (0, 1) for k, d in enumerate((3, 1500, 4000)) for p in (1, 2)]


def test_running_headers_are_taken_out(spark):
    rows = [(1, p, f"Guide\nbody {'x' * p}\nmore {chr(96 + p)}\n{p}") for p in range(1, 5)] + [(2, 1, "Guide\nsolo")]
    found = structure.without_running(spark.createDataFrame(rows, "doc int, page int, text string"), "doc", "page").collect()
    assert {(r["doc"], r["page"]): r["lines"] for r in found} == {**{(1, p): [f"body {'x' * p}", f"more {chr(96 + p)}"] for p in range(1, 5)}, (2, 1): ["Guide", "solo"]}


def test_texts_and_json_go_out_and_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a\nx"), (2, 1, None)], "doc int, page int, text string")
    writers.write_texts(rows.where("doc = 1").coalesce(1), "doc", "page", "text", f"{tmp_path}/texts")
    back = readers.read_texts(spark, f"{tmp_path}/texts").select("page", "text").collect()
    assert sorted(map(tuple, back)) == [(1, "a\nx"), (2, "b")]
    writers.write_json_lines(rows, f"{tmp_path}/json")
    again = readers.read_json_lines(spark, f"{tmp_path}/json", "doc int, page int, text string")
    assert sorted(map(str, again.drop("_corrupt").collect())) == sorted(map(str, rows.collect()))
    writers.write_pages(rows, "doc", "page", "text", f"{tmp_path}/pages")
    assert spark.read.text(f"{tmp_path}/pages").groupBy("doc", "page").count().count() == 3


def test_needles_of_several_parts(spark):
    docs = spark.createDataFrame([(1, "One two\nTHREE onetwo one  two"), (2, "漢 字漢字 x"), (3, "a b ab a"), (4, "soft\u00adware soft ware")], "doc_id int, text string")
    find = lambda needle: sorted((r["doc_id"], r["start"], r["end"]) for r in search.phrase_hits(docs, needle).collect())
    assert find("one two") == [(1, 0, 7), (1, 21, 29)]
    assert find("two three") == [(1, 4, 13)]
    assert find("漢字") == [(2, 0, 3), (2, 3, 5)]
    assert find(" b ") == [(3, 1, 4)]
    assert find("a ") == [(3, 0, 2)]
    assert find("software") == [(4, 0, 9)]
    assert find("   ") == [] and find("") == []


def test_list_labels_and_breaks(spark):
    from paginarium.functions import text

    lines = ["2.1 Scope", "（1）显示", "（一）子", "一、款", "1.1、項", "12) b", "1234. no", "3.x", "7.", "2.1", "１２. wide", "2.1.3 deep"]
    frame = spark.createDataFrame([(x,) for x in lines], "x string")
    found = [r[0] for r in frame.select(text.leading_number(F.col("x"))).collect()]
    assert found == ["2.1", "（1）", "（一）", "一、", "1.1、", "12)", None, None, None, None, "１２.", "2.1.3"]
    leaders = {"Intro ..... 4": "Intro ... 4", "a . . . . . 7": "a ... 7", "one ... two": "one ... two", ".....": " ... ", "x. . . .y": "x. . . .y"}
    assert [r[0] for r in spark.createDataFrame([(x,) for x in leaders], "x string").select(text.short_leaders(F.col("x"))).collect()] == list(leaders.values())
    pairs = [("a damaged", "table"), ("It ends.", "and yet"), ("買賣有價", "證券"), ("事項。", "證券"), ("Intro", "The"), ("he said “no”", "then"), ("(x)", "y")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in frame.select(text.carries_on(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False, False, False]


def test_numbers_of_fields(spark):
    from paginarium.functions import forms

    valid = {"": False, "  ": False, "xyz00": False, "1%": False, "0x234": False, "+123": True, "  345 ": True, "-1e5": False, "-2e": False, "e-5": True, "1e-9": True, "-1.23e+23": True, "1,000,000": False, "560,024": True, ".356089": True, "1e-9.5": True, ".": True, "1-2": False, "5\n": False}
    frame = spark.createDataFrame([(x,) for x in valid], "x string")
    assert [r[0] for r in frame.select(forms.is_number(F.col("x"))).collect()] == list(valid.values())
    made = {"0x1F": 31.0, "12d": 0.0, "7f": 0.0, "1,5": 1.5, " 2 ": 2.0, "junk": 0.0, "": 0.0}
    frame = spark.createDataFrame([(x,) for x in made], "x string")
    assert [r[0] for r in frame.select(forms.make_number(F.col("x"))).collect()] == list(made.values())
    fields = spark.createDataFrame([(4.0,), (None,), (-2.0,)], "x double")
    assert [fields.agg(forms.simple_calculate(op, F.col("x"))).first()[0] for op in ("SUM", "PRD", "MIN", "MAX")] == [2.0, 0.0, -2.0, 4.0]
    assert fields.agg(forms.simple_calculate("AVG", F.col("x"))).first()[0] == pytest.approx(2 / 3, abs=1e-6)


def test_guessed_dates(spark):
    import datetime

    from paginarium.functions import dates

    now = 1_700_000_000_000
    cases = {"12/25": (2023, 12, 25), "25/12": (2023, 12, 25), "2024-2-31": (2024, 3, 2), "3 4 1999": (1999, 3, 4), "14/3/1999": (1999, 3, 14), "1/2/3": (2023, 11, 14), "20240115": (2023, 11, 14), "7": None, "none": None, "25.13.": (2023, 11, 14), "1999/3/14 10:30": (1999, 3, 14)}
    found = [r[0] for r in spark.createDataFrame([(x,) for x in cases], "x string").select(dates.guessed(F.col("x"), now)).collect()]
    at = lambda d: None if d is None else int((datetime.datetime(*d, 22, 13, 20) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    # eight digits are two numbers of four, which are no month and day
    assert found == [at(d) for d in cases.values()]


def test_long_rows_take_time_in_proportion(spark):
    import time

    from paginarium.functions.arrays import running_sums

    def took(n):
        frame = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("v")).select(running_sums(F.col("v")).alias("s"))
        began = time.time()
        last = frame.select(F.element_at("s", -1)).first()[0]
        assert last == n * (n - 1) // 2
        return time.time() - began

    took(1000)
    small, large = took(30_000), took(300_000)
    assert large < 30 * max(small, 0.2)


def test_newest_is_an_aggregate(spark):
    from paginarium.operators import structure

    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (None, 1, "c"), (None, 2, None), (2, None, "d")], "k int, at int, v string")
    found = structure.newest(rows, "k", ["at"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 7, "b"), (None, 2, None), (2, None, "d")], key=str)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
