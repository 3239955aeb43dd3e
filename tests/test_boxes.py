"""Sweeps, layout, spaces and selection against plain loops."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from paginarium.functions import spacing
from paginarium.operators import selection, sweep

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def pages(seed, n, spread):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = r.randint(0, spread), r.randint(0, spread)
        rows.append((r.choice([1, 1, 1, 2, None]), k, f"w{k}", (float(x), float(y), float(x + r.randint(-3, 12)), float(y + r.randint(-2, 9)))))
    return rows + [(2, n, "nan", (float("nan"), 1.0, 2.0, 3.0)), (2, n + 1, "none", None), (3, n + 2, "one", (1.0, 1.0, 2.0, 2.0))]


def plain_islands(spans, slack):
    """Island of each (start, end), by a loop over sorted distinct starts."""
    best = {}
    for s, e in spans:
        best[s] = max(best.get(s, e), e, s)
    of, reached, n = {}, None, -1
    for s in sorted(best):
        n += reached is None or s >= reached + slack
        of[s] = n
        reached = best[s] if reached is None else max(reached, best[s])
    return [of[s] for s, _ in spans]


def plain_lines(rows, wide):
    out = {}
    for page in {p for p, *_ in rows}:
        own = [(k, b) for p, k, _, b in rows if p == page and b is not None and b[0] == b[0]]
        row = plain_islands([(-max(b[1], b[3]), -min(b[1], b[3])) for _, b in own], 0)
        for r in set(row):
            inside = [kb for kb, x in zip(own, row) if x == r]
            part = plain_islands([(min(b[0], b[2]), max(b[0], b[2])) for _, b in inside], wide)
            out.update({(page, k): (r, x) for (k, _), x in zip(inside, part)})
    return {(p, k): out.get((p, k), (None, None)) for p, k, *_ in rows}


@pytest.mark.parametrize("seed, n, spread, wide, strip", [(1, 300, 200, 6, 64.0), (2, 200, 900, 1, 5.0), (3, 60, 20, 2, 1.0), (4, 150, 3000, 20, 64.0)])
def test_visual_lines_equal_a_loop(spark, seed, n, spread, wide, strip):
    rows = pages(seed, n, spread)
    frame = spark.createDataFrame(rows, f"page int, k int, word string, box {BOX}").repartition(4)
    found = sweep.visual_lines(frame, "page", wide, strip, None if seed % 2 else strip).collect()
    assert {(f["page"], f["k"]): (f["row"], f["part"]) for f in found} == plain_lines(rows, wide)
    assert len(found) == len(rows)


def test_lines_read_from_the_left(spark):
    rows = [(1, 0, "b", (20.0, 0.0, 30.0, 10.0)), (1, 1, "a", (0.0, 1.0, 9.0, 11.0)), (1, 2, "a2", (0.0, 1.0, 9.0, 11.0)), (1, 3, "far", (99.0, 2.0, 120.0, 8.0)), (1, 4, "under", (0.0, -20.0, 5.0, -12.0))]
    lines = sweep.line_texts(sweep.visual_lines(spark.createDataFrame(rows, f"page int, k int, word string, box {BOX}"), "page", 40), "page", "word", "k")
    assert sorted((f["row"], f["part"], f["text"], f["words"]) for f in lines.collect()) == [(0, 0, "a a2 b", 3), (0, 1, "far", 1), (1, 0, "under", 1)]


def test_one_page_of_a_million_boxes_is_dealt(spark):
    """No window of the sweep has a page's boxes in one partition: only starts summed up, by strip."""
    n = 1_000_000
    k = F.col("id")
    frame = spark.range(n).select(F.lit(1).alias("page"), k.alias("k"), F.struct((k % 997).alias("x0"), (k % 50_000).alias("y0"), (k % 997 + 3).alias("x1"), (k % 50_000 + k % 2).alias("y1")).alias("box"))
    began = time.time()
    rows = sweep.islands(frame.withColumn("_t", -F.col("box.y1")).withColumn("_b", -F.col("box.y0")), ["page"], "_t", "_b", "row")
    assert rows.agg(F.count("row"), F.countDistinct("row")).first()[:] == (n, 25_000 + 1)
    assert time.time() - began < 120
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(page#" in plan and "_strip#" in plan


def plain_layout(lines, body):
    ordered = sorted(lines, key=lambda t: (-t[1], t[0], t[2]))
    rows = []
    for line in ordered:
        if rows and abs(rows[-1][0][1] - line[1]) < body * 0.5:
            rows[-1].append(line)
        else:
            rows.append([line])
    out, bottom = "", None
    for row in rows:
        if bottom is not None:
            out += "\n" * int(min(max((bottom - (row[0][1] + 10)) // (body * 1.2), 0), 3))
        bottom, text = row[0][1], ""
        for x, _, word in row:
            cell = min(max(int(x / (body * 0.5) + 0.5), 0), 4096)
            text = text.ljust(cell) if cell > len(text) else text + " " * bool(text)
            text += word
        out += text.rstrip() + "\n"
    return out


def test_layout_keeps_columns_and_gaps(spark):
    r = random.Random(6)
    cases = {1: [(0.0, 60.0, "below"), (0.0, 100.0, "left"), (300.0, 100.0, "right")], 2: [(r.choice([0.0, 90.0, 200.0]), float(r.randint(0, 300)), f"t{k}" * r.randint(1, 9)) for k in range(60)], 3: [(-50.0, 5.0, "out "), (9e9, 5.0, "far")]}
    rows = [(p, w, (x, y, x + 50, y + 10)) for p, lines in cases.items() for x, y, w in lines]
    frame = spark.createDataFrame(rows, f"page int, text string, box {BOX}")
    found = sweep.layout_text(sweep.layout_rows(frame, "page", F.lit(10.0), F.lit(0.0)), "page")
    assert {f["page"]: f["text"] for f in found.collect()} == {p: plain_layout(lines, 10.0) for p, lines in cases.items()}
    assert plain_layout(cases[1], 10.0).split("\n")[0] == "left" + " " * 56 + "right"


def test_spaces_follow_the_recurrence(spark):
    r = random.Random(9)
    rows = [(r.choice([-3.0, 0.0, 5.0, 9.5, 12.0, 30.0]), r.choice([0.0, 4.0, 8.0]), float(r.randint(0, 900)), float(r.randint(0, 12)), r.choice([None, 0.0, 250.0, 400.0])) for _ in range(300)]
    size = 10.0

    def threshold(space, width):
        t = 0.0 if space is None else size * space / 1000
        t = 0.0 if t > size / 3 else t / 2
        return t or size * (width / (2 if width < 300 else 4 if width < 500 else 5 if width < 700 else 6)) / 1000

    def space(x, last, wide, last_wide, t):
        if abs(last + last_wide - x) <= t:
            return False
        return abs(x - last) > t + last_wide or (x < 0 and -(t + last_wide) > x - last) or x - last > wide + last_wide

    frame = spark.createDataFrame(rows, "x double, last double, width double, last_wide double, space double")
    c = F.col
    t = spacing.space_threshold(F.lit(size), c("space"), c("width"))
    found = frame.select(t.alias("t"), spacing.leaves_space(c("x"), c("last"), c("width") * size / 1000, c("last_wide"), t).alias("s")).collect()
    for row, f in zip(rows, found):
        expected = threshold(row[4], row[2])
        assert f["t"] == pytest.approx(expected) and f["s"] == space(row[0], row[1], row[2] * size / 1000, row[3], expected)


def plain_at(point, boxes, tolerance):
    best, nearest = 10_000, None
    x, y = point
    for k, (x0, y0, x1, y1) in boxes:
        if x0 <= x <= x1 and y0 <= y <= y1:
            return k
        if max(tolerance) <= 0:
            continue
        l, r, b, t = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)  # noqa: E741
        if l - tolerance[0] / 2 <= x <= r + tolerance[0] / 2 and b - tolerance[1] / 2 <= y <= t + tolerance[1] / 2:
            away = min(abs(x - l), abs(x - r)) + min(abs(y - b), abs(y - t))
            if away < best:
                best, nearest = away, k
    return nearest


@pytest.mark.parametrize("tolerance, crowd", [((0.0, 0.0), 2000), ((10.0, 6.0), 2000), ((10.0, 6.0), 3), ((4.0, 0.0), 2000)])
def test_boxes_at_points_equal_a_loop(spark, tolerance, crowd, monkeypatch):
    monkeypatch.setattr(selection, "CROWD", crowd)
    r = random.Random(int(tolerance[0]) + crowd)
    boxes = []
    for k in range(80):
        x, y = float(r.randint(-90, 90)), float(r.randint(-90, 90))
        boxes.append((r.choice([1, 2]), k, (x, y, x + r.choice([0, 3, 9, 70, -5]), y + r.choice([0, 4, 8, 300]))))
    boxes += [(1, 80, (-5000.0, -5000.0, 5000.0, -40.0)), (2, 81, (float("nan"), 0.0, 1.0, 1.0)), (2, 82, None)]
    points = [(r.choice([1, 2, 3]), k, float(r.randint(-100, 100)), float(r.randint(-100, 100))) for k in range(200)] + [(1, 900, None, 1.0), (1, 901, 32.0, 32.0)]
    found = selection.boxes_at_points(spark.createDataFrame(points, "page int, point int, x double, y double"), spark.createDataFrame(boxes, f"page int, k int, box {BOX}"), "page", "point", "k", tolerance)
    expected = {(p, i): None if x is None else plain_at((x, y), [(k, b) for q, k, b in boxes if q == p and b and b[0] == b[0]], tolerance) for p, i, x, y in points}
    assert {(f["page"], f["point"]): f["k"] for f in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_boxes_and_no_points(spark):
    boxes, points = spark.createDataFrame([], f"page int, k int, box {BOX}"), spark.createDataFrame([(1, 1, 0.0, 0.0)], "page int, point int, x double, y double")
    assert [f["k"] for f in selection.boxes_at_points(points, boxes, "page", "point", "k").collect()] == [None]
    assert selection.boxes_at_points(points.limit(0), boxes, "page", "point", "k").count() == 0


def test_boxes_in_rects_equal_a_loop(spark):
    r = random.Random(31)

    def some(n, sizes):
        for k in range(n):
            x, y = float(r.randint(-200, 200)), float(r.randint(-200, 200))
            yield r.choice([1, 2]), k, (x, y, x + r.choice(sizes), y + r.choice(sizes))

    boxes, rects = list(some(120, [0, 5, 20, 400])), list(some(40, [1, 30, 100, 2000]))
    found = selection.boxes_in_rects(spark.createDataFrame(rects, f"page int, rect int, area {BOX}"), spark.createDataFrame(boxes, f"page int, k int, box {BOX}"), "page", "rect", "k")
    meet = lambda a, b: min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])
    assert sorted(map(tuple, found.collect())) == sorted((p, i, k) for p, i, a in rects for q, k, b in boxes if p == q and meet(a, b))


def plain_text(chars):
    out, base, had, armed = "", 0.0, False, False
    for ch, line, chosen in chars:
        if chosen:
            if base != line and not had and armed:
                base = line
                out += "\r\n" * bool(out)
            had, armed = True, False
            out += ch
        elif ch == " ":
            if had:
                out += " "
                had = armed = False
        else:
            had, armed = False, True
    return out


def test_selected_text_equals_the_walk(spark):
    r = random.Random(77)
    rows, expected = [], {}
    for sel in range(60):
        chars = [(r.choice("ab  c"), float(-(k // 5)), r.random() < r.choice([0.2, 0.8])) for k in range(r.randint(1, 30))]
        rows += [(sel, k, *c) for k, c in enumerate(chars)]
        expected[sel] = plain_text(chars)
    found = selection.text_of_selected(spark.createDataFrame(rows, "sel int, k int, char string, line double, selected boolean").repartition(3), ["sel"], "k")
    assert {f["sel"]: f["text"] for f in found.collect()} == expected


def test_boxes_around_ranges(spark):
    boxes = [(0, 0, 5, 10, 0, False), (5, 0, 10, 10, 0, False), (10, 0, 15, 10, 1, False), (15, 0, 15, 10, 1, False), (16, 0, 20, 12, 1, True), (20, 0, 25, 10, 0, False)]
    frame = spark.createDataFrame([(boxes,)], "b array<struct<x0:int,y0:int,x1:int,y1:int,object:int,made:boolean>>")
    of = lambda a, b: [tuple(x) for x in frame.select(selection.around_range(F.col("b"), F.lit(a), F.lit(b)).alias("f")).first()["f"]]
    assert of(0, 99) == [(0, 0, 10, 10), (10, 0, 15, 10), (20, 0, 25, 10)]
    assert of(3, 5) == [(0, 0, 0, 0)] and of(2, 2) == [] and of(6, 9) == [] and of(1, 3) == [(5, 0, 10, 10), (10, 0, 15, 10)]
