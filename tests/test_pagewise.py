"""Pages that are one row each: sweeps and selection against plain loops, and pages dealt over several rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paginarium.operators import pagewise
from paginarium.plans import box_rules, registry
from test_boxes import BOX, pages, plain_at, plain_lines

SF = "/root/testdata/sf0.001"
NAMES = ("visual_lines", "visual_line_of_words", "boxes_in_rects", "boxes_at_points")


def packed(spark, rows):
    own = {}
    for page, k, word, box in rows:
        own.setdefault(page, []).append((k, word, box))
    return spark.createDataFrame(list(own.items()), f"page int, words array<struct<k:int,word:string,box:{BOX}>>").union(spark.createDataFrame([(77, []), (78, None)], f"page int, words array<struct<k:int,word:string,box:{BOX}>>")).coalesce(1)


@pytest.mark.parametrize("seed, n, spread, wide", [(1, 300, 200, 6), (2, 200, 900, 1), (3, 60, 20, 2), (4, 150, 3000, 20)])
def test_lines_of_pages_in_a_row_equal_a_loop(spark, seed, n, spread, wide):
    rows = pages(seed, n, spread)
    expected = plain_lines(rows, wide)
    frame = packed(spark, rows)
    zipped = F.arrays_zip(F.col("words.k").alias("k"), pagewise.line_of_boxes(F.col("words.box"), wide).alias("line"))
    found = {(f["page"], f["w"]["k"]): (f["w"]["line"]["row"], f["w"]["line"]["part"]) for f in frame.select("page", F.explode(zipped).alias("w")).collect()}
    assert found == expected
    lines = frame.select("page", F.explode(pagewise.visual_lines(F.col("words.box"), F.col("words.word"), wide)).alias("l")).select("page", "l.*").collect()
    texts = {}
    for page, k, word, box in rows:
        if expected[page, k][0] is not None:
            texts.setdefault((page, *expected[page, k]), []).append((min(box[0], box[2]), k, word, box))
    assert {(f["page"], f["row"], f["part"]): (f["text"], f["words"], f["x0"], f["y1"]) for f in lines} == {
        key: (" ".join(w for _, _, w, _ in sorted(v, key=lambda t: t[:2])), len(v), min(x for x, *_ in v), max(max(b[1], b[3]) for *_, b in v)) for key, v in texts.items()
    }


@pytest.mark.parametrize("tolerance, pairs", [((0.0, 0.0), 1_000_000), ((10.0, 6.0), 1_000_000), ((10.0, 6.0), 7), ((4.0, 0.0), 50)])
def test_selection_on_pages_in_a_row_equals_a_loop(spark, tolerance, pairs, monkeypatch):
    r = random.Random(pairs + int(tolerance[0]))

    def some(n, sizes):
        for k in range(n):
            x, y = float(r.randint(-90, 90)), float(r.randint(-90, 90))
            yield r.choice([1, 2]), k, "", (x, y, x + r.choice(sizes), y + r.choice(sizes))

    boxes = [*some(90, [0, 3, 9, 70, -5, 300]), (2, 90, "", (float("nan"), 0.0, 1.0, 1.0)), (2, 91, "", None)]
    rects, points = list(some(40, [1, 30, 100])), [(p, k, "", (x, y, x, y)) for p, k, _, (x, y, _, _) in some(200, [1])] + [(1, 900, "", None)]
    frame = packed(spark, boxes)
    asked = [packed(spark, rows).select(F.col("page").alias("p"), F.col("words").alias(name)) for rows, name in ((rects, "rects"), (points, "points"))]
    for other in asked:
        frame = frame.join(other, F.col("page") == F.col("p"), "left").drop("p")
    sized = pairs  # read where the function is pickled
    monkeypatch.setattr(pagewise, "PAIRS", sized)
    met = frame.select("page", "rects", pagewise.boxes_in_rects(F.col("words.box"), F.col("words.k"), F.col("rects.box")).alias("met"), "points", pagewise.boxes_at_points(F.col("words.box"), F.col("words.k"), F.col("points.box"), tolerance).alias("hit"))
    meet = lambda a, b: min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])
    for f in met.where("page < 3").collect():
        own = [(k, b) for p, k, _, b in boxes if p == f["page"] and b is not None and b[0] == b[0]]
        assert f["met"] == [[k for k, b in own if meet(rect["box"], b)] for rect in f["rects"]]
        assert f["hit"] == [None if p["box"] is None else plain_at((p["box"]["x0"], p["box"]["y0"]), own, tolerance) for p in f["points"]]


def test_long_boxes_widen_no_search_for_short_ones():
    import numpy as np

    low = np.arange(0, 2000, 2.0)
    high = np.append(low + 1, 2000.0)
    low = np.append(low, 0.0)
    pairs = sum(len(q) for q, _ in pagewise._near(low, high, np.arange(0.0, 2000.0), np.arange(0.0, 2000.0)))
    assert pairs <= 2 * 2000 + 2000


@pytest.mark.parametrize("name", NAMES)
def test_boxes_of_documents_are_not_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", NAMES)
def test_pages_in_several_rows_are_one_page(spark, tmp_path, name):
    """A document cut in two rows of one id is what its SQL sees: one page; and so is a page beside it."""
    import duckdb

    from test_queries import rows

    long = "\n".join(["a b", "c d e f g h i", "x"] * 20)
    docs = [(1, long), (1, "k\nl m\nn o p q r s t u v"), (2, long), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = registry.QUERIES[name](spark, str(tmp_path))
    if name == "visual_lines":
        assert rows(found.toPandas()) == rows(db.sql(registry.ORACLES[name]).df())
    else:  # lines of the two rows share their numbers, which SQL pairs with each other: compare the page that is whole
        assert found.where("doc_id = 1").count() > 0
        assert rows(found.where("doc_id <> 1").toPandas()) == rows(db.sql(f"SELECT * FROM ({registry.ORACLES[name]}) WHERE doc_id <> 1").df())
    assert box_rules.box_pages(spark, str(tmp_path)).count() == 8
