"""Elements of pages that are one row each, against tables of elements; rounds of pointer doubling around a cycle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paginarium.operators import structure, trees
from paginarium.plans import registry, tree_rules

SF = "/root/testdata/sf0.001"


def html(r, n):
    return "".join(r.choice(["<p>", "</p>", "<ul class=a>", "<li>", "</li>", "<b>x", "<h1>", "<br>", "<script>'<p>'</script>", "<!-- <i> -->", "\n"]) for _ in range(n))


def by_tables(pages, literal, numbers):
    """What the tables of all elements give: (node, root, depth, below) as a sorted list."""
    met = trees.parents_by_depth(structure.elements(pages.where("page_id IS NOT NULL"), "page_id", "html"), "page_id", "n", "depth", tree_rules.DEEPEST)
    number = lambda n: F.col("page_id") * numbers + F.col(n)
    nodes = met.select(number("n").alias("node"), number("parent").alias("parent"))
    rows = trees.rooted(nodes.union(pages.sparkSession.createDataFrame(literal, "node long, parent long")), "node", "parent")
    return sorted((x.node, x.root or 0, *(-1 if v is None else v for v in (x.depth, x.below))) for x in rows.collect())


@pytest.mark.parametrize("batch, tags", [(10_000, 1_000_000), (3, 1_000_000), (10_000, 50)])
def test_elements_of_pages_in_a_row_equal_a_walk(spark, monkeypatch, batch, tags):
    monkeypatch.setattr(trees, "TAGS", tags)
    r = random.Random(7)
    texts = [html(r, r.choice([0, 1, 3, 40, 200])) for _ in range(40)] + [None, "", "<br></p>", "<div>" * 40 + "</div>" * 60 + "<i>" * 3]
    frame = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        met = frame.select("page_id", F.explode(trees.placed_elements(structure.tags("html"), structure.VOID, 16)).alias("e")).select("page_id", "e.*").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {(x.page_id, x.n): (x.parent, x.root, x.depth, x.below) for x in met}
    want = {}
    rows = structure.elements(frame, "page_id", "html").orderBy("page_id", "n").collect()
    for page in range(len(texts)):
        stack, above = [], {}
        for x in (x for x in rows if x.page_id == page):
            d = min(max(x.depth, 1), 16)
            while stack and stack[-1][1] >= d:
                stack.pop()
            above[x.n] = [n for n, _ in stack]
            stack.append((x.n, d))
        for n, path in above.items():
            want[page, n] = (path[-1] if path else None, path[0] if path else n, len(path), sum(n in p for p in above.values()))
    assert len(met) == len(found) and found == want and len(want) > 500


def test_the_elements_of_a_page_do_not_leave_their_row(spark):
    plan = registry.QUERIES["structure_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and not any(x in plan for x in ("Exchange", "Window", "Join"))


@pytest.mark.parametrize("kind", ["apart", "shared"])
def test_pages_that_share_numbers_go_together(spark, tmp_path, monkeypatch, kind):
    """A page of more tags than it has numbers, one over the literal nodes, one of two rows: as if all went through tables."""
    monkeypatch.setattr(tree_rules, "NODES", 1000)
    r = random.Random(9)
    pages = [(k, html(r, 30)) for k in (20, 21, 22)] + [(None, "<p>"), (30, None), (31, "")]
    if kind == "shared":
        long = "<ul>" + "<li><b>x</b></li>" * 700
        pages += [(1, long), (2, "<p><b>y</b></p>"), (3, "<i>" * 5), (4, "<i>" * 5), (-1, long[:3000]), (7, "<p><b>z"), (7, "<p><b>z")]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(tuple(x) for x in registry.QUERIES["structure_rows"](spark, str(tmp_path)).collect())
    assert found == by_tables(frame, tree_rules.LITERAL, 1000)
    if kind == "shared":
        assert len(found) > 1400


def test_a_cycle_adds_one_round(spark, monkeypatch):
    """The rounds follow the depth of the forest, not the number of its nodes."""
    star = spark.range(1, 3001).select("id", F.lit(0).cast("long").alias("up"))
    nodes = star.union(spark.createDataFrame([(0, None), (-1, -2), (-2, -3), (-3, -1), (-4, -1)], "id long, up long"))
    rounds, plain = [], type(nodes).checkpoint
    monkeypatch.setattr(type(nodes), "checkpoint", lambda frame, *a, **k: rounds.append(1) or plain(frame, *a, **k))
    found = trees.rooted(nodes, "id", "up")
    assert len(rounds) <= 3
    assert found.where("root IS NULL AND depth IS NULL AND below IS NULL").count() == 4
    assert found.where("node = 0").first().below == 3000
