"""Lines from right to left never become rows of characters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from paginarium.operators import bidi


def test_characters_are_no_rows(spark):
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["אב 12 (ab)", "", None, "a\U0001f3a8א", "3/5."])], "d int, k int, t string")
    plan = bidi.segments(lines, ["d", "k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    plan = bidi.logical_order(lines, "d", "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower() and plan.count("Window ") <= 1


def test_the_table_of_kinds_is_the_rule(spark):
    table = bidi._unpacked(bidi.kind_table())
    points = [*range(0, 0x800, 7), 0x5D0, 0x661, 0x200F, 0xFEFF, 0xFF0D, 0x1F3A8, 0x10FFFF, 10, 0x20AC]
    told = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string").select("p", bidi.kind(F.col("c")).alias("k")).collect()
    assert {r["p"]: r["k"] for r in told} == {p: bidi.KINDS[table[p]] for p in points}
    assert table.dtype == np.uint8 and len(table) == 0x110000
