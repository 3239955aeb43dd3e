"""What a row needs is worked out once: plans of queries that were slow on large texts."""

from __future__ import annotations

import pytest

from paginarium.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_the_words_of_a_name_tree_are_read_once(spark):
    assert "regexp_extract_all" not in plan(spark, "name_tree_lookup")


def test_the_words_around_a_range_are_split_once(spark):
    assert plan(spark, "selection_boxes").count("split(text") == 1


@pytest.mark.parametrize("name, slow", [("joined_lines", "aggregate("), ("markdown_documents", "aggregate("), ("name_spellings", "regexp_extract_all")])
def test_texts_are_walked_by_batch_functions(spark, name, slow):
    found = plan(spark, name)
    assert slow not in found and "ArrowEvalPython" in found


def test_a_date_is_scanned_once(spark):
    """What scans dates stands below the join with the orders, above what makes the dates distinct."""
    found = plan(spark, "scanned_dates")
    assert found.index("Join") < found.index("make_date") < found.index("Aggregate")
