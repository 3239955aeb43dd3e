"""Every document query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from paginarium.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(tuple, pdf[cols].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, db, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(registry.ORACLES[name]).df())


def test_line_diff_keeps_order(spark):
    from paginarium.operators.structure import longest_common

    assert longest_common(["a", "b", "c"], ["b", "d", "c"]) == (["a"], ["d"])
    assert longest_common(["x", "y"], ["y", "x"]) == (["x"], ["x"])
    assert longest_common([], ["a"]) == ([], ["a"])
    assert registry.QUERIES["line_diff"](spark, SF).count() > 0


def test_base64_is_encoded(spark):
    plan = registry.QUERIES["hex_and_base64"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "base64(" in plan.lower()
