"""Array expressions that stay within a row: bound names, running sums, runs of equal values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements summed by one inner loop of ``running_sums``.
STRIDE = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, levels: int = 2) -> Column:
    """For each element the sum of those before it.

    Sums of strides are added up first, by the same rule one level further down, then the elements
    within a stride: with two levels some n * STRIDE additions in one row up to a million
    elements, no shuffle and no sort.
    """
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    stride = lambda i: F.floor(i / STRIDE).cast("int")

    def of(v: Column) -> Column:
        strides = F.transform(F.sequence(F.lit(0), stride(F.size(v) - 1)), lambda c: total(F.slice(v, c * STRIDE + 1, F.lit(STRIDE))))
        before = running_sums(strides, levels - 1) if levels > 0 else let(strides, lambda s: F.transform(s, lambda x, c: total(F.slice(s, F.lit(1), c))))
        return let(before, lambda b: F.transform(v, lambda x, i: F.get(b, stride(i)) + total(F.slice(v, stride(i) * STRIDE + 1, i % STRIDE))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<bigint>")))


def runs(values: Column) -> Column:
    """(first, n, value) of each run of equal values."""

    def of(v: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | ~F.get(v, i).eqNullSafe(F.get(v, i - 1)))
        each = lambda h: F.transform(h, lambda i, k: F.struct(i.alias("first"), (F.coalesce(F.get(h, k + 1), F.size(v)) - i).alias("n"), F.get(v, i).alias("value")))
        return let(heads, each)

    return F.when(F.size(values) > 0, let(values, of))
