"""Reading and narrowing of numbers, and the functions of one input, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = r"^[ \t\n\x0B\f\r]*([+\-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+\-]?[0-9]+)?)"
DECIMAL = r"^[+\-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+\-]?[0-9]+)?$"


def c_atof(text: Column) -> Column:
    """The longest numeric beginning of a text, else 0."""
    return F.coalesce(F.regexp_extract(text, PREFIX, 1).try_cast("double"), F.lit(0.0))


def js_number(text: Column) -> Column:
    """A whole text as a number: decimal, ``0x`` hexadecimal of 32 bits, Infinity, NaN; null for others and for none."""
    trimmed = F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    digits = F.regexp_extract(trimmed, "^0[xX]([0-9A-Fa-f]{1,8})$", 1)
    hexadecimal = F.conv(digits, 16, 10).try_cast("long")
    return (
        F.when(trimmed == "NaN", F.lit(float("nan"))).when(trimmed.isin("Infinity", "+Infinity"), F.lit(float("inf"))).when(trimmed == "-Infinity", F.lit(float("-inf")))
        .when(digits != "", F.when(hexadecimal < 2**31, hexadecimal.cast("double"))).when(trimmed.rlike(DECIMAL), trimmed.try_cast("double"))
    )


def narrow_to_signed32(value: Column) -> Column:
    """The low 32 bits as a signed number."""
    return F.pmod(value + 2**31, F.lit(2**32)) - 2**31


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """On the line through two points; the first point's height where they stand above each other."""
    return F.lit(float(y0)) if x1 == x0 else y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def exponential(x: Column, c0: float, c1: float, exponent: float, domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """c0 + x**n (c1 - c0) with x inside its domain."""
    return c0 + F.pow(clamped(x, *domain), F.lit(float(exponent))) * (c1 - c0)


def stitching(x: Column, functions: Sequence, bounds: Sequence[float], encode: Sequence[tuple[float, float]], domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Each part of the domain has a function of its own; ``encode`` maps the part to that function's input."""
    if len(functions) != len(bounds) + 1 or len(encode) != len(functions):
        raise ValueError("one bound fewer than functions, and a pair for each")
    inside, edges = clamped(x, *domain), [domain[0], *bounds, domain[1]]
    each = [f(interpolate(inside, edges[k], edges[k + 1], *encode[k])) for k, f in enumerate(functions)]
    out = each[-1]
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(inside < bounds[k], each[k]).otherwise(out)
    return out
