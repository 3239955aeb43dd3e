"""Form-field calculation, formatting and validation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paginarium.functions.numbers import js_number

#: Number styles: grouping mark and decimal mark.
STYLES = ((",", "."), ("", "."), (".", ","), ("", ","))


def six_places(x: Column) -> Column:
    scaled = x * 1e6 + 0.49
    # beyond 2**53 a double has no fraction left to cut
    return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled) / 1e6


def simple_calculate(op: str, value: Column) -> Column:
    """An aggregate over field values; without fields 0, or 1 for a product.

    A field without a value counts as zero, so it divides an average and ends a product.
    """
    kinds = {"SUM": F.sum, "AVG": F.avg, "PRD": F.product, "MIN": F.min, "MAX": F.max}
    if op.upper() not in kinds:
        raise ValueError(f"unknown operation {op!r}")
    each = F.coalesce(value.cast("double"), F.lit(0.0))
    return six_places(F.coalesce(kinds[op.upper()](each), F.lit(1.0 if op.upper() == "PRD" else 0.0)))


def simple(op: str, a: Column, b: Column) -> Column:
    """The same operations on two values."""
    kinds = {"SUM": a + b, "AVG": (a + b) / 2, "PRD": a * b, "MIN": F.least(a, b), "MAX": F.greatest(a, b)}
    if op.upper() not in kinds:
        raise ValueError(f"unknown operation {op!r}")
    return kinds[op.upper()]


def merge_change(value: Column, change: str, start: int, end: int) -> Column:
    """A value with the characters from ``start`` up to ``end`` (from 0) replaced; a negative start keeps all before."""
    size = F.length(value)
    head = F.substring(value, 1, start) if start >= 0 else value
    return F.concat(head, F.lit(change), F.substring(value, F.lit(max(end, 0) + 1), size))


def is_number(text: Column) -> Column:
    """Digits, one decimal mark of either kind anywhere, a sign only first, an exponent only with its own sign.

    Spaces around it don't count; what is empty then is none, and each part may lack its digits.
    """
    bare = F.trim(text)
    return (bare != "") & bare.rlike(r"^[+-]?[0-9]*(?:[.,][0-9]*(?:[eE][+-][0-9]*)?|[eE][+-][0-9]*(?:[.,][0-9]*)?)?\z")


def with_marks(text: Column, style: int) -> Column:
    """``1,234.56`` in another number style."""
    group, point = STYLES[style]
    held = F.replace(F.replace(text, F.lit(","), F.lit("\u0001")), F.lit("."), F.lit(point))
    return F.replace(held, F.lit("\u0001"), F.lit(group))


def number_format(value: Column, decimals: int, style: int = 0, negative: int = 0, currency: str = "", prepend: bool = True) -> Column:
    """A number as form text; ``negative``: 0 and 1 give ``-`` and nothing, 2 and 3 parentheses."""
    style, negative = (s if 0 <= s <= 3 else 0 for s in (style, negative))
    body = with_marks(F.format_number(F.abs(value), decimals), style)
    body = F.concat(F.lit(currency), body) if prepend else F.concat(body, F.lit(currency))
    below = {0: F.concat(F.lit("-"), body), 1: body}.get(negative, F.concat(F.lit("("), body, F.lit(")")))
    return F.when(value < 0, below).otherwise(body)


def percent_format(value: Column, decimals: int, style: int = 0, prepend: bool = False) -> Column:
    if decimals < 0 or not 0 <= style <= 49:
        raise ValueError("no such percent format")
    body = F.format_number(F.abs(value * 100), decimals)
    body = with_marks(body, style) if style <= 3 else F.replace(body, F.lit(","), F.lit("'"))
    body = F.when(value < 0, F.concat(F.lit("-"), body)).otherwise(body)
    return F.concat(F.lit("%"), body) if prepend else F.concat(body, F.lit("%"))


def range_validate(value: Column, low: float | None, high: float | None) -> Column:
    """Null where the value is allowed, else what is wrong with it."""
    if low is not None and high is not None:
        return F.when((value < low) | (value > high), F.lit(f"must be between {low:g} and {high:g}"))
    if low is not None:
        return F.when(value < low, F.lit(f"must be at least {low:g}"))
    if high is not None:
        return F.when(value > high, F.lit(f"must be at most {high:g}"))
    return F.lit(None).cast("string")


def extract_numbers(text: Column) -> Column:
    """The digit runs of a text, with "0" first where it starts with a decimal mark; null without digits."""
    runs = F.regexp_extract_all(text, F.lit("([0-9]+)"))
    runs = F.when(text.rlike("^[.,]"), F.concat(F.array(F.lit("0")), runs)).otherwise(runs)
    return F.when(F.size(runs) > 0, runs)


def make_number(text: Column) -> Column:
    """A text as a script reads a number, with either decimal mark (hexadecimal too); what isn't a number counts 0."""
    return F.coalesce(js_number(F.replace(text, F.lit(","), F.lit("."))), F.lit(0.0))


def masked(text: Column, mask: str) -> Column:
    """Digits of a text put into the 9s of a mask; literals always print, missing digits don't."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    parts, at = [], 1
    for c in mask:
        if c == "9":
            parts.append(F.substring(digits, at, 1))
            at += 1
        else:
            parts.append(F.lit(c))
    return F.concat(*parts)


def special_format(text: Column, kind: int) -> Column:
    """0: zip, 1: zip+4, 2: phone (short or long), 3: social security number."""
    if kind == 2:
        many = F.length(F.regexp_replace(text, "[^0-9]", "")) >= 10
        return F.when(many, masked(text, "(999) 999-9999")).otherwise(masked(text, "999-9999"))
    mask = {0: "99999", 1: "99999-9999", 3: "999-99-9999"}.get(kind)
    return masked(text, mask) if mask else F.lit("")


def flag(bits: Column, position: int) -> Column:
    """Whether the bit at a position counted from 1 is set."""
    return F.getbit(bits.cast("long"), F.lit(position - 1)) == 1
