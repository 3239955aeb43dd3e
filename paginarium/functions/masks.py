"""Masks and formatted print of form fields as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paginarium.functions.forms import STYLES

#: What a placeholder of ``printx`` takes from the source; it skips what doesn't fit.
TAKES = {"X": "A-Za-z0-9", "A": "A-Za-z", "9": "0-9"}
#: What a placeholder of a keystroke mask accepts.
ACCEPTS = {"9": "[0-9]", "A": "[A-Za-z]", "O": "[A-Za-z0-9]", "X": "(?s)."}


def mask_parts(mask: str) -> list[tuple[str, str, str]]:
    """(kind, what, case) of each directive: a literal, a placeholder or the rest of the source."""
    parts, case, at = [], "", 0
    while at < len(mask):
        c = mask[at]
        at += 1
        if c == "\\":
            if at < len(mask):
                parts.append(("literal", mask[at], case))
                at += 1
        elif c in "<>=":
            case = {"<": "lower", ">": "upper", "=": ""}[c]
        elif c in "?*" or c in TAKES:
            parts.append(("take", c, case))
        else:
            parts.append(("literal", c, case))
    return parts


def printx(mask: str, source: Column) -> Column:
    """A text through a mask: ``9 A X ?`` take a digit, a letter, either, anything; ``*`` the rest;
    ``\\`` makes the next sign a literal; ``< > =`` turn to lower, upper, unchanged case."""
    out, rest = [], source
    fold = {"": lambda c: c, "lower": lambda c: F.translate(c, *_cases()), "upper": lambda c: F.translate(c, *_cases()[::-1])}
    for kind, what, case in mask_parts(mask):
        if kind == "literal":
            out.append(F.lit(what))
        elif what == "*":
            out.append(fold[case](rest))
            rest = F.lit("")
        elif what == "?":
            out.append(fold[case](F.substring(rest, 1, 1)))
            rest = F.regexp_replace(rest, r"(?s)^.", "")
        else:
            taken = TAKES[what]
            out.append((fold[case] if what != "9" else fold[""])(F.regexp_extract(rest, f"^[^{taken}]*([{taken}])", 1)))
            rest = F.regexp_replace(rest, f"^[^{taken}]*[{taken}]?", "")
    return F.concat(*out) if out else F.lit("")


def _cases() -> tuple[str, str]:
    lower = "".join(map(chr, range(ord("a"), ord("z") + 1)))
    return lower.upper(), lower


def mask_satisfied(change: Column, mask: str) -> Column:
    """Whether a typed character fits one sign of a mask; other signs stand for themselves."""
    return change.rlike(f"^{ACCEPTS[mask]}$") if mask in ACCEPTS else change == mask


def split_fields(names: Column) -> Column:
    """The names of a comma-separated list without the spaces around them; no empty last name."""
    parts = F.split(names, ",", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "^ +| +$", ""))


SPEC = re.compile(r"%(?:,([0-3]))?([+\- #0]*)([0-9]*)(?:\.([0-9]+))?([dfsxXo])|%%")


def printf(pattern: str, *values: Column) -> Column:
    """``%d %f %s %x %X %o`` with flags, width and precision; ``%,n`` before them sets one of the four
    number styles. More directives than values, or a sign that is none, are an error."""
    out, at, used = [], 0, 0
    for m in SPEC.finditer(pattern):
        out.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m.group() == "%%":
            out.append(F.lit("%"))
            continue
        style, flags, width, digits, kind = m.groups()
        if used == len(values):
            raise ValueError("more directives than values")
        value, used = values[used], used + 1
        if kind == "s":
            text = value.cast("string")
            text = F.substring(text, 1, int(digits)) if digits else text
        elif kind == "f":
            places = int(digits or 6)
            group, point = STYLES[int(style)] if style else ("", ".")
            text = F.format_number(F.abs(value.cast("double")), places)
            text = F.replace(F.replace(F.replace(text, F.lit(","), F.lit("\u0001")), F.lit("."), F.lit(point)), F.lit("\u0001"), F.lit(group))
            text = F.concat(_sign(value < 0, flags), text)
        elif kind == "d":
            whole = value.cast("int")
            text = F.abs(whole.cast("long")).cast("string")
            text = F.lpad(text, int(digits), "0") if digits else text
            text = F.concat(_sign(whole < 0, flags), text)
        else:
            bits = value.cast("int").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
            text = F.lower(F.hex(bits)) if kind == "x" else F.hex(bits) if kind == "X" else F.conv(bits.cast("string"), 10, 8)
        if width:
            blank = F.greatest(F.lit(int(width)) - F.length(text), F.lit(0))
            if "-" in flags:
                text = F.concat(text, F.repeat(F.lit(" "), blank))
            elif "0" in flags and kind != "s":
                head = F.regexp_extract(text, r"^([+\- ]?)", 1)
                text = F.concat(head, F.repeat(F.lit("0"), blank), F.regexp_replace(text, r"^[+\- ]", ""))
            else:
                text = F.concat(F.repeat(F.lit(" "), blank), text)
        out.append(text)
    if "%" in SPEC.sub("", pattern):
        raise ValueError("unknown directive")
    return F.concat(*out, F.lit(pattern[at:]))


def _sign(below: Column, flags: str) -> Column:
    return F.when(below, "-").otherwise("+" if "+" in flags else " " if " " in flags else "")
