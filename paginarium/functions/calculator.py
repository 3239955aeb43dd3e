"""Functions over rows: tables of samples, and calculator programs (numbers, operators and procedures in braces over a stack).

A program is worked out in single precision on a stack of columns, so a row never meets an interpreter. Where a
condition or a count depends on the row, the stack parts into cases of different depth, each
with the rows it holds for; cases of one depth are joined again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paginarium.functions import numbers

#: Fixed values of the format: slots of the stack, procedures within one another below the outermost.
SLOTS = 100
NESTED = 128

WORD = re.compile(r"%[^\r\n]*|([{}\[\]()<>/]|[^\x00\t\n\f\r {}\[\]()<>/%]+)")
NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
LARGEST = float(np.finfo(np.float32).max)


def parsed(program: str) -> list:
    """The outermost procedure: numbers, names and lists (procedures within). A word that is neither number nor operator is 0."""
    words = [w.group(1) for w in WORD.finditer(program) if w.group(1)]
    if not words or words[0] != "{":
        raise ValueError("a program begins with a brace")
    open_lists: list[list] = []
    for word in words:
        if word == "{":
            if len(open_lists) > NESTED:
                raise ValueError(f"procedures more than {NESTED} deep")
            open_lists.append([])
        elif word == "}":
            done = open_lists.pop()
            if not open_lists:
                return done
            open_lists[-1].append(done)
        else:
            open_lists[-1].append(word if word in OPERATORS or word in STACK or word in ("if", "ifelse", "true", "false") else number(word))
    raise ValueError("a procedure has no end")


def number(word: str) -> float:
    value = float(word) if NUMBER.fullmatch(word) else 0.0
    value = float(np.float32(value)) if abs(value) <= LARGEST else math.inf
    return value if math.isfinite(value) else 0.0


def single(c: Column) -> Column:
    return c.cast("float")


def whole(c: Column) -> Column:
    """Towards zero, within 32 bits; 0 for what is no number."""
    wide = c.cast("double")
    return F.when(F.isnan(wide), F.lit(0)).otherwise(F.greatest(F.least(wide, F.lit(2.0**31 - 1)), F.lit(-(2.0**31))).cast("int"))


def within(c: Column, low: float, high: float) -> Column:
    """Held between two bounds; what is no number stays so."""
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.least(c, single(F.lit(float(high)))), single(F.lit(float(low)))))


def floor(c: Column) -> Column:
    # From 2**24 on every single-precision number is whole.
    return F.when(F.abs(c) < 2.0**24, single(F.floor(c))).otherwise(c)


def truth(c: Column) -> Column:
    return single(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))


def compared(how) -> object:
    return lambda a, b: truth(~F.isnan(a) & ~F.isnan(b) & how(a, b))


def divided(a: Column, b: Column) -> Column:
    return F.when(b == 0, single(F.lit(0.0))).otherwise(single(a.cast("double") / b.cast("double")))


def whole_division(a: Column, b: Column) -> Column:
    out = F.when(whole(b) == 0, F.lit(0.0)).otherwise(whole(a).cast("double") / whole(b).cast("double"))
    return single(F.when(out >= 2.0**31, F.lit(0)).otherwise(out.cast("int")))


def shifted(a: Column, b: Column) -> Column:
    by = whole(b).cast("long")
    left, right = F.call_function("shiftleft", whole(a), by.cast("int")), F.call_function("shiftright", whole(a), (-by).cast("int"))
    return single(F.when((by > 0) & (by < 32), left).when((by <= 0) & (by > -32), right).otherwise(F.lit(0)))


def arc(a: Column, b: Column) -> Column:
    degrees = single(single(single(F.atan2(a, b)) * single(F.lit(180.0))) / single(F.lit(float(np.float32(math.pi)))))
    return F.when(degrees < 0, single(degrees + single(F.lit(360.0)))).otherwise(degrees)


def radians(c: Column) -> Column:
    return single(single(c * single(F.lit(math.pi))) / F.lit(180.0))


def logarithm(f) -> object:
    return lambda a: single(F.when(a == 0, F.lit(float("-inf"))).when(a < 0, F.lit(float("nan"))).otherwise(f(a.cast("double"))))


#: Operators that take values and leave one: how many they take, and how they read them from below upwards.
OPERATORS = {
    "abs": (1, F.abs),
    "add": (2, lambda a, b: a + b),
    "and": (2, lambda a, b: single(whole(a).bitwiseAND(whole(b)))),
    "atan": (2, arc),
    "bitshift": (2, shifted),
    "ceiling": (1, lambda a: -floor(-a)),
    "cos": (1, lambda a: single(F.cos(radians(a)))),
    "cvi": (1, lambda a: single(whole(a))),
    "cvr": (1, lambda a: a),
    "div": (2, divided),
    "eq": (2, compared(lambda a, b: a == b)),
    "exp": (2, lambda a, b: single(F.pow(a, b))),
    "floor": (1, floor),
    "ge": (2, compared(lambda a, b: a >= b)),
    "gt": (2, compared(lambda a, b: a > b)),
    "idiv": (2, whole_division),
    "le": (2, compared(lambda a, b: a <= b)),
    "ln": (1, logarithm(F.ln)),
    "log": (1, logarithm(F.log10)),
    "lt": (2, compared(lambda a, b: a < b)),
    "mod": (2, lambda a, b: single(F.when(whole(b) == 0, F.lit(0)).otherwise(whole(a) % whole(b)))),
    "mul": (2, lambda a, b: a * b),
    "ne": (2, lambda a, b: truth(F.isnan(a) | F.isnan(b) | (a != b))),
    "neg": (1, lambda a: -a),
    "not": (1, lambda a: truth(whole(a) == 0)),
    "or": (2, lambda a, b: single(whole(a).bitwiseOR(whole(b)))),
    "round": (1, lambda a: F.when(F.isnan(a), single(F.lit(0.0))).when(a > LARGEST - 0.5, single(F.lit(LARGEST))).otherwise(floor(single(a + single(F.lit(0.5)))))),
    "sin": (1, lambda a: single(F.sin(radians(a)))),
    "sqrt": (1, lambda a: single(F.sqrt(a))),
    "sub": (2, lambda a, b: a - b),
    "truncate": (1, lambda a: single(whole(a))),
    "xor": (2, lambda a, b: single(whole(a).bitwiseXOR(whole(b)))),
}
#: Operators that rearrange the stack.
STACK = ("copy", "dup", "exch", "index", "pop", "roll")
#: These read each value once; what others read is worked out beforehand.
ONCE = {"add", "sub", "mul", "neg", "abs", "sqrt", "cvr"}

Value = float | str | Column


@dataclass(frozen=True)
class Case:
    """A stack and the rows it holds for (None: all)."""

    rows: Column | None
    stack: tuple[Value, ...]


def column(value: Value) -> Column:
    if isinstance(value, float):
        return single(F.lit(value))
    return F.col(value) if isinstance(value, str) else value


class Sheet:
    """The rows with what has been worked out so far; values read twice become columns of their own."""

    def __init__(self, rows: DataFrame):
        self.rows, self.taken = rows, {c.lower() for c in rows.columns}
        self.own: list[str] = []

    def kept(self, value: Value) -> float | str:
        if isinstance(value, (float, str)):
            return value
        k = len(self.own)
        while f"_c{k}" in self.taken:
            k += 1
        self.own.append(f"_c{k}")
        self.taken.add(f"_c{k}")
        self.rows = self.rows.withColumn(f"_c{k}", value)
        return f"_c{k}"


def popped(case: Case, n: int) -> tuple[list[Value], Case]:
    """The n topmost values from below upwards; 0 for those that an empty stack lacks."""
    got = list(case.stack[max(0, len(case.stack) - n):])
    return [0.0] * (n - len(got)) + got, replace(case, stack=case.stack[: max(0, len(case.stack) - n)])


def pushed(case: Case, *values: Value) -> Case:
    """With the values on top; those beyond the last slot are lost."""
    return replace(case, stack=(case.stack + values)[:SLOTS])


def both(a: Column | None, b: Column) -> Column:
    return b if a is None else a & b


def joined(sheet: Sheet, cases: list[Case], before: list[Case]) -> list[Case]:
    """One case for each depth; ``before`` are the cases that these came from, which hold for the same rows."""
    by_depth: dict[int, list[Case]] = {}
    for case in cases:
        by_depth.setdefault(len(case.stack), []).append(case)
    out = []
    for same in by_depth.values():
        if len(same) == 1:
            out.append(same[0])
            continue
        holds = [F.col(sheet.kept(c.rows)) for c in same]
        stack = []
        for values in zip(*(c.stack for c in same)):
            if all(isinstance(v, (float, str)) and v == values[0] and type(v) is type(values[0]) for v in values):
                stack.append(values[0])
                continue
            value = F.when(holds[0], column(values[0]))
            for hold, v in zip(holds[1:], values[1:]):
                value = value.when(hold, column(v))
            stack.append(value)
        any_of = holds[0]
        for hold in holds[1:]:
            any_of = any_of | hold
        out.append(Case(before[0].rows if len(before) == len(by_depth) == 1 else any_of, tuple(stack)))
    return out


def counted(sheet: Sheet, case: Case, value: Value, counts: range, then) -> list[Case]:
    """``then(case, count)`` for a count that the program states or a row holds; (case, None) where it is outside ``counts``."""
    if isinstance(value, float):
        n = int(max(min(value, 2.0**31 - 1), -(2.0**31)))
        return [then(case, n if n in counts else None)]
    n = F.col(sheet.kept(whole(column(value))))
    out = [then(replace(case, rows=both(case.rows, n == k)), k) for k in counts]
    return [*out, then(replace(case, rows=both(case.rows, ~n.isin(*counts) if len(counts) else F.lit(True))), None)]


def rearranged(sheet: Sheet, case: Case, name: str) -> list[Case]:
    if name == "pop":
        return [popped(case, 1)[1]]
    if name == "exch":
        (a, b), rest = popped(case, 2)
        return [pushed(rest, b, a)]
    if name == "dup":
        (a,), rest = popped(case, 1)
        a = sheet.kept(a)
        return [pushed(rest, a, a)]
    if name in ("copy", "index"):
        (n,), rest = popped(case, 1)
        rest = replace(rest, stack=tuple(sheet.kept(v) for v in rest.stack))
        depth = len(rest.stack)
        if name == "index":
            return counted(sheet, rest, n, range(depth), lambda c, k: c if k is None else pushed(c, c.stack[-1 - k]))
        return counted(sheet, rest, n, range(min(depth, SLOTS - depth) + 1), lambda c, k: pushed(c, *c.stack[depth - k:]) if k else c)
    (n, by), rest = popped(case, 2)
    rest = replace(rest, stack=tuple(sheet.kept(v) for v in rest.stack))

    def turned(c: Case, width: int | None) -> list[Case]:
        if not width:
            return [c]
        low, top = c.stack[: len(c.stack) - width], c.stack[len(c.stack) - width:]
        if isinstance(by, float):
            k = int(max(min(by, 2.0**31 - 1), -(2.0**31))) % width
            return [replace(c, stack=low + top[width - k:] + top[: width - k])]
        step = F.pmod(whole(column(by)), F.lit(width))
        return [replace(c, rows=both(c.rows, step == k), stack=low + top[width - k:] + top[: width - k]) for k in range(width)]

    by = sheet.kept(by)
    return [each for some in counted(sheet, rest, n, range(1, len(rest.stack) + 1), turned) for each in some]


def worked(sheet: Sheet, procedure: list, cases: list[Case]) -> list[Case]:
    """The cases after a procedure. A choice without its procedures right before it ends the procedure it stands in, and no other."""
    for k, item in enumerate(procedure):
        if isinstance(item, list):
            continue
        if item in ("if", "ifelse"):
            bodies = procedure[max(0, k - (1 if item == "if" else 2)): k]
            if len(bodies) < (1 if item == "if" else 2) or not all(isinstance(b, list) for b in bodies):
                return cases
            after = []
            for case in cases:
                case = case if case.rows is None else replace(case, rows=F.col(sheet.kept(case.rows)))
                (condition,), rest = popped(case, 1)
                if isinstance(condition, float):
                    ways = [(rest, abs(condition) >= 1)]
                else:
                    rest = replace(rest, stack=tuple(sheet.kept(v) for v in rest.stack))
                    holds = F.col(sheet.kept(whole(column(condition)) != 0))
                    ways = [(replace(rest, rows=both(case.rows, holds)), True), (replace(rest, rows=both(case.rows, ~holds)), False)]
                for way, yes in ways:
                    body = bodies[0] if yes else bodies[1] if item == "ifelse" else []
                    after += worked(sheet, body, [way])
            cases = joined(sheet, after, cases)
        elif item in STACK:
            cases = joined(sheet, [each for case in cases for each in rearranged(sheet, case, item)], cases)
        elif item in OPERATORS:
            takes, f = OPERATORS[item]
            after = []
            for case in cases:
                values, rest = popped(case, takes)
                after.append(pushed(rest, f(*(column(v if item in ONCE else sheet.kept(v)) for v in values))))
            cases = after
        else:
            cases = [pushed(case, {"true": 1.0, "false": 0.0}.get(item, item)) for case in cases]
    return cases


def calculated(rows: DataFrame, program: str, inputs: list[tuple[str, float, float]], outputs: list[tuple[str, float, float]]) -> DataFrame:
    """The rows with a program's outputs as float columns.

    ``inputs`` are (column, least, most), ``outputs`` (name, least, most): values are held
    within both. The topmost value is the last output. Outputs are null where an input is null
    and where the stack has fewer values than there are outputs. Division by zero gives 0, so
    does the top of an empty stack. A program that cannot be read raises ValueError. An output takes the place of a column of its name.
    """
    procedure, sheet = parsed(program), Sheet(rows)
    held = []
    given = F.lit(True)
    for name, low, high in inputs:
        given = given & F.col(name).isNotNull()
        held.append(sheet.kept(within(single(F.col(name)), low, high)))
    given = F.col(sheet.kept(given))
    found: list[Column] = [F.lit(None).cast("float")] * len(outputs)
    for case in worked(sheet, procedure, [Case(None, tuple(held)[:SLOTS])]):
        if len(case.stack) < len(outputs):
            continue
        holds = both(case.rows, given)
        for k, value in enumerate(case.stack[len(case.stack) - len(outputs):]):
            found[k] = F.when(holds, within(column(sheet.kept(value)), *outputs[k][1:])).otherwise(found[k])
    names = [name for name, _, _ in outputs]
    values = {name: f for name, f in zip(names, found)}
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in values]
    return sheet.rows.select(*kept, *(values[n].alias(n) for n in names))


#: Widths in bits that samples may have, and the most inputs of a sampled function here: it reads 2**inputs samples a row.
SAMPLE_BITS = (1, 2, 4, 8, 12, 16, 24, 32)
MOST_INPUTS = 8


def packed_samples(data: bytes, bits: int, count: int) -> list[int]:
    """Samples packed without gaps, highest bit first; 0 beyond the end of the data."""
    if bits not in SAMPLE_BITS:
        raise ValueError(f"samples of {bits} bits")
    total = -(-count * bits // 8)
    word = int.from_bytes(data[:total].ljust(total, b"\0"), "big")
    return [(word >> (total * 8 - (k + 1) * bits)) & ((1 << bits) - 1) for k in range(count)]


def sampled(rows: DataFrame, inputs: Sequence[tuple[str, float, float]], sizes: Sequence[int], samples: Sequence[int], bits: int, outputs: Sequence[tuple[str, float, float]], encode: Sequence[tuple[float, float]] | None = None, decode: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """The rows with values of a table of samples on a grid, read between its points by the 2**inputs samples around, in double precision.

    ``inputs`` and ``outputs`` are (column, least, most). The first axis runs fastest, and a
    point's outputs stand together. Inputs are held within their bounds, mapped by ``encode`` to
    places on the axis (its whole length if not given) and held on the grid; samples are mapped by ``decode`` (the outputs' bounds if
    not given). An axis of one point has no say, and what is no number stands at the axis'
    beginning. A null input gives null outputs. An output takes the place of a column of its name.
    """
    axes, width = len(inputs), len(outputs)
    encode, decode = encode or [(0.0, n - 1.0) for n in sizes], decode or [bounds for _, *bounds in outputs]
    if not 0 < axes <= MOST_INPUTS or len(sizes) != axes or min(sizes) < 1:
        raise ValueError(f"1 to {MOST_INPUTS} inputs, a size of at least 1 for each")
    if bits not in SAMPLE_BITS or len(samples) != width * math.prod(sizes):
        raise ValueError(f"{width * math.prod(sizes)} samples of a width of {SAMPLE_BITS}")
    sheet, table = Sheet(rows), F.array(*(F.lit(float(s)) for s in samples))
    # Each axis: (weight, place in the table) below and above; one of them where the axis has one point.
    sides, step, given = [], 1, F.lit(True)
    for (name, d0, d1), n, (e0, e1) in zip(inputs, sizes, encode):
        x = F.col(sheet.kept(F.col(name).cast("double")))
        given = given & x.isNotNull()
        place = numbers.clamped(numbers.interpolate(numbers.clamped(x, d0, d1), d0, d1, e0, e1), 0, n - 1)
        place = F.col(sheet.kept(F.when(F.isnan(x), F.lit(0.0)).otherwise(place)))
        low = F.col(sheet.kept(F.floor(place).cast("int")))
        part = F.col(sheet.kept(place - low))
        sides.append([(1 - part, low * step * width), (part, F.least(low + 1, F.lit(n - 1)) * step * width)] if n > 1 else [(F.lit(1.0), F.lit(0))])
        step *= n
    corners = []
    for corner in product(*sides):
        weight, at = corner[0]
        for w, place in corner[1:]:
            weight, at = weight * w, at + place
        corners.append((F.col(sheet.kept(weight)), F.col(sheet.kept(at))))
    given, found = F.col(sheet.kept(given)), {}
    for k, ((name, r0, r1), (d0, d1)) in enumerate(zip(outputs, decode)):
        blend = F.lit(0.0)
        for weight, at in corners:
            blend = blend + weight * F.get(table, at + k)
        found[name] = F.when(given, numbers.clamped(numbers.interpolate(blend, 0, 2**bits - 1, d0, d1), r0, r1))
    return sheet.rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in found), *(c.alias(n) for n, c in found.items()))
