"""Boxes, matrices and colours as Column expressions over structs.

A box has x0, y0, x1, y1; a matrix a, b, c, d, e, f maps (x, y) to
(a x + c y + e, b x + d y + f).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX, MATRIX = ("x0", "y0", "x1", "y1"), ("a", "b", "c", "d", "e", "f")


def number_at(values: Column, index: int) -> Column:
    """The number at an index from 0, or 0 where there is none."""
    return F.coalesce(F.get(values, F.lit(index)).cast("double"), F.lit(0.0))


def struct_of(names: tuple[str, ...], values) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(names, values)])


def as_box(values: Column) -> Column:
    """Four numbers as a box; any other count gives the empty one."""
    return struct_of(BOX, [F.when(F.size(values) == 4, number_at(values, k)).otherwise(0.0) for k in range(4)])


def as_matrix(values: Column) -> Column:
    """Six numbers as a matrix; any other count gives the identity."""
    return struct_of(MATRIX, [F.when(F.size(values) == 6, number_at(values, k)).otherwise(1.0 if k in (0, 3) else 0.0) for k in range(6)])


def normalised(box: Column) -> Column:
    return struct_of(BOX, [F.least(box["x0"], box["x1"]), F.least(box["y0"], box["y1"]), F.greatest(box["x0"], box["x1"]), F.greatest(box["y0"], box["y1"])])


def union(p: Column, q: Column) -> Column:
    return struct_of(BOX, [F.least(p["x0"], q["x0"]), F.least(p["y0"], q["y0"]), F.greatest(p["x1"], q["x1"]), F.greatest(p["y1"], q["y1"])])


def union_of(box: Column) -> Column:
    """The aggregate: one box around those of a group."""
    return struct_of(BOX, [F.min(box["x0"]), F.min(box["y0"]), F.max(box["x1"]), F.max(box["y1"])])


def apply(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return matrix["a"] * x + matrix["c"] * y + matrix["e"], matrix["b"] * x + matrix["d"] * y + matrix["f"]


def transformed(matrix: Column, box: Column) -> Column:
    """The box around a box's four mapped corners."""
    xs, ys = zip(*[apply(matrix, box[x], box[y]) for y in ("y0", "y1") for x in ("x0", "x1")])
    return struct_of(BOX, [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)])


def angle(matrix: Column) -> Column:
    """A matrix's turn from 0 up to a full circle."""
    turn = F.atan2(matrix["c"], matrix["a"])
    return F.when(turn < 0, turn + 6.283185307179586).otherwise(turn)


def inverse_or_zero(matrix: Column) -> Column:
    a, b, c, d, e, f = (matrix[k] for k in MATRIX)
    det = a * d - b * c
    whole = F.when(det != 0, det)
    cells = [d / whole, -b / whole, -c / whole, a / whole, (c * f - d * e) / whole, (b * e - a * f) / whole]
    return struct_of(MATRIX, [F.coalesce(x, F.lit(0.0)) for x in cells])


def display_matrix(quarters: Column, box: Column) -> Column:
    """What maps a page's box, turned by quarters of a circle, onto a device box at the origin."""
    zero, one = F.lit(0.0), F.lit(1.0)
    turns = (
        (one, zero, zero, one, -box["x0"], -box["y0"]), (zero, -one, one, zero, -box["y0"], box["x1"]),
        (-one, zero, zero, -one, box["x1"], box["y1"]), (zero, one, -one, zero, box["y1"], -box["x0"]),
    )
    turn = F.pmod(quarters, F.lit(4))
    return struct_of(MATRIX, [F.when(turn == 0, turns[0][k]).when(turn == 1, turns[1][k]).when(turn == 2, turns[2][k]).otherwise(turns[3][k]) for k in range(6)])


def quad_box(quads: Column, index: int) -> Column:
    """The box of the quad at an index, by its third and second corners; empty where there are fewer quads."""
    at = [number_at(quads, index * 8 + k) for k in (4, 5, 2, 3)]
    return struct_of(BOX, [F.when(F.size(quads) >= (index + 1) * 8, v).otherwise(0.0) for v in at])


# --- colours ---------------------------------------------------------------------------

COLOUR = ("r", "g", "b")
# Chromaticities of the sRGB primaries, and the white of Lab colours.
PRIMARIES = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06))
WHITE = (0.9505, 1.0, 1.089)


def gray_to_rgb(gray: Column) -> Column:
    return struct_of(COLOUR, [F.greatest(F.least(gray, F.lit(1.0)), F.lit(0.0))] * 3)


def to_srgb(linear: Column) -> Column:
    """A linear part of light as an sRGB component, kept inside 0 to 1."""
    x = F.greatest(F.least(linear, F.lit(1.0)), F.lit(0.0))
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)


def _rows(m: list[list[float]]) -> list[list[float]]:
    """The inverse of a 3 by 3 matrix, by cofactors."""
    cell = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * cell(0, j) for j in range(3))
    return [[cell(j, i) / det for j in range(3)] for i in range(3)]


def from_xyz(white: tuple[float, float, float] = WHITE) -> list[list[float]]:
    """The matrix from XYZ to linear sRGB for a white point."""
    columns = [[x, y, 1 - x - y] for x, y in PRIMARIES]
    primaries = [[columns[j][i] for j in range(3)] for i in range(3)]
    scale = [sum(row[k] * white[k] for k in range(3)) for row in _rows(primaries)]
    return _rows([[primaries[i][j] * scale[j] for j in range(3)] for i in range(3)])


def xyz_to_rgb(x: Column, y: Column, z: Column, white: tuple[float, float, float] = WHITE) -> Column:
    return struct_of(COLOUR, [to_srgb(row[0] * x + row[1] * y + row[2] * z) for row in from_xyz(white)])


def calibrated_rgb(a: Column, b: Column, c: Column, gamma: tuple[float, float, float], matrix: tuple[float, ...], white: tuple[float, float, float]) -> Column:
    """Gamma, then the matrix (by columns) to XYZ, then sRGB under the white point."""
    a, b, c = (F.pow(v, F.lit(g)) for v, g in zip((a, b, c), gamma))
    return xyz_to_rgb(*[matrix[k] * a + matrix[k + 3] * b + matrix[k + 6] * c for k in range(3)], white=white)


def lab_to_rgb(light: Column, a: Column, b: Column) -> Column:
    """CIE Lab (lightness 0 to 100) as sRGB."""
    m = (light + 16) / 116
    back = lambda v: F.when(v < 0.2069, (v - 0.1379) * 0.12842).otherwise(v * v * v)
    return xyz_to_rgb(back(m + a / 500) * 0.957, back(m), back(m - b / 200) * 1.0889)
