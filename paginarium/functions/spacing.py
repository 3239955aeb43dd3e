"""Where drawn characters leave a space, and where drawn boxes end a line, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width classes of a glyph, in thousandths of the font size, and what each class is divided by.
CLASSES, DIVISORS = (300.0, 500.0, 700.0), (2.0, 4.0, 5.0, 6.0)
# The height up to which a box ends no line, and the part of the font size for widths.
LOW, NARROW = 4.5, 0.1


def by_class(width: Column, classes: tuple[float, float, float] = CLASSES) -> Column:
    """A width divided by 2, 4, 5 or 6, by the class it is in."""
    out = width / DIVISORS[3]
    for limit, divisor in reversed(tuple(zip(classes, DIVISORS))):
        out = F.when(width < limit, width / divisor).otherwise(out)
    return out


def space_threshold(size: Column, space_width: Column, width: Column) -> Column:
    """The gap up to which two characters belong together.

    Half the width of the font's space (null: it has none), unless that is wider than a third of
    the size or nothing; then the current character's width by its class. Widths are
    thousandths of the size.
    """
    space = F.coalesce(size * space_width / 1000.0, F.lit(0.0))
    half = F.when(space > size / 3.0, 0.0).otherwise(space / 2.0)
    return F.when(half == 0.0, size * by_class(width) / 1000.0).otherwise(half)


def leaves_space(x: Column, last_x: Column, width: Column, last_width: Column, threshold: Column) -> Column:
    """Whether a character at ``x`` stands so far from the one before, at ``last_x``, that a space is between."""
    reach, moved = threshold + last_width, x - last_x
    close = F.abs(last_x + last_width - x) <= threshold
    return ~close & ((F.abs(moved) > reach) | ((x < 0.0) & (-reach > moved)) | (moved > width + last_width))


def ends_line(box: Column, before: Column) -> Column:
    """Whether a box (y upwards) has no height in common with the one before. Low boxes end no line."""
    tall = (box["y1"] - box["y0"] > LOW) & (before["y1"] - before["y0"] > LOW)
    return tall & (F.greatest(box["y0"], before["y0"]) >= F.least(box["y1"], before["y1"]))


def ends_column(box: Column, line: Column, size: Column, size_before: Column) -> Column:
    """The same for text set downwards: no width in common with the whole line so far."""
    wide = (box["x1"] - box["x0"] > size * NARROW) & (line["x1"] - line["x0"] > size_before * NARROW)
    return wide & (F.least(box["x1"], line["x1"]) <= F.greatest(box["x0"], line["x0"]))
