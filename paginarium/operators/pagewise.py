"""Boxes of pages that are one row each: visual lines, and the boxes at points and in rectangles, without an exchange.

Here a page is a row with an array of boxes, as a scan of documents gives it. An Arrow function sweeps the boxes of
a batch of rows at once in numpy and returns an array a row, so no box is shuffled. Pages dealt over several rows are for
``sweep`` and ``selection``, which take a row a box; the results are the same. ``apart`` tells the two kinds of pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of a page's boxes and points or rectangles that are held against each other at once.
PAIRS = 1_000_000
CORNERS = ("x0", "y0", "x1", "y1")


def apart(pages: DataFrame, page: str) -> tuple[DataFrame, DataFrame | None]:
    """``pages`` of one row each, and the rows of a page that has several or is null (None if there are none)."""
    several = pages.groupBy(page).agg(F.count(F.lit(1)).alias("n")).where(F.col(page).isNull() | (F.col("n") > 1)).select(F.col(page).alias("_page"))
    if several.isEmpty():
        return pages, None
    same = F.col(page).eqNullSafe(F.col("_page"))
    return pages.join(several, same, "left_anti"), pages.join(several, same, "left_semi")


def _flat(boxes: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The number of boxes a row, their corners end to end, and which of them have all four numbers."""
    sizes = np.asarray(boxes.value_lengths().fill_null(0)).astype(np.int64)
    corners = boxes.flatten().flatten()
    sound = np.ones(len(corners[0]), bool)
    for c in corners:
        sound &= np.asarray(c.is_valid())
    values = [np.asarray(c.fill_null(0)) for c in corners]
    for v in values:
        sound &= ~np.isnan(v) if v.dtype.kind == "f" else True
    return sizes, values, sound


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def numbered_islands(group: np.ndarray, start: np.ndarray, end: np.ndarray, slack: float) -> np.ndarray:
    """For each interval the number of its island within its group, as ``sweep.islands`` counts them."""
    if not len(group):
        return np.zeros(0, np.int64)
    order = np.lexsort((start, group))
    g, s, e = group[order], start[order], np.maximum(start, end)[order]
    ends, rank = np.unique(e, return_inverse=True)
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new_start = new_group | np.concatenate([[True], s[1:] != s[:-1]])
    # a running maximum that begins anew with each group: groups rise along the order
    reached = np.maximum.accumulate(np.cumsum(new_group) * len(ends) + rank) % len(ends)
    begins = new_group.copy()
    begins[1:] |= new_start[1:] & (s[1:] >= ends[reached[:-1]] + slack)
    count = np.cumsum(begins)
    found = np.empty(len(g), np.int64)
    found[order] = count - np.maximum.accumulate(np.where(new_group, count, 0))
    return found


def _swept(boxes: pa.Array, wide: float) -> tuple:
    sizes, (x0, y0, x1, y1), sound = _flat(boxes)
    page = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(sound)
    left, right, low, high = np.minimum(x0, x1)[at], np.maximum(x0, x1)[at], np.minimum(y0, y1)[at], np.maximum(y0, y1)[at]
    row = numbered_islands(page[at], -high, -low, 0)
    before = np.cumsum(np.bincount(page[at], minlength=len(sizes) + 1))  # a page has fewer rows than boxes
    line = np.where(page[at] > 0, before[page[at] - 1], 0) + row
    return sizes, page, at, (left, low, right, high), row, numbered_islands(line, left, right, wide)


def line_of_boxes(boxes: Column, wide: float) -> Column:
    """For each of a page's boxes its (row, part), as ``sweep.visual_lines`` says; null for a box in none."""

    def found(boxes: pa.Array) -> pa.Array:
        sizes, page, at, _, row, part = _swept(boxes, wide)
        out = []
        for values in (row, part):
            whole, lost = np.zeros(len(page), np.int32), np.ones(len(page), bool)
            whole[at], lost[at] = values, False
            out.append(pa.array(whole, mask=lost))
        return _lists(pa.StructArray.from_arrays(out, ["row", "part"]), sizes)

    return F.arrow_udf(found, "array<struct<row:int,part:int>>")(boxes)


def visual_lines(boxes: Column, words: Column, wide: float) -> Column:
    """The lines of a page, an array of (row, part, text, words, x0, y0, x1, y1): its words from left to right, ties by
    their place in the array, how many, and the box around them. Numbers are doubles."""

    def found(boxes: pa.Array, words: pa.Array) -> pa.Array:
        sizes, page, at, (left, low, right, high), row, part = _swept(boxes, wide)
        order = np.lexsort((left, part, row, page[at]))  # a stable sort: places stay in order
        keys = [page[at][order], row[order], part[order]]
        n = len(order)
        new = np.ones(n, bool)
        if n:
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, n))
        text = pc.binary_join(_lists(words.flatten().take(pa.array(at[order])), counts), " ")
        sides = [np.minimum.reduceat(left[order], heads), np.minimum.reduceat(low[order], heads), np.maximum.reduceat(right[order], heads), np.maximum.reduceat(high[order], heads)] if n else [np.zeros(0)] * 4
        fields = [pa.array(keys[1][heads].astype(np.int32)), pa.array(keys[2][heads].astype(np.int32)), text, pa.array(counts), *[pa.array(v.astype(np.float64)) for v in sides]]
        lines = pa.StructArray.from_arrays(fields, ["row", "part", "text", "words", *CORNERS])
        return _lists(lines, np.bincount(keys[0][heads], minlength=len(sizes)))

    return F.arrow_udf(found, "array<struct<row:int,part:int,text:string,words:bigint,x0:double,y0:double,x1:double,y1:double>>")(boxes, words)


def _near(low: np.ndarray, high: np.ndarray, q_low: np.ndarray, q_high: np.ndarray):
    """Pairs (query, interval) whose intervals may touch, in pieces of some ``PAIRS``.

    Intervals are searched by their lower ends, apart by the power of two of their length: one
    long interval doesn't widen the search for short ones.
    """
    size = np.frexp(np.maximum(high - low, 0))[1]
    for s in np.unique(size):
        own = np.flatnonzero(size == s)
        own = own[np.argsort(low[own], kind="stable")]
        edges, longest = low[own], (high - low)[own].max()
        first, last = np.searchsorted(edges, q_low - longest, "left"), np.searchsorted(edges, q_high, "right")
        n = np.maximum(last - first, 0)
        ends = np.cumsum(n)
        begin = 0
        while begin < len(n):
            base = ends[begin - 1] if begin else 0
            stop = max(int(np.searchsorted(ends, base + PAIRS, "right")), begin + 1)
            part = n[begin:stop]
            query = np.repeat(np.arange(begin, stop), part)
            within = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
            yield query, own[first[query] + within]
            begin = stop


def _pages(boxes: pa.Array, asked: pa.Array):
    """For each row how much is asked of it, where its boxes begin in the batch, and both as doubles: corners and places of those whose numbers are all finite."""
    sizes, corners, sound = _flat(boxes)
    q_sizes, q_corners, q_sound = _flat(asked)
    sides, q_sides = ([np.asarray(c, np.float64) for c in v] for v in (corners, q_corners))
    for ok, values in ((sound, sides), (q_sound, q_sides)):
        for v in values:
            ok &= np.abs(v) < 1e18
    ends, q_ends = np.cumsum(sizes), np.cumsum(q_sizes)
    for b, e, qb, qe in zip(ends - sizes, ends, q_ends - q_sizes, q_ends):
        at, q_at = np.flatnonzero(sound[b:e]), np.flatnonzero(q_sound[qb:qe])
        yield int(qe - qb), int(b), at, [v[b:e][at] for v in sides], q_at, [v[qb:qe][q_at] for v in q_sides]


def boxes_in_rects(boxes: Column, index: Column, rects: Column) -> Column:
    """For each rectangle (x0, y0, x1, y1) of a page the ``index`` (a number for each box), in the order of the boxes,
    of those that share area with it."""

    def found(boxes: pa.Array, index: pa.Array, rects: pa.Array) -> pa.Array:
        members, counts, rows = [], [], []
        for n, first, at, (x0, y0, x1, y1), q_at, (l, b, r, t) in _pages(boxes, rects):  # noqa: E741
            rows.append(n)
            met_q, met_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for q, k in _near(y0, y1, b, t) if len(at) and len(q_at) else ():
                shared = (np.minimum(r[q], x1[k]) > np.maximum(l[q], x0[k])) & (np.minimum(t[q], y1[k]) > np.maximum(b[q], y0[k]))
                met_q.append(q_at[q[shared]])
                met_b.append(at[k[shared]])
            q, k = np.concatenate(met_q), np.concatenate(met_b)
            members.append(first + k[np.lexsort((k, q))])
            counts.append(np.bincount(q, minlength=n))
        flat = index.flatten().take(pa.array(np.concatenate([np.zeros(0, np.int64), *members])))
        return _lists(_lists(flat, np.concatenate([np.zeros(0, np.int64), *counts])), np.array(rows, np.int64))

    return F.arrow_udf(found, "array<array<bigint>>")(boxes, index, rects)


def boxes_at_points(boxes: Column, index: Column, points: Column, tolerance: tuple[float, float] = (0.0, 0.0)) -> Column:
    """For each point (x0, y0, x1, y1 with equal ends) of a page the ``index`` (a number for each box) of the box it hits, or
    null, as ``selection.boxes_at_points`` chooses; ``boxes`` are in the order in which ties are settled."""
    mx, my = max(tolerance[0], 0.0) / 2, max(tolerance[1], 0.0) / 2
    near = tolerance[0] > 0 or tolerance[1] > 0

    def found(boxes: pa.Array, index: pa.Array, points: pa.Array) -> pa.Array:
        hits, rows = [np.zeros(0, np.int64)], []
        for n, start, at, (x0, y0, x1, y1), q_at, (x, y, _, _) in _pages(boxes, points):
            rows.append(n)
            l, r, b, t = np.minimum(x0, x1), np.maximum(x0, x1), np.minimum(y0, y1), np.maximum(y0, y1)  # noqa: E741
            best = [np.full(n, -1, np.int64), np.full(n, np.inf)]  # a box that holds the point is at -1
            for q, k in _near(b, t, y - my, y + my) if len(at) and len(q_at) else ():
                inside = (x[q] >= x0[k]) & (x[q] <= x1[k]) & (y[q] >= y0[k]) & (y[q] <= y1[k])
                away = np.minimum(np.abs(x[q] - l[k]), np.abs(x[q] - r[k])) + np.minimum(np.abs(y[q] - b[k]), np.abs(y[q] - t[k]))
                widened = (x[q] >= l[k] - mx) & (x[q] <= r[k] + mx) & (y[q] >= b[k] - my) & (y[q] <= t[k] + my) & (away < 10_000) & near
                kept = inside | widened
                point, place, far = q_at[q[kept]], at[k[kept]], np.where(inside, -1.0, away)[kept]
                order = np.lexsort((place, far, point))
                point, place, far = point[order], place[order], far[order]
                first = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]])) if len(point) else np.zeros(0, np.int64)
                p, c, d = point[first], place[first], far[first]
                better = (d < best[1][p]) | ((d == best[1][p]) & (c < best[0][p]))
                best[0][p[better]], best[1][p[better]] = c[better], d[better]
            hits.append(np.where(best[0] < 0, -1, start + best[0]))
        flat = np.concatenate(hits)
        return _lists(index.flatten().take(pa.array(flat, mask=flat < 0)), np.array(rows, np.int64))

    return F.arrow_udf(found, "array<bigint>")(boxes, index, points)
