"""Trees as tables: parents from depths, roots and subtree sizes by pointer doubling, look-up under limits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paginarium.operators.lookup import use_checkpoint_folder


def parents_by_depth(rows: DataFrame, by: str, at: str, depth: str, levels: int) -> DataFrame:
    """``rows`` with ``parent``, ``path`` and ``below``, for entries that state their depth alone (an outline).

    The parent is the nearest entry before with a smaller depth, so a jump of depths (1 to 4) makes
    a child of what stands above. ``path`` has the ``at`` of all ancestors from the top, ``below``
    the number of entries under this one. Depths run from 1 to ``levels``; others count as the
    nearer end, a null as the deepest. Entries equal in ``at`` go by depth; the null group is one.
    One running position a level is carried along each group's order, once from each end: no pairs.
    """
    own = F.least(F.greatest(F.coalesce(F.col(depth), F.lit(levels)), F.lit(1)), F.lit(levels))
    each = rows.withColumn("_depth", own)
    onward, backward = Window.partitionBy(by).orderBy(at, "_depth"), Window.partitionBy(by).orderBy(F.desc(at), F.desc("_depth"))
    each = each.withColumn("_k", F.row_number().over(onward)).withColumn("_left", F.row_number().over(backward))
    before, after = onward.rowsBetween(Window.unboundedPreceding, -1), backward.rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.last(F.when(F.col("_depth") == d, F.struct("_k", F.col(at).alias("at"))), ignorenulls=True).over(before).alias(f"_seen{d}") for d in range(1, levels + 1)]
    each = each.select("*", *seen)
    ends = [F.last(F.when(F.col("_depth") == d, F.col("_left")), ignorenulls=True).over(after).alias(f"_end{d}") for d in range(1, levels + 1)]
    each = each.select("*", *ends)
    ancestors = []
    for d in range(1, levels):
        # the last entry of a level is an ancestor if no higher one came after it
        higher = [F.col(f"_seen{e}._k") for e in range(1, d)]
        open_still = F.col(f"_seen{d}._k") > F.greatest(F.lit(0), F.lit(0), *higher)
        ancestors.append(F.when((F.col("_depth") > d) & open_still, F.col(f"_seen{d}.at")))
    path = F.array_compact(F.array(*ancestors)) if ancestors else F.array().cast(f"array<{dict(rows.dtypes)[at]}>")
    stop = F.greatest(F.lit(0), F.lit(0), *[F.when(F.col("_depth") >= d, F.col(f"_end{d}")) for d in range(1, levels + 1)])
    found = each.select(*rows.columns, path.alias("path"), (F.col("_left") - stop - 1).cast("long").alias("below"))
    return found.select(*rows.columns, F.try_element_at("path", F.lit(-1)).alias("parent"), "path", "below")


def placed(sizes: np.ndarray, depth: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent, root, steps, below) of the entries of many outlines end to end, ``sizes`` entries each, with depths from 1 to ``levels``.

    Parents are as in ``parents_by_depth``; parent (-1 at a root) and root are places in the whole. One pass a level each way, over all outlines at once.
    """
    n = len(depth)
    at, last = np.arange(n), np.cumsum(sizes)
    first, stop = np.repeat(last - sizes, sizes), np.repeat(last, sizes)
    parent, root, steps, seen = np.full(n, -1, np.int64), at.copy(), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for level in range(1, levels + 1):
        own = np.flatnonzero(depth == level)
        # what stands above has a smaller depth, so its own root is known by now
        own = own[seen[own] >= first[own]]
        up = seen[own]
        parent[own], root[own], steps[own] = up, root[up], steps[up] + 1
        seen = np.maximum.accumulate(np.where(depth <= level, at, -1))
    end, after = stop.copy(), np.full(n, n, np.int64)
    for level in range(1, levels + 1):
        own = np.flatnonzero(depth == level)
        after = np.minimum.accumulate(np.where(depth <= level, at, n)[::-1])[::-1]
        inner = own[own + 1 < n]
        end[inner] = np.minimum(stop[inner], after[inner + 1])
    return parent, root, steps, end - at - 1


#: Tags of pages that are placed at once; a page with more is placed alone.
TAGS = 1_000_000


def placed_elements(tags: Column, void: list[str], levels: int) -> Column:
    """The elements of a page, an array of (n, parent, root, depth, below), out of the array of its ``tags``.

    Parents are those of ``parents_by_depth`` over ``structure.elements``; ``n``, ``parent`` (null at a root) and ``root`` are places among
    the tags, ``depth`` counts the steps up to the root, ``below`` the elements under this one. An Arrow function works on a batch of pages.
    """

    def part(tags: pa.Array) -> pa.Array:
        rows = len(tags)
        each = np.repeat(np.arange(rows), np.asarray(tags.value_lengths().fill_null(0)))
        flat = tags.flatten()
        place = np.arange(len(flat)) - np.searchsorted(each, each)
        holds = ~np.asarray(pc.is_in(flat, value_set=pa.array(void, flat.type)))
        each, place, closes = each[holds], place[holds], np.asarray(pc.starts_with(flat, "</"))[holds]
        change = np.where(closes, -1, 1)
        before = np.cumsum(change) - change
        before = before - before[np.searchsorted(each, each)]
        opens = ~closes
        each, place, depth = each[opens], place[opens], np.clip(before[opens] + 1, 1, levels)
        sizes = np.bincount(each, minlength=rows)
        parent, root, steps, below = placed(sizes, depth, levels)
        ids = [place.astype(np.int32), pa.array(place[parent].astype(np.int32), mask=parent < 0), place[root].astype(np.int32)]
        elements = pa.StructArray.from_arrays([pa.array(v) for v in (*ids, steps, below)], ["n", "parent", "root", "depth", "below"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), elements)

    def found(tags: pa.Array) -> pa.Array:
        sizes = np.asarray(tags.value_lengths().fill_null(0)).astype(np.int64)
        starts = np.unique((np.cumsum(sizes) - sizes) // TAGS, return_index=True)[1]
        edges = [0, *starts[1:].tolist(), len(tags)]
        return pa.concat_arrays([part(tags.slice(a, b - a)) for a, b in zip(edges, edges[1:])])

    return F.arrow_udf(found, "array<struct<n:int,parent:int,root:int,depth:bigint,below:bigint>>")(tags)


#: Named values of a node, each with how the value of those above meets its own.
Carry = dict[str, tuple[Column, Callable[[Column, Column], Column]]]


def rooted(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth, below) of a forest given by parents, by pointer doubling.

    ``depth`` counts the steps up to the root (0 at a root), ``below`` the nodes under this one. A
    parent that is no node makes a root; of repeated nodes the smallest parent stays; null nodes
    go. Nodes on a cycle, or under one, reach no root: they keep null in all three.

    A round doubles the reach of every pointer, so a tree of depth d takes log2(d) rounds of equi-joins and
    one pre-aggregated sum, and one more where there is a cycle: a round that brings no node to its root is the
    last, as only nodes on cycles and under them are left. A parent of a third of all nodes is a skewed key of the
    probing side alone, which adaptive joins split. Rounds are checkpointed in the folder that ``spark.checkpoint.dir`` names.
    """
    return _doubled(nodes, node, parent, {})


def carried_down(nodes: DataFrame, node: str, parent: str, carry: Carry) -> DataFrame:
    """(node, root, depth, below, *carry): ``rooted`` with values met from the root down to each node.

    Nodes that reach no root don't appear: around a cycle what is carried would grow without end.
    """
    reach = rooted(nodes, node, parent).where("root IS NOT NULL").select(F.col("node").alias(node))
    return _doubled(nodes.join(reach, node, "left_semi"), node, parent, carry)


def _doubled(nodes: DataFrame, node: str, parent: str, carry: Carry) -> DataFrame:
    use_checkpoint_folder(nodes.sparkSession)
    row = F.struct(F.col(parent).alias("up"), *[value.alias(name) for name, (value, _) in carry.items()])
    own = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(row).alias("row")).select("node", "row.*")
    known = own.select(F.col("node").alias("jump"))
    state = own.join(known, own["up"] == known["jump"], "left").select(
        "node", "jump", F.coalesce("jump", "node").alias("root"), F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.lit(1).cast("long").alias("size"), *carry,
    ).checkpoint()
    before, moving = None, state.where("jump IS NOT NULL").count()
    while moving and moving != before:
        above = state.select(F.col("node").alias("a_node"), F.col("jump").alias("a_jump"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), *[F.col(c).alias(f"a_{c}") for c in carry])
        sums = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("s_node")).agg(F.try_sum("size").alias("more"))
        met = state.join(above, state["jump"] == above["a_node"], "left").join(sums, state["node"] == sums["s_node"], "left")
        moves = F.col("jump").isNotNull()
        # the value of the node jumped to has all above it up to its own jump
        joined = [F.when(moves, meet(F.col(f"a_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c, (_, meet) in carry.items()]
        state = met.select(
            "node", F.col("a_jump").alias("jump"), F.coalesce("a_root", "root").alias("root"), (F.col("depth") + F.when(moves, F.col("a_depth")).otherwise(0)).alias("depth"),
            F.try_add("size", F.coalesce("more", F.lit(0))).alias("size"), *joined,
        ).checkpoint()
        before, moving = moving, state.where("jump IS NOT NULL").count()
    ends = F.col("jump").isNull()
    return state.select("node", *[F.when(ends, c).alias(name) for name, c in (("root", F.col("root")), ("depth", F.col("depth")), ("below", F.col("size") - 1), *((c, F.col(c)) for c in carry))])


def repaired_limits(low: Column, high: Column) -> tuple[Column, Column]:
    """Limits as a reader takes them: none if both lack, a lacking one is the empty text, turned round if out of order."""
    given = low.isNotNull() | high.isNotNull()
    a, b = F.coalesce(low, F.lit("")), F.coalesce(high, F.lit(""))
    return F.when(given, F.least(a, b)), F.when(given, F.greatest(a, b))


def names_under_limits(keys: DataFrame, key: str, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``keys`` with ``leaf`` and ``value``: what a name tree answers for each key, null where it has nothing.

    ``nodes`` (node, parent, place, low, high) are the tree, ``entries`` (leaf, at, name, value) its leaves.
    A node answers for keys from ``low`` to ``high`` alone, and so do all below it; of several answers the
    first in tree order (by ``place``, then ``at``) counts. Nodes that reach no root answer nothing.

    Walking every key down the tree would pair keys with all children of a node. Instead limits are carried
    down to the leaves once (the tree is small beside its entries), each entry is held against its leaf's
    limits, and keys meet the entries left by an equi-join.
    """
    low, high = repaired_limits(F.col("low"), F.col("high"))
    tree = carried_down(
        nodes, "node", "parent",
        {"order": (F.array("place"), F.concat), "lowest": (low, lambda up, own: F.greatest(up, own)), "highest": (high, lambda up, own: F.least(up, own))},
    )
    held = entries.join(tree.select(F.col("node").alias("leaf"), "order", "lowest", "highest"), "leaf")
    within = F.coalesce(F.col("name") >= F.col("lowest"), F.lit(True)) & F.coalesce(F.col("name") <= F.col("highest"), F.lit(True))
    first = held.where(within & F.col("name").isNotNull()).groupBy(F.col("name").alias("_name")).agg(F.min(F.struct("order", "at", "leaf", "value")).alias("_first"))
    return keys.join(first, keys[key] == first["_name"], "left").select(*[keys[c] for c in keys.columns], F.col("_first.leaf").alias("leaf"), F.col("_first.value").alias("value"))
