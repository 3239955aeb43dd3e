"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.llm.common import forget, settle, shared_dir


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    A large-star step links each node's larger neighbours to its smallest one, a
    small-star step its smaller neighbours; after a logarithmic number of rounds every
    node points at its component's smallest. Neighbours are never gathered in one row or
    task: a node's smallest is aggregated before it is sent, and the join back to the edges
    of a hub is one that Spark may split. Each round is written to the shared folder, and
    the one before deleted. Edges with a null end are ignored; without edges there are no rows.
    """
    base, turn = shared_dir(spark), 0
    now = settle(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path=f"{base}/edges0")
    state = None

    def with_least(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")

    while True:
        both = now.union(now.select("v", "u"))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = with_least(large)
        small = low.select("u", F.col("m").alias("v")).union(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        turn += 1
        now = settle(spark, small, path=f"{base}/edges{turn}")
        forget(spark, [f"{base}/edges{turn - 1}"])
        last, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.countDistinct("u")).first()
        if state == last or state[0] == state[2] == 0:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select("v", "v").distinct())


def named(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(key, component_id, component) of classes (key, rid, first_doc): component_id is a component's smallest document."""
    each = classes.select("key", "rid", "first_doc").join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("c", F.coalesce("component", "rid"))
    smallest = each.groupBy("c").agg(F.min("first_doc").alias("component_id"))
    return each.join(smallest, "c").select("key", "component_id", F.col("c").alias("component"))
