"""Look-ups the file model needs: as-of, pairing, reachability, uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, out: str, bucket: Column | None = None) -> DataFrame:
    """``left`` with ``out``: the value of the last row of ``right`` at or before each row, within ``by``.

    Both sides share one sort by (by, bucket, at): no range join, no row pairs. ``bucket`` is
    a rising function of ``at`` (a day, an hour): a key with a third of all rows is then
    sorted bucket by bucket, and what a row finds before its bucket is carried forward over
    one row a bucket. Ties in ``at`` take the greatest value; a null ``at`` finds nothing.
    """
    bucket = F.lit(0) if bucket is None else bucket
    seen = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    r = right.where(F.col(at).isNotNull()).select(F.col(by).alias("k"), F.col(at).alias("t"), bucket.alias("b"), seen.alias("seen"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("row"), F.lit(0).alias("side"))
    own = left.select(F.col(by).alias("k"), F.col(at).alias("t"), bucket.alias("b"), F.lit(None).cast(r.schema["seen"].dataType).alias("seen"), F.struct("*").alias("row"), F.lit(1).alias("side"))
    both = r.unionByName(own)
    inside = Window.partitionBy("k", "b").orderBy("t", "side", "seen").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("k", "b").agg(F.max("seen").alias("newest")).select(F.col("k").alias("ck"), F.col("b").alias("cb"), F.last("newest", ignorenulls=True).over(before).alias("carried"))
    found = both.withColumn("last", F.last("seen", ignorenulls=True).over(inside)).where("side = 1")
    joined = found.join(carried, found["k"].eqNullSafe(carried["ck"]) & found["b"].eqNullSafe(carried["cb"]), "left")
    last = F.when(F.col("t").isNotNull() & F.col("k").isNotNull(), F.coalesce("last", "carried"))
    return joined.select("row.*", last["value"].alias(out))


def paired(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, left, right): full outer pairing, a side that lacks the key is null."""
    return left.select(*keys, F.col(value).alias("left")).join(right.select(*keys, F.col(value).alias("right")), keys, "full_outer")


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that ``spark.checkpoint.dir`` names; without it there are none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, steps): nodes that the roots reach over (src, dst) edges, with the fewest steps.

    A round joins the newest nodes with the edges; it ends when a round finds nothing, however deep
    the graph; cycles add nothing. Rounds are checkpointed in the folder that
    ``spark.checkpoint.dir`` names; that setting is needed.
    """
    use_checkpoint_folder(edges.sparkSession)
    found = roots.select("node").distinct().withColumn("steps", F.lit(0)).checkpoint()
    newest, k = found, 0
    while not newest.isEmpty():
        k += 1
        step = newest.join(edges, newest.node == edges.src).select(F.col("dst").alias("node")).distinct()
        newest = step.join(found.select("node"), "node", "left_anti").withColumn("steps", F.lit(k)).checkpoint()
        found = found.unionByName(newest)
    return found
