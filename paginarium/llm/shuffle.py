"""Two-pass external shuffle of a table into shards.

Pass 1 scatters whole records by a seeded hash into buckets that fit in memory;
pass 2 shuffles each bucket (``shuffle`` is a Fisher-Yates permutation of an
array) and writes it. A record's global position is its bucket's first position
plus its place in the bucket; shards are equal cuts of the positions, so row
counts of shards differ by at most one.

Only DataFrame functions are used. Nothing but one row per bucket is ever summed
globally, and that in two levels.

Defined cases: a null size column counts 0; equal rows are separate records (the
hash also takes the row's place in the scan, so copies of one key spread over all
buckets); an empty table gives no rows; a single record larger than the bucket
size has its bucket to itself and its companions. Columns of the input keep their
names, and the order depends on how the table lies in its files (the hash takes the row's
place in the scan); ``bucket``, ``place``, ``shard`` and ``slot`` of the input are overwritten
only inside a struct and therefore survive under ``record``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paginarium.llm.common import shared_dir

BUCKET_BYTES = 4 << 20


def scatter_and_write(spark: SparkSession, df: DataFrame, size: Column, seed: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write every record of ``df`` once; the written table (bucket, place, record)."""
    total = df.agg(F.sum(size).alias("b")).first()["b"] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"))
    hashed = named.withColumn("h", F.xxhash64(F.lit(seed), "record", F.monotonically_increasing_id()))
    scattered = (
        hashed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
        .repartition("bucket").sortWithinPartitions("bucket", "h")
        .groupBy("bucket").agg(F.collect_list("record").alias("records"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "record"))
    )
    path = f"{shared_dir(spark)}/buckets"
    scattered.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(scattered.schema).parquet(path)


def first_positions(counts: DataFrame, per_group: int = 4096) -> DataFrame:
    """(bucket, first): the records in all buckets before it. ``counts``: (bucket, n)."""
    grouped = counts.withColumn("g", F.floor(F.col("bucket") / per_group))
    inner = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("g").agg(F.sum("n").alias("gn")).select("g", F.coalesce(F.sum("gn").over(outer), F.lit(0)).alias("g0"))
    return (
        grouped.select("g", "bucket", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("b0"))
        .join(groups, "g").select("bucket", (F.col("g0") + F.col("b0")).alias("first"))
    )


def external_shuffle(spark: SparkSession, df: DataFrame, n_shards: int, size: Column, seed: int = 1, bucket_bytes: int = BUCKET_BYTES, keep: list[Column] | None = None) -> DataFrame:
    """Every written record with shard and slot, ``slot`` gapless from 0 in each shard.

    ``keep``: what to take of each record as read back (columns over ``record``);
    the whole ``record`` by default. It is taken before the positions are joined.
    """
    written = scatter_and_write(spark, df, size, seed, bucket_bytes)
    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    base, over = divmod(int(rows), n_shards)
    long = over * (base + 1)  # positions in the shards that have one row more
    at = F.col("first") + F.col("place")
    shard = F.when(at < long, F.floor(at / F.lit(base + 1))).otherwise(over + F.floor((at - long) / F.lit(max(base, 1))))
    start = F.when(F.col("shard") < over, F.col("shard") * (base + 1)).otherwise(long + (F.col("shard") - over) * base)
    return (
        written.select("bucket", "place", F.struct(*(keep or [F.col("record")])).alias("kept"))
        .join(first_positions(counts), "bucket")
        .withColumn("at", at.cast("long")).withColumn("shard", shard.cast("int"))
        .select("kept.*", "shard", (F.col("at") - start).cast("long").alias("slot"))
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size, text = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16, F.col("record.text")
    digest = [
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    ]
    return external_shuffle(spark, docs, 40, size, keep=digest).withColumn("grown_shard", F.lit(None).cast("int"))
