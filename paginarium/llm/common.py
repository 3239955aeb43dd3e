"""What several operators share: the shared folder, splits by id, label samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent in a local session (as in tests) a temporary
    folder takes its place, one for the session; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="paginarium-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/paginarium-{uuid.uuid4().hex}"


def settle(spark: SparkSession, df: DataFrame, name: str = "t", compression: str = "zstd", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or to ``path`` in it) and read it again: lineage ends there."""
    path = path or f"{shared_dir(spark)}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``settle`` wrote and nothing reads any more, and let Spark drop shuffle files without a user."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    jvm.System.gc()


def id_remainder(doc_id: str | Column = "doc_id", mod: int = 5) -> Column:
    """crc32 of the id as text, modulo ``mod``; -1 for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % mod, F.lit(-1)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, held_out: int = 0) -> DataFrame:
    """At most ``limit`` labelled rows to learn from: (text, label).

    Rows whose id remainder is ``held_out`` never enter. Ids repeated in ``labels``
    count once (greatest label), and so do ids repeated in ``docs`` (smallest text). The kept ids are those with the smallest seeded
    hash, so the sample doesn't depend on row order or partitioning; its bound
    makes the broadcast of ids safe.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_remainder() != held_out))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(limit)
    )
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        .select("doc_id", "text", "y")
    )
