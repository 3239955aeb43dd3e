"""Sources: texts with form feeds and JSON lines, as tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.sources.writers import FORM_FEED


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, text): text files, cut at form feeds; pages count from 1. A file is one row while it is cut."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    cut = F.split(F.regexp_replace("value", f"{FORM_FEED}\n?$", ""), FORM_FEED, -1)
    return whole.select("file", F.posexplode(cut).alias("page", "text")).withColumn("page", F.col("page") + 1)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON objects; what doesn't parse has all nulls and its text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
