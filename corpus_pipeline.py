"""From raw documents to packed training sequences, in four stages.

Each stage takes the documents its predecessor kept (or all, for the first) and is
written before the next one reads it. The first three return the columns of
``documents``; the last returns one row per packed piece.

What the first three do with awkward rows: columns besides doc_id and text are carried
along with their values, whatever their names; an empty table stays empty with its
columns; a text of any length is read whole. Ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paginarium.llm import counterfactual, packing, qda, tsearch
from paginarium.llm.common import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text counts as empty, and empty texts are scored like others (the sample's
    empty texts say how). Repeated rows are decided each, and alike. A score equal to
    the threshold stays.
    """
    return qda.keep_good(spark, docs, sf_dir)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts.

    A null or empty text has the model's bare prior and stays unless most texts are toxic.
    Repeated rows are decided each, and alike. A score equal to the threshold goes.
    """
    return counterfactual.keep_civil(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The one with the smallest id stays; a null id stays only where no member has one; of
    equal ids the smallest text hash, and of rows equal in both the smallest hash of the
    row. Texts that are null or have no words are like nothing, not even each other, so
    all such rows stay, repeated ones too.
    """
    return tsearch.one_of_each(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces with their sequences.

    A null or empty text is one piece of the end id alone. Rows with a null or repeated
    id are documents of their own. Other columns are not read; an empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packed)]

#: Trained classifiers and a tokenizer are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
