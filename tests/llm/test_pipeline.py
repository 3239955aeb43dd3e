"""The pipeline's stages against what the classifiers' scores and a brute-force comparison keep."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from paginarium.llm import counterfactual, qda
from paginarium.llm.common import settle

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]


def test_pipeline_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = settle(spark, docs.join(qda.with_score(docs, qda.fit(docs, labels)).where("score >= 0.3").select("doc_id"), "doc_id").select(*docs.columns))
    civil = counterfactual.with_score(good, counterfactual.fit(good, labels)).where("score < 0.5").select("doc_id", "text").collect()
    assert 0 < len(civil) < docs.count()
    sets = {r["doc_id"]: shingles(r["text"]) for r in civil}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    kept = {i for i, g in group.items() if g == i}
    assert len(kept) < len(sets)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == kept
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in civil}
    lengths = {i: len(tokenizer.encode(text[i], add_special_tokens=False).ids) + 1 for i in kept}
    assert {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in kept} == lengths


def test_stages_return_the_columns_of_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty, very long and repeated rows, and columns named like those that stages make."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, "a text without an id and some words", "x", 7.0, 1), (900_001, None, "x", 7.0, 2), (900_002, "", None, None, 3), (900_002, "", None, None, 3), (900_003, "long words " * 30_000, "x", 8.0, 4), (900_004, "  \n", "x", 8.0, 5)]
    extra = plain.select("doc_id", "text", F.lit("o").alias("own"), F.lit(5.0).alias("score"), F.lit(6).alias("component"))
    rows = extra.unionByName(spark.createDataFrame(odd, "doc_id long, text string, own string, score double, component int"))
    docs = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {str(r) for r in docs.collect()}
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == rows.columns and {str(r) for r in docs.collect()} <= before  # values stay as they were
        assert stage(spark, rows.where("doc_id = -1"), str(tmp_path)).count() == 0
    kept = docs.where("doc_id IS NOT NULL").select("doc_id").collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} >= {r["doc_id"] for r in kept}
    # empty rows that pass the classifiers are like nothing: near-duplicate removal keeps both
    wordless = spark.createDataFrame(odd, "doc_id long, text string, own string, score double, component int")
    left = corpus_pipeline.near_duplicates(spark, wordless, str(tmp_path)).collect()
    assert len(left) == len(odd)
