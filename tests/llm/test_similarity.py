"""The similarity join and exact top-k against brute force, with the awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paginarium.llm import topk, tsearch
from paginarium.llm.components import components


def sets_by_words(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute_components(rows):
    """Index of each row's component, by comparing all pairs."""
    sets, group = [sets_by_words(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group, [len(s) for s in sets]


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    passage = [r.choice(vocabulary) for _ in range(60)]
    for base in range(25):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 160))]
        if base % 4 == 0:
            words = words[:40] + passage + words[40:]
        for copy in range(r.choice([1, 1, 2, 6, 14])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((at, " ".join(own)))
            at += 1
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "A b c"), (904, "a  B\nc"), (905, "a b c d"), (906, "x"), (906, "x"), (906, "y z"), (None, "x"), (None, "lonely text here ok"), (907, "long " * 9000 + "end")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{k % 3}", k) for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n int").repartition(5)


@pytest.mark.parametrize("parts", [tsearch.SALTED, 3])
def test_components_equal_brute_force(spark, docs, parts, monkeypatch):
    monkeypatch.setattr(tsearch, "SALTED", parts)  # 3: lists and hubs are dealt over several keys
    rows = corpus()
    group, sizes = brute_components(rows)
    smallest = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)}
    expected = sorted((i is None, i or 0, n, -1 if smallest[g] is None else smallest[g]) for (i, _), g, n in zip(rows, group, sizes))
    found = tsearch.near_duplicates(spark, docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in found) == expected


def test_one_document_of_each_group_stays(spark, docs):
    rows = corpus()
    group, sizes = brute_components(rows)
    kept = tsearch.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    wordless = sum(n == 0 for n in sizes)
    assert kept.count() == len({g for g, n in zip(group, sizes) if n}) + wordless


def test_empty_table(spark, docs):
    assert tsearch.near_duplicates(spark, docs.where("doc_id = -5")).count() == 0


def test_all_pairs_across_components_are_seen(spark):
    """A chain where no member is like the head of its lists, nor like its neighbour in size order."""
    base = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(12):
        words = list(base)
        for j in range(k * 2, k * 2 + 2):
            words[5 * j % 120] = f"new{k}_{j}"
        rows.append((k, " ".join(words)))
    group, _ = brute_components(rows)
    found = {r["doc_id"]: r["component_id"] for r in tsearch.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for a in range(12):
        for b in range(12):
            assert (found[a] == found[b]) == (group[a] == group[b])


def test_graph_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 300), (300, 100), (5, 5)]
    found = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, 100: 100, 200: 100, 300: 100}


def test_filter_bit_is_sparks(spark):
    keys = [bytes([k]) * 16 for k in range(20)]
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").select(tsearch.key_bit("key").alias("b")).collect()
    assert [r["b"] for r in rows] == [tsearch._spark_bit(k) for k in keys]


def brute_top(rows, k, modulus):
    sound = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sound:
        if i % modulus == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [1, 12])
def test_top_k_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", (10, 10))
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6) * (np.array([spread, 1, 1, 1, 1, 1]))]) for i in range(240)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, [1.0, None, 0.0]), (1004, [float("nan")] * 6), (1005, [float("inf")] + [0.0] * 5), (1006, []), (1020, [0.0] * 6), (1040, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    found = topk.top_k(table, F.col("vec_id") % 20 == 0, 5)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 5, 20)
    assert topk.top_k(table.where("vec_id < 0"), F.col("vec_id") % 20 == 0, 5).count() == 0


def settled(vectors, ids, queries, owns, k, axes):
    """The walks' results and the shares of list entries read and of candidates scored."""
    lists, tops = topk.Lists(vectors, ids, axes), [topk.Top(k) for _ in queries]
    for low in range(0, len(queries), topk.TOGETHER):
        lists.walk(queries[low : low + topk.TOGETHER], owns[low : low + topk.TOGETHER], tops[low : low + topk.TOGETHER])
    scores = (queries @ vectors.T).astype(float)
    scores[owns[:, None] == ids] = -np.inf
    for row, top in zip(scores, tops):
        at = np.lexsort((ids, -row))[:k]
        assert (top.ids == ids[at]).all() and (top.scores == row[at]).all()
    return lists.read / vectors.size / len(queries), lists.scored / len(vectors) / len(queries)


def test_the_threshold_stops_early():
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(4000, 3)) ** 3 * 64)
    read, scored = settled(vectors, np.arange(4000), np.array([[5.0, -3.0, 1.0]]), np.array([-1]), 5, np.eye(3))
    assert read < 0.1 and scored < 0.1
    # sixteen dimensions of which two matter, turned so that no own axis shows it
    turn = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    vectors = np.floor(64 * (rng.normal(size=(6000, 16)) * np.append([3, 2], np.full(14, 0.03))) @ turn)
    axes = np.linalg.eigh(np.cov(vectors.T))[1]
    ids, queries = np.arange(6000), vectors[:40]
    read, scored = settled(vectors, ids, queries, ids[:40], 5, axes)
    assert read < 0.1 and scored < 0.3
    assert settled(vectors, ids, queries, ids[:40], 5, np.eye(16))[1] > scored


def test_every_query_of_the_real_table_is_settled_by_the_walk(spark):
    """All 64 dimensions spread alike there, so walks end when all are met: after few list entries, but all are scored."""
    pdf = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    vectors = np.floor(64 * np.stack(pdf["embedding"].to_numpy()).astype(float))
    ids = pdf["vec_id"].to_numpy(np.int64)
    mine = ids % 20 == 0
    read, scored = settled(vectors, ids, vectors[mine], ids[mine], 20, np.linalg.eigh(np.cov(vectors.T))[1])
    assert read < 0.25 and scored <= 1


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(300):
        base = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = np.unique(base[: rng.integers(1, 200)]), np.unique(base[rng.integers(0, 100) : rng.integers(100, 200)])
        bits = int(np.bitwise_count((tsearch.signature(a) ^ tsearch.signature(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))
    assert len(tsearch.signature(base[:0])) == tsearch.SIGNS
