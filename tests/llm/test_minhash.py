"""MinHash near-duplicates against brute force, the batches' bounds against sums and simulation."""

from __future__ import annotations

import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from paginarium.llm import minhash


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 3:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2))


def corpus():
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, at = [], 0
    passage = [r.choice(vocabulary) for _ in range(80)]
    for base in range(30):
        words = [r.choice(vocabulary) for _ in range(r.randint(2, 200))]
        if base % 3 == 0:
            words = words[:50] + passage + words[50:]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((at, " ".join(own)))
            at += 1
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "A b c"), (904, "a  B\nc"), (905, "a b"), (906, "x"), (906, "x"), (906, "y z"), (None, "x"), (None, "lonely text"), (907, "long " * 20_000 + "end")]
    chain = [f"v{k}" for k in range(150)]
    for k in range(10):  # each like the next only
        own = list(chain)
        for j in range(2 * k, 2 * k + 2):
            own[7 * j % 150] = f"new{k}_{j}"
        rows.append((1000 + k, " ".join(own)))
    return rows


def brute(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for (i, _), g, s in zip(rows, group, sets):
        least = min((j for (j, _), h in zip(rows, group) if h == g and j is not None), default=None)
        out.append((i, len(s), least, i == least))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(corpus())], "doc_id long, text string, n int, sign string").repartition(5)


@pytest.mark.parametrize("block", [minhash.BLOCK, 2])
def test_components_equal_brute_force(spark, docs, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)  # 2: buckets are compared block by block
    found = minhash.near_duplicates(spark, docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(corpus())


def test_pairs_across_components_alone_find_all(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "to_heads", lambda buckets, classes: buckets.select(F.col("rid").alias("a"), F.col("rid").alias("b")).where("a < 0"))
    assert sorted(map(tuple, minhash.near_duplicates(spark, docs).collect()), key=str) == brute(corpus())


def test_empty_table(spark, docs):
    assert minhash.near_duplicates(spark, docs.where("doc_id = -1")).count() == 0


def test_bounds_are_posterior_tails():
    for k in (60, 120, 180):
        m = minhash.least_agreements(k)
        tail = lambda m: sum(comb(k + 1, i) * Fraction(85, 100) ** i * Fraction(15, 100) ** (k + 1 - i) for i in range(m + 1))  # noqa: E731, B023
        assert tail(m - 1) < Fraction(1, 10**9) <= tail(m)
        # the same by numerical integration of the posterior density
        s = np.linspace(0, 1, 200_001)
        density = np.exp((m - 1) * np.log(np.clip(s, 1e-300, 1)) + (k - m + 1) * np.log(np.clip(1 - s, 1e-300, 1)))
        assert density[s >= 0.85].sum() / density.sum() == pytest.approx(float(tail(m - 1)), rel=0.05)


def test_agreements_follow_similarity(spark):
    r = np.random.default_rng(4)
    rows = []
    for common in (40, 200, 340, 400):
        for _ in range(10):
            base = r.integers(0, 1 << 63, 800 - common, dtype=np.uint64)
            a, b = base[:400], np.concatenate([base[:common], base[400:]])
            x, y = minhash.signature(np.sort(a)), minhash.signature(np.sort(b))
            plain = sum((int(p) >> 12 * k & 4095) == (int(q) >> 12 * k & 4095) for p, q in zip(x, y) for k in range(5))
            rows.append((common, x.tolist(), y.tolist(), plain))
    frame = spark.createDataFrame(rows, "common int, x array<long>, y array<long>, plain int")
    counted = sum((minhash.agreements(F.col("x")[k], F.col("y")[k]) for k in range(minhash.BANDS)), F.lit(0))
    found = frame.select("common", "plain", counted.alias("counted"), minhash.likely(F.col("x"), F.col("y")).alias("likely")).collect()
    assert all(f["plain"] == f["counted"] for f in found)
    for common in (40, 200, 340, 400):
        mean = np.mean([f["plain"] for f in found if f["common"] == common]) / 180
        assert abs(mean - common / (800 - common)) < 0.06
    assert {f["likely"] for f in found if f["common"] == 400} == {True} and {f["likely"] for f in found if f["common"] <= 200} == {False}
