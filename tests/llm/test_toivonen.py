"""Phrase mining against plain counting, with the awkward rows and failing samples."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from paginarium.llm import toivonen


def plain(rows, least, first):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    kept = {p: n for p, n in counts.items() if n >= least}
    longer = {}
    for (lang, w), n in kept.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer.get((lang, w[i : i + k]), 0), n)
    out = {}
    for (lang, w), a in kept.items():
        if len(w) > 1 and longer.get((lang, w), -1) < a:
            cuts = [(1000 * a * total[lang] // (kept[lang, w[:k]] * kept[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), kept[lang, w[:k]], kept[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1))


def corpus():
    r = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["Größe", "ÉTÉ", "été", "naïve", "日本", "a b"]
    weights = [1 / (k + 1) for k in range(len(words))]
    fixed = "The quick brown fox jumps over"
    rows = []
    for k in range(400):
        lang = ["en", "de", None, "und", ""][k % 5] if k % 3 else "en"
        parts = [r.choices(words, weights, k=r.randint(0, 40)) for _ in range(3)]
        text = r.choice([". ", "\n", ", ", " ;\t", "\r\n"]).join(r.choice([" ", "  ", " \t"]).join(p) for p in parts)
        rows.append((text + (f" {fixed}" if k % 4 == 0 else ""), lang))
    rows += [("same line of words here", "en")] * 150 + [(None, "en"), (None, None), ("", "de"), (" \t", "xx"), (".,;", "en")]
    rows += [("long words go on. " * 4000, "en"), ("no end " * 3000, "de")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k % 300, t, lang, k) for k, (t, lang) in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int").repartition(6)


def collected(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("share, first, held", [(0.1, 2000, 3_000_000), (0.02, 7, 500), (0.0, 2000, 3_000_000)])
def test_equals_plain_counts(spark, docs, share, first, held, monkeypatch):
    """An empty sample proposes nothing: then each pass finds phrases one word longer."""
    for name, value in {"SHARE": share, "FIRST": first, "LEAST": 30, "HELD": held, "SPELLED": held, "SLICE_BYTES": held}.items():
        monkeypatch.setattr(toivonen, name, value)
    assert collected(toivonen.collocations(spark, docs)) == plain(corpus(), 30, first)


def test_crowded_bits_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(toivonen, "bits_for", lambda n: 64)
    assert collected(toivonen.collocations(spark, docs)) == plain(corpus(), 100, 2000)


def test_sql_agrees(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d.parquet/*.parquet')")
    assert collected(toivonen.collocations(spark, docs)) == sorted(con.sql(toivonen.ORACLE).fetchall())


def test_scores_beyond_64_bits(spark):
    """Exact where 1000 * a * n passes 64 bits, from counts alone."""
    counts = [("en", "", 0, 4 * 10**14), ("en", "x", 1, 3 * 10**11), ("en", "y", 1, 2 * 10**11 + 1), ("en", "x y", 2, 10**11 + 7)]
    frame = spark.createDataFrame(counts, "lang string, phrase string, words int, n long")
    real = toivonen.frequent_phrases
    try:
        toivonen.frequent_phrases = lambda *_: frame
        [row] = toivonen.collocations(spark, None).collect()
    finally:
        toivonen.frequent_phrases = real
    assert row["score"] == 1000 * (10**11 + 7) * (4 * 10**14) // (3 * 10**11 * (2 * 10**11 + 1))


def test_empty_table(spark, docs):
    assert toivonen.collocations(spark, docs.where("doc_id = -1")).count() == 0


def test_words_are_cut_as_bytes_say():
    words = toivonen.Words(["Ab  cD.e", "", "ÄX\ty"], ["en", "de", "en"])
    assert [words.spelled(k, 1) for k in range(len(words.one))] == ["ab", "cd", "e", "Äx", "y"]
    assert words.spelled(0, 2) == "ab cd" and words.starts_of(2).tolist() == [True, False, False, True]
    again = toivonen.Words(["y ab"], ["en"])
    assert words.one[4] == again.one[0] and words.one[0] == again.one[1]
    assert len(np.unique(words.one)) == 5
