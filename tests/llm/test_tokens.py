"""Tokenisation, the automaton, the token files and the packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paginarium.llm import automaton, packing, rans
from paginarium.llm.tokens import library_encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "aa", "b", " ", "  ", "\n", " \n", "é", "ü", "the", "ing", "!", "!!", "1", "23", "'s", "'", "<|endoftext|>", "　", "漢", "🎉", "́", "\x00", "\x1c", "\x85", "-", "_", ",", ".", "İ", "Σ"]
R = random.Random(7)
TEXTS = ["".join(R.choice(ALPHABET) for _ in range(R.randint(0, 30))) for _ in range(1500)] + ["", " ", "a" * 500, "!" * 3001, "ab" * 700, "\n" * 77, " " * 50, "foo, bar. baz,. qux.."]


def per_text(encoder, texts):
    out = []
    for _, flat, counts in encoder.batches(pa.array(texts, pa.string())):
        ends = np.cumsum(counts)
        out += [flat[e - n : e].tolist() for e, n in zip(ends, counts)]
    return out


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_word_encoder_equals_the_library(path, spaced):
    tokenizer = Tokenizer.from_file(path)
    assert per_text(library_encoder(path, spaced), TEXTS) == [e.ids for e in tokenizer.encode_batch(TEXTS, add_special_tokens=False)]


def test_automaton_equals_the_library_and_decodes():
    tokenizer = Tokenizer.from_file(BYTE)
    a, encoder = automaton.automaton(BYTE)
    found = per_text(encoder, TEXTS)
    assert found == [e.ids for e in tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    assert [a.decode(ids).decode() for ids in found] == [tokenizer.decode(ids, skip_special_tokens=False) for ids in found] == TEXTS


def test_linear_pass_equals_the_greedy_walk():
    a, _ = automaton.automaton(BYTE)
    for text in TEXTS[:400]:
        for w in a.presplit.findall(text):
            assert a._all_positions(w.encode()) == a.word(w.encode())


DOCS = [(5, "the end of the page, and more"), (1, None), (3, ""), (2, "the end of the page, and more"), (9, "x" * 5000), (4, " ".join(["word"] * 9000)), (None, "no id"), (7, "twice"), (7, "twice")]
SCHEMA = "doc_id long, text string, start string, n_tokens int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in DOCS], SCHEMA).repartition(3)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_rans_blocks_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 300_000), 50_000).astype(np.int64)
    table = rans.Frequencies(np.bincount(ids, minlength=50_257))
    parts = [ids[:1], ids[1:70], ids[70:200_000], ids[200_000:]]
    coded = rans.encode_blocks(parts, table)
    back = rans.decode_blocks([(*c, len(p)) for c, p in zip(coded, parts)], table)
    assert all((a == b).all() for a, b in zip(parts, back))
    assert sum(4 * len(w) for _, w in coded) < 1.1 * len(ids) * 8.1 / 8  # near the entropy of the distribution
    block = rans.to_bytes(np.array([1]), parts[0], 0, *coded[0])
    with pytest.raises(ValueError):
        rans.from_bytes(block[:-1] + bytes([block[-1] ^ 1]))


def test_one_symbol_alone():
    table = rans.Frequencies(np.array([0, 0, 10]))
    coded = rans.encode_blocks([np.full(1000, 2)], table)
    assert (rans.decode_blocks([(*coded[0], 1000)], table)[0] == 2).all()


def test_token_files(spark, docs, tmp_path):
    out = f"file://{tmp_path}/corpus"
    rans.write_corpus(spark, docs, BYTE, 2, out)
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rans.read_corpus(spark, out).collect())
    at, expected = 0, []
    for i, t in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*ids_of(BYTE, t), 2]
        expected.append((at, i, len(ids), crc(ids)))
        at += len(ids)
    assert found == expected
    empty = docs.where("doc_id = -1")
    rans.write_corpus(spark, empty, BYTE, 2, out + "-empty")
    assert rans.read_corpus(spark, out + "-empty").count() == 0


def test_rows_without_an_id_are_spread(spark, tmp_path):
    from collections import Counter

    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k} " * (k % 5)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokens = rans.tokenised(docs, BYTE, 2, 8).select("shard", "seq", "doc_id").collect()
    assert max(Counter(r["shard"] for r in tokens).values()) < 300
    ids = [r["doc_id"] for r in sorted(tokens, key=lambda r: (r["shard"], r["seq"]))]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    out = f"file://{tmp_path}/spread"
    rans.write_corpus(spark, docs, BYTE, 2, out)
    found = rans.read_corpus(spark, out).collect()
    each = Tokenizer.from_file(BYTE).encode_batch([t for _, t in rows], add_special_tokens=False)
    want = {(i, len(e.ids) + 1, crc([*e.ids, 2])) for (i, _), e in zip(rows, each)}
    assert len(found) == 900 and {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found} == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_crc_of_joined_parts():
    a, b = bytes(range(200)), b"second part" * 99
    assert rans.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_automaton_query(spark, docs):
    found = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in automaton.encode_and_decode(docs, BYTE).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == sorted((i or -1, len(ids_of(BYTE, t)), sha(",".join(map(str, ids_of(BYTE, t)))), sha(t or "")) for i, t in DOCS)


def test_packing(spark, docs):
    rows = packing.pack(spark, docs, WORD, 2).collect()
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    for i, t in DOCS:
        ids, at = [*ids_of(WORD, t), 2], 0
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        if i != 7:
            for r in own:
                assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
                at += r["length"]
            assert at == len(ids)
    assert sum(r["length"] for r in rows) == sum(len(ids_of(WORD, t)) + 1 for _, t in DOCS)
    assert packing.pack(spark, docs.where("doc_id = -1"), WORD, 2).count() == 0


def test_column_generation_covers_demand_exactly_and_nearly_fills():
    rng = np.random.default_rng(3)
    demand = np.zeros(64, np.int64)
    for s in rng.integers(1, 30, 500):
        demand[s - 1] += int(rng.integers(1, 20))
    patterns = packing.column_generation(demand, 64)
    sizes = np.arange(1, 65)
    assert all((p * sizes).sum() <= 64 for p, _ in patterns)
    assert (sum(p * n for p, n in patterns) == demand).all()
    bound = -(-int((demand * sizes).sum()) // 64)
    assert sum(n for _, n in patterns) <= 1.02 * bound + 3
