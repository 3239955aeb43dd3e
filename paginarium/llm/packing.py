"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

1. Every document is tokenised once; full sequences are cut off its front, so that
   one remainder shorter than a sequence is left. Each piece's digest is taken then,
   and only (document, start, length, digest) goes on.
2. Remainders are counted by length class (length rounded up to ``GRAIN``): a
   histogram of fixed size whatever the corpus.
3. The linear program "fewest sequences that hold the histogram" is solved on the
   driver by column generation: the master problem's prices feed an unbounded
   knapsack over the capacity, solved by dynamic programming, which proposes the next
   pattern until none has reduced cost. Rounded-down pattern counts are completed by
   first-fit decreasing over the few remainders left, as further patterns.
4. Pieces are ranked within their class; a pattern's copies own consecutive ranks of
   each class, so a piece finds its sequence from its rank alone.

Defined cases: a null text is empty and has the end id alone; rows with a repeated or
null doc_id are separate documents; an empty table gives no rows; a document of any
length is cut, never dropped; pieces of one length class and id are ranked by their place in
the written table of pieces; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paginarium.llm.common import settle

CAPACITY = 4096
GRAIN = 16
#: Degenerate steps of the simplex method in a row, at most.
STILL = 2000


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of each document."""

    def run(batches):
        import pyarrow as pa

        from paginarium.llm.tokens import library_encoder

        encoder = library_encoder(path, False)
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for k, flat, counts in encoder.batches(batch.column("text")):
                rows, at = [], 0
                for j, n in enumerate(counts.tolist()):
                    ids = np.append(flat[at : at + n], end_id).astype("<u4")
                    at += n
                    for start in range(0, n + 1, capacity):
                        part = ids[start : start + capacity]
                        rows.append((ids_of[k + j], start, len(part), zlib.crc32(part.tobytes()), n + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def _knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of the sizes 1..len(value) (in grains) within the capacity."""
    k = len(value)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(k, c)
        got = value[:m] + best[c - 1 :: -1][:m]
        j = int(got.argmax())
        if got[j] > best[c - 1] + 1e-12:
            best[c], choice[c] = got[j], j + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(k, np.int64), capacity
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= int(choice[c])
        else:
            c -= 1
    return float(best[capacity]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps with row pivots, without a linear algebra library's threads."""
    n = len(a)
    both = np.hstack([a.astype(float), np.eye(n)])
    for k in range(n):
        row = k + int(np.abs(both[k:, k]).argmax())
        if row != k:
            both[[k, row]] = both[[row, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= np.outer(factor, both[k])
    return both[:, n:]


def times_vector(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, v)


def column_generation(demand: np.ndarray, capacity: int, tolerance: float = 1e-6) -> list[tuple[np.ndarray, int]]:
    """Patterns and their whole multiplicities that cover ``demand`` (by size 1.. in grains) exactly.

    The master keeps a square basis of patterns (revised simplex). It stops at
    optimality: each column that enters lowers the sequences needed, or leaves them (a
    degenerate step; more than ``STILL`` such steps in a row end the search with a basis
    that is feasible anyway).
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    need = demand[sizes - 1].astype(float)
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = times_vector(inverse, need)
    full = np.zeros(capacity)
    k = still = 0
    while still < STILL:
        price = inverse.sum(axis=0)  # all patterns cost one sequence
        full[:] = 0
        full[sizes - 1] = np.maximum(price, 0)
        worth, pattern = _knapsack(full, capacity)
        if worth <= 1 + tolerance:
            break
        column = pattern[sizes - 1].astype(float)
        along = times_vector(inverse, column)
        ratio = np.where(along > 1e-9, x / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        still = 0 if step * (worth - 1) > 1e-9 * x.sum() else still + 1
        x = x - step * along
        x[out] = step
        np.maximum(x, 0, out=x)
        basis[:, out] = column
        pivot = inverse[out] / along[out]
        inverse -= np.outer(along, pivot)
        inverse[out] = pivot
        k += 1
        if k % 100 == 0:
            inverse = inverted(basis)  # rank-one steps add up rounding errors
            x = np.maximum(times_vector(inverse, need), 0)
    left = demand.astype(np.int64).copy()
    chosen: Counter = Counter()
    for j in np.argsort(-x):
        pattern = np.zeros(len(demand), np.int64)
        pattern[sizes - 1] = np.round(basis[:, j]).astype(np.int64)
        used = np.flatnonzero(pattern)
        times = min(int(np.floor(x[j] + 1e-6)), int((left[used] // pattern[used]).min())) if len(used) else 0
        if times > 0:
            left -= times * pattern
            chosen[tuple(pattern)] += times
    # what rounding left over: at most a few pieces for each basic pattern
    while left.any():
        pattern, room, trial = np.zeros(len(demand), np.int64), capacity, left.copy()
        for s in range(len(demand), 0, -1):
            n = min(int(trial[s - 1]), room // s)
            pattern[s - 1], room = n, room - n * s
        used = np.flatnonzero(pattern)
        times = max(1, int((left[used] // pattern[used]).min()))
        left -= times * pattern
        chosen[tuple(pattern)] += times
    return [(np.array(p), n) for p, n in chosen.items()]


def ranks(pieces: DataFrame, by: str) -> DataFrame:
    """``pieces`` with ``rank``, gapless from 0 within each value of ``by``, in order of row.

    The rows of a value are numbered in ``chunk``s of bounded size and the chunks then
    add up, so a value with a third of all rows isn't gathered in one task.
    """
    in_chunk = Window.partitionBy(by, "chunk").orderBy(F.col("doc_id").asc_nulls_first(), "start", "row")
    before = Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("in_chunk", F.row_number().over(in_chunk) - 1)
    chunks = (
        pieces.groupBy(by, "chunk").agg(F.count(F.lit(1)).alias("n"))
        .select(by, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    return numbered.join(chunks, [by, "chunk"]).withColumn("rank", F.col("before") + F.col("in_chunk")).drop("in_chunk", "before", "chunk")


def pack(spark: SparkSession, docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Per piece its sequence and offset there; see the module's text."""
    pieces = settle(
        spark,
        pieces_of(docs, path, end_id, capacity).withColumn("size", F.ceil(F.col("length") / grain).cast("int")).withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    grains = capacity // grain
    histogram = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity/grain rows
    demand = np.zeros(grains, np.int64)
    for r in histogram:
        demand[r["size"] - 1] = r["n"]
    patterns = column_generation(demand, grains)
    # class -> for each pattern that holds it: first rank, pieces per copy, first sequence
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence, filled = 0, np.zeros(grains, np.int64)
    for pattern, times in patterns:
        for s in np.flatnonzero(pattern):
            slots.setdefault(int(s) + 1, []).append((int(filled[s]), int(pattern[s]), sequence))
            filled[s] += pattern[s] * times
        sequence += times
    table = {s: tuple(np.array(c) for c in zip(*rows)) for s, rows in slots.items()}

    def place(size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int64)
        size, rank = size.to_numpy(), rank.to_numpy()
        for s in np.unique(size):
            at = size == s
            first, each, start = table[int(s)]
            k = np.searchsorted(first, rank[at], side="right") - 1
            out[at] = start[k] + (rank[at] - first[k]) // each[k]
        return pd.Series(out)

    per_chunk = 4096  # rows of one class and chunk, on average
    chunks = F.greatest(F.lit(1), F.ceil(F.lit(int(demand.sum())) / per_chunk)).cast("int")
    ranked = ranks(pieces.withColumn("chunk", F.pmod(F.xxhash64("row"), chunks)), "size")
    placed = ranked.withColumn("sequence_id", F.pandas_udf(place, "long")("size", "rank"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("size", "rank", "row")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)
