"""Token ids in a binary file format: static range asymmetric numeral system.

One frequency table, counted over the whole corpus and scaled to 2**20 slots, serves
all blocks. A block holds up to ``BLOCK`` ids of consecutive documents, interleaved
over ``LANES`` independent 64-bit states that share one stream of 32-bit words, so
both directions run in numpy over all lanes of several blocks at once. A block
decodes by itself.

Block layout (little-endian)::

    "RNS1"  u32 n_docs  u32 n_ids  u32 n_words  u64 first   -- checkpoint
    u32 crc32 of the ids as u32  u32 crc32 of all bytes after this header
    n_docs x (u32 ids of the document in this block)
    LANES x u64 initial decoder states
    n_words x u32

``first`` is the position of the block's first id among all ids of the corpus.
Blocks lie in ascending document order in the rows of a Parquet folder (which gives
atomic commits and splitting); the frequency table is a second small folder.

Defined cases: a null text is empty; every document ends with the end id, so none is
without ids; a document longer than a block continues in the next; a null doc_id
sorts first; rows with equal doc_id are ordered by a hash of the text, and of equal
texts the order makes no difference; an empty table gives no blocks; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.llm.common import settle, shared_dir

BITS = 20
LANES = 64
BLOCK = 1 << 15
#: Blocks coded together, so that numpy works on LANES * TOGETHER states.
TOGETHER = 48
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIIIQII")


class Frequencies:
    """Counts of every id, scaled so that they sum to 2**BITS and none that occurs is 0."""

    def __init__(self, counts: np.ndarray):
        counts = counts.astype(np.float64)
        present = np.flatnonzero(counts)
        freq = np.zeros(len(counts), np.int64)
        if len(present):
            if len(present) > 1 << BITS:
                raise ValueError("more distinct ids than slots")
            spare = (1 << BITS) - len(present)
            share = counts[present] / counts.sum() * spare
            freq[present] = 1 + np.floor(share).astype(np.int64)
            short = (1 << BITS) - int(freq.sum())
            order = present[np.argsort(-(share - np.floor(share)), kind="stable")]
            freq[order[:short]] += 1
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint16 if len(counts) <= 1 << 16 else np.int32), freq)


def _grid(parts: list[np.ndarray], fill: int) -> np.ndarray:
    """(steps, blocks, lanes), blocks shorter than the longest padded with ``fill``."""
    steps = max(-(-len(p) // LANES) for p in parts)
    out = np.full((len(parts), steps * LANES), fill, np.int64)
    for k, p in enumerate(parts):
        out[k, : len(p)] = p
    return out.reshape(len(parts), steps, LANES).transpose(1, 0, 2)


def encode_blocks(parts: list[np.ndarray], table: Frequencies) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each array of ids: the initial decoder states and the words."""
    sizes = np.array([len(p) for p in parts])
    grid = _grid(parts, -1)
    steps = grid.shape[0]
    x = np.full(grid.shape[1:], LOW, np.uint64)
    sent, words = np.zeros(grid.shape, bool), np.zeros(grid.shape, np.uint32)
    bits, word, room = np.uint64(BITS), np.uint64(32), np.uint64(43)
    freq = np.append(table.freq, np.uint64(1))
    low = np.append(table.low, np.uint64(0))
    for t in range(steps - 1, -1, -1):
        s = grid[t]
        live = s >= 0
        f, c = freq[s], low[s]
        out = live & (x >= (f << room))
        sent[t] = out
        words[t] = x.astype(np.uint32)
        x = np.where(out, x >> word, x)
        q = x // f
        x = np.where(live, (q << bits) + (x - q * f) + c, x)
    return [(x[k].copy(), words[:, k][sent[:, k]]) for k in range(len(sizes))]


def decode_blocks(coded: list[tuple[np.ndarray, np.ndarray, int]], table: Frequencies) -> list[np.ndarray]:
    """The ids of blocks given as (states, words, how many ids)."""
    sizes = np.array([n for _, _, n in coded])
    steps = int(max(-(-sizes // LANES)))
    x = np.stack([s for s, _, _ in coded])
    pad = np.zeros(LANES, np.uint32)
    starts = np.cumsum([0] + [len(w) + LANES for _, w, _ in coded[:-1]])[:, None]
    stream = np.concatenate([a for _, w, _ in coded for a in (w, pad)]).astype(np.uint64)
    at = starts.copy()
    out = np.zeros((steps, len(coded), LANES), np.int32)
    mask, bits, word = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    lane = np.arange(LANES)
    for t in range(steps):
        live = t * LANES + lane < sizes[:, None]
        slot = x & mask
        s = table.symbol[slot]
        out[t] = s
        x = np.where(live, table.freq[s] * (x >> bits) + slot - table.low[s], x)
        need = live & (x < LOW)
        taken = np.cumsum(need, axis=1)
        got = stream[at + np.where(need, taken - 1, 0)]
        x = np.where(need, (x << word) | got, x)
        at = at + taken[:, -1:]
    if not (x == LOW).all():
        raise ValueError("a block's states don't end where they began")
    return [out[:, k].reshape(-1)[:n] for k, n in enumerate(sizes)]


def to_bytes(doc_counts: np.ndarray, ids: np.ndarray, first: int, states: np.ndarray, words: np.ndarray) -> bytes:
    body = doc_counts.astype("<u4").tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return HEAD.pack(b"RNS1", len(doc_counts), len(ids), len(words), first, crc, zlib.crc32(body)) + body


def from_bytes(block: bytes) -> tuple[np.ndarray, int, int, tuple[np.ndarray, np.ndarray, int]]:
    """(ids of each document in the block, first, crc of the ids, (states, words, n))."""
    magic, n_docs, n_ids, n_words, first, crc, body_crc = HEAD.unpack_from(block)
    if magic != b"RNS1" or zlib.crc32(memoryview(block)[HEAD.size :]) != body_crc:
        raise ValueError("not a sound block")
    at = HEAD.size
    counts = np.frombuffer(block, "<u4", n_docs, at).astype(np.int64)
    states = np.frombuffer(block, "<u8", LANES, at + 4 * n_docs).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, at + 4 * n_docs + 8 * LANES)
    return counts, first, crc, (states, words, n_ids)


def id_type(path: str) -> str:
    """Two bytes an id where the vocabulary allows it, else four."""
    model = json.load(open(path, encoding="utf-8"))
    return "<u2" if len(model["model"]["vocab"]) + len(model["added_tokens"]) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, end_id: int, partitions: int) -> DataFrame:
    """(shard, seq, before, doc_id, ids) in ascending doc_id order; ids as one binary.

    ``shard`` numbers the ranges of (doc_id, hash of the text), so rows without an id, or
    with one that repeats, are spread too; ``seq`` numbers the rows of a shard, ``before``
    counts the shard's ids before the row. Ids are packed by ``id_type(path)``.
    """
    kind = id_type(path)
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ranged = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )

    def run(batches):
        import pyarrow as pa

        from paginarium.llm.tokens import library_encoder

        encoder, seq, before = library_encoder(path, True), 0, 0
        for batch in batches:
            for k, flat, counts in encoder.batches(batch.column("text")):
                n = len(counts)
                packed, at = [], 0
                for c in counts.tolist():
                    packed.append(np.append(flat[at : at + c], end_id).astype(kind).tobytes())
                    at += c
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("shard").slice(k, n), pa.array(np.arange(seq, seq + n)),
                        pa.array(before + np.cumsum(counts + 1) - counts - 1), batch.column("doc_id").slice(k, n).cast(pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["shard", "seq", "before", "doc_id", "ids"],
                )
                seq, before = seq + n, before + int((counts + 1).sum())

    return ranged.mapInArrow(run, "shard int, seq long, before long, doc_id long, ids binary")


def count_ids(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, n) over the whole table, counted within tasks first."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                more = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 2000).to_pylist()), kind))
                if len(more) > len(total):
                    total = np.append(total, np.zeros(len(more) - len(total), np.int64))
                total[: len(more)] += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode_table(tokens: DataFrame, kind: str, counts: np.ndarray, shard_first: dict[int, int]) -> DataFrame:
    """Blocks of the tokenised table: (shard, seq, block, doc_ids).

    Blocks are cut anew wherever the rows at hand aren't consecutive, so any split of
    the table into tasks gives sound blocks.
    """

    def run(batches):
        import pyarrow as pa

        table, waiting = Frequencies(counts), []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        docs: list[int | None] = []
        state = {"n": 0, "next": None, "first": 0, "shard": 0, "seq": 0}

        def close():
            if sizes:
                waiting.append((state["shard"], state["seq"], state["first"], np.concatenate(held), np.array(sizes), list(docs)))
                state["first"] += state["n"]
                held.clear(), sizes.clear(), docs.clear()
                state["n"] = 0

        def flush():
            coded = encode_blocks([w[3] for w in waiting], table)
            rows = [(w[0], w[1], to_bytes(w[4], w[3], w[2], *c), w[5]) for w, c in zip(waiting, coded)]
            waiting.clear()
            shard, seq, block, doc = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(seq, pa.int64()), pa.array(block, pa.binary()), pa.array(doc, pa.list_(pa.int64()))],
                names=["shard", "seq", "block", "doc_ids"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["seq"]) != state["next"]:
                    close()
                    state["first"] = shard_first[row["shard"]] + row["before"]
                state["next"] = row["shard"], row["seq"] + 1
                ids, at = np.frombuffer(row["ids"], kind), 0
                while at < len(ids):
                    if not sizes:
                        state["shard"], state["seq"] = row["shard"], row["seq"]
                    take = ids[at : at + BLOCK - state["n"]]
                    held.append(take), sizes.append(len(take)), docs.append(row["doc_id"])
                    state["n"] += len(take)
                    at += len(take)
                    if state["n"] == BLOCK:
                        close()
                        if len(waiting) >= TOGETHER:
                            yield flush()
        close()
        while waiting:
            yield flush()

    return tokens.mapInArrow(run, "shard int, seq long, block binary, doc_ids array<long>")


def decode_table(blocks: DataFrame, counts: np.ndarray) -> DataFrame:
    """Pieces of documents: (shard, doc_seq, piece, doc_id, start, n, crc), one per block a document lies in."""

    def run(batches):
        import pyarrow as pa

        table = Frequencies(counts)

        def flush(rows):
            parsed = [from_bytes(r["block"]) for r in rows]
            out = []
            for r, (sizes, first, crc, coded), ids in zip(rows, parsed, decode_blocks([p[3] for p in parsed], table)):
                raw = memoryview(ids.astype("<u4").tobytes())
                if zlib.crc32(raw) != crc:
                    raise ValueError("a block's ids don't match their checksum")
                at = 0
                for k, n in enumerate(sizes.tolist()):
                    out.append((r["shard"], r["seq"] + k, r["doc_ids"][k], first + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                    at += n
            cols = list(zip(*out))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "seq", "doc_id", "start", "n", "crc"])

        rows = []
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                if len(rows) == TOGETHER:
                    yield flush(rows)
                    rows = []
        if rows:
            yield flush(rows)

    return blocks.mapInArrow(run, "shard int, seq long, doc_id long, start long, n long, crc long")


def crc32_combine(a: int, b: int, length: int) -> int:
    """The crc32 of two byte strings one after another, from theirs and the second's length."""
    if not length:
        return a

    def times(m, v):
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    m = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        m = [times(m, row) for row in m]  # one zero byte
    while length:
        if length & 1:
            a = times(m, a)
        length >>= 1
        if length:
            m = [times(m, row) for row in m]
    return a ^ b


def whole_documents(pieces: DataFrame) -> DataFrame:
    """One row per document from its pieces; a document has one piece for each block it spans."""
    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        def one(rows):
            crc = 0
            for k, r in enumerate(rows):
                crc = r["crc"] if not k else crc32_combine(crc, r["crc"], 4 * r["n"])
            return crc

        return parts.map(one)

    # within a block the seq of a continued document is that of its first row there
    grouped = pieces.groupBy("shard", "seq").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("parts"),
    )
    single = grouped.where(F.size("parts") == 1).withColumn("ids_crc32", F.col("parts")[0]["crc"])
    several = grouped.where(F.size("parts") > 1).withColumn("ids_crc32", joined("parts"))
    cols = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return single.select(cols).unionByName(several.select(cols))


def write_corpus(spark: SparkSession, docs: DataFrame, path: str, end_id: int, out: str) -> None:
    """Encode all documents into ``out``/blocks and ``out``/table."""
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tokens, kind = settle(spark, tokenised(docs, path, end_id, partitions), "tokens"), id_type(path)
    # bounded by the vocabulary, and by one row per shard
    table = count_ids(tokens, kind).orderBy("id")
    table.write.parquet(f"{out}/table")
    totals = tokens.groupBy("shard").agg(F.max(F.struct("before", (F.octet_length("ids") / np.dtype(kind).itemsize).cast("long").alias("n"))).alias("last"))
    first, at = {}, 0
    for r in totals.orderBy("shard").collect():
        first[r["shard"]], at = at, at + r["last"]["before"] + r["last"]["n"]
    encode_table(tokens, kind, read_table(spark, out), first).write.option("compression", "none").parquet(f"{out}/blocks")


def read_table(spark: SparkSession, out: str) -> np.ndarray:
    pdf = spark.read.schema("id long, n long").parquet(f"{out}/table").toPandas()
    counts = np.zeros(int(pdf["id"].max()) + 1 if len(pdf) else 1, np.int64)
    counts[pdf["id"].to_numpy()] = pdf["n"].to_numpy()
    return counts


def read_corpus(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone."""
    blocks = spark.read.schema("shard int, seq long, block binary, doc_ids array<long>").parquet(f"{out}/blocks")
    return whole_documents(decode_table(blocks, read_table(spark, out)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_corpus(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), 2, out)
    return read_corpus(spark, out)
