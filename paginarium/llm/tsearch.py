"""Set-similarity join on word shingles by T-occurrence search with DivideSkip.

A document is the set of its five-word shingles (64-bit hashes; two different
shingles of one comparison coincide with probability below 2**-40 even for sets of a
thousand). Documents with the same set form one class from the start.

Two sets with Jaccard similarity of at least 4/5 share at least T = ceil(4n/5)
shingles of either, and ceil(4/9 of both sizes) in fact. DivideSkip divides a set's
inverted lists into short and long ones: lists are ordered rarest first, the
n - T + L first are merged, and whoever occurs on too few of them (``enough``) can't
reach the overlap. The survivors are probed for the remaining, long lists by binary
search in their sorted sets. The merge is
Spark's: postings of the short lists are sorted by shingle and counted by pair.

The order is by corpus frequency for the ``HOT`` most frequent shingles, which come
last, and by hash for the rest; any order gives the same result, this one keeps
boilerplate out of the merged lists.

Large groups of near copies don't multiply: first each posting is compared with its
list's two most central documents only, which is linear; pairs already
joined by those links need no comparison, the others are all enumerated, but for those
whose signatures differ in more places than similar sets can.

Defined cases: a null text is empty; a text with one to four words has one shingle;
texts without words link with nothing, not even each other; a null doc_id takes part
and names a component only if no member has an id; repeated rows are documents; a text
of any length is cut whole, long ones in a slice of their own; an empty table gives no
rows; ``near_duplicates`` ignores other columns, ``one_of_each`` carries them in a struct,
so no name can clash. Of tied documents (equal smallest id in a component) the one with
the smallest text hash stays, and of rows equal in id and text the one whose row has the
smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paginarium.llm.common import forget, settle, shared_dir
from paginarium.llm.components import components, named

WIDTH = 5
HOT = 1 << 17
#: Occurrences on the merged lists asked of a candidate.
HITS = 3
#: A shingle is reported by a task if so many of the task's documents have it.
LOCAL = 2
#: Text cut into words at a time, in bytes (a longer text is a slice by itself).
SLICE_BYTES = 1_500_000
FILTER_BITS = 1 << 24
#: Keys a task remembers to have sent.
SEEN = 500_000
#: Longs of a signature (a power of two).
SIGNS = 8
#: Linear rounds before the pairs across components.
STARS = 1
#: Members of a list, or pairs of a set, that one key holds while they are joined.
SALTED = 1000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(s: np.ndarray) -> np.ndarray:
    s = s ^ (s >> np.uint64(30))
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(27)
    s *= np.uint64(0x94D049BB133111EB)
    return s ^ (s >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of every text's shingles of ``width`` words (at most five); null counts as empty.

    Words stand between ASCII white space, A-Z in lower case. Arrow cuts a slice of
    the texts into words and numbers them, and each distinct word is hashed once.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(at, end - at), "")))
        words = split.flatten()
        parent = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # a text's outer white space leaves empty words
        coded = words.dictionary_encode()
        hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
        h = hashes[coded.indices.to_numpy(zero_copy_only=False)][full]
        counts = np.bincount(parent[full], minlength=end - at)
        n = len(h) - width + 1
        s = _mixed(sum((h[k : n + k] * _FACTORS[k] for k in range(1, width)), h[:n] * _FACTORS[0])) if n > 0 else h[:0]
        first = np.cumsum(counts) - counts
        for begin, size in zip(first.tolist(), counts.tolist()):
            if size >= width:
                yield np.unique(s[begin : begin + size - width + 1])
            elif size:  # the whole sequence, apart from all full shingles by its length
                yield _mixed((h[begin : begin + size] * _FACTORS[:size]).sum(keepdims=True) + np.array([size], np.uint64) * np.uint64(0xD1B54A32D192ED03))
            else:
                yield np.zeros(0, np.uint64)
        at = end
    pa.default_memory_pool().release_unused()  # workers are kept for later stages, what a batch took needn't be


def set_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def signature(shingles: np.ndarray) -> np.ndarray:
    """Of each of 64 * ``SIGNS`` classes of hashes whether the set has an odd number, as bits of longs.

    In two sets' signatures no more bits differ than shingles are in one set only.
    """
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (64 * SIGNS - 1), minlength=64 * SIGNS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_be_similar(a: str, b: str, an: str, bn: str) -> F.Column:
    """Whether the signatures leave two sets the overlap they need."""
    differing = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, SIGNS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
    return differing <= F.col(an) + F.col(bn) - 2 * needed(an, bn)


def least_overlap(n: int) -> int:
    return (4 * n + 4) // 5


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles (sorted by hash), each with its rank from the least frequent."""

    def run(batches):
        held, size = [], 0

        def report():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found, n = found[n >= LOCAL], n[n >= LOCAL]
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for found in shingle_sets(batch.column(0)):
                held.append(found)
                size += len(held[-1])
                if size > 500_000:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "h").limit(HOT).select("h").toPandas()["h"].to_numpy(np.int64)  # at most HOT
    h = rows.view(np.uint64)
    order = np.argsort(h)
    return np.stack([h[order], (len(h) - order).astype(np.uint64)])


def described(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, n, key, short, signs): set size, digest of the set, the shingles whose lists are merged, ``signature``."""

    def run(batches):
        for batch in batches:
            ids, texts, hashes = batch.column(0), batch.column(1), batch.column(2)
            sets = shingle_sets(texts)
            for at in range(0, len(ids), 500):
                rows = []
                for s in islice(sets, 500):
                    n = len(s)
                    rank = np.zeros(n, np.uint64)
                    if hot.shape[1] and n:
                        k = np.minimum(np.searchsorted(hot[0], s), hot.shape[1] - 1)
                        rank = np.where(hot[0][k] == s, hot[1][k], rank)
                    t = least_overlap(n)
                    short = s[np.lexsort((s, rank))][: n - t + min(HITS, t)]
                    rows.append((n, set_key(s), short.view(np.int64), signature(s)))
                n, key, short, signs = zip(*rows)
                lengths = np.fromiter(map(len, short), np.int64, len(short))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, 500).cast(pa.int64()), hashes.slice(at, 500), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(np.concatenate(short))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, SIGNS * len(signs) + 1, SIGNS), pa.int32()), pa.array(np.concatenate(signs))),
                    ],
                    names=["doc_id", "text_hash", "n", "key", "short", "signs"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, key binary, short array<long>, signs array<long>")


def key_bit(key) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, shingles) of the wanted keys, and maybe a few others, recomputed from the texts.

    A bit filter of fixed size, built from the wanted keys, keeps most other sets from
    being shuffled; the joins with the pairs make it exact.
    """
    bits = wanted.select(key_bit("key").alias("bit"))
    rows = bits.select(F.expr("cast(bit div 32 as int)").alias("at"), F.expr("shiftleft(1L, cast(bit % 32 as int))").alias("m"))
    found = rows.groupBy("at").agg(F.bit_or("m").alias("m")).toPandas()  # at most FILTER_BITS / 32 rows
    mask = np.zeros(FILTER_BITS // 32, np.int64)
    mask[found["at"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64)
    packed = mask.astype(np.uint32)

    def run(batches):
        seen: set[bytes] = set()  # of this task, so that a set with many copies is mostly sent once
        for batch in batches:
            keys, sets, size = [], [], 0
            for s in shingle_sets(batch.column(0), width):
                key = set_key(s)
                if len(s) and key not in seen and packed[(bit := _spark_bit(key)) >> 5] >> (bit & 31) & 1:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    keys.append(key), sets.append(s.tobytes())
                    size += len(s)
                    if size > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])
                        keys, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))


def _spark_bit(key: bytes) -> int:
    """What ``key_bit`` gives: xxhash64 with Spark's seed."""
    import xxhash

    h = xxhash.xxh64_intdigest(key, seed=42)
    return h % FILTER_BITS  # FILTER_BITS divides 2**64, so signed and unsigned agree


def with_sets(rows: DataFrame, pairs: DataFrame, sets: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the set of ``key`` as ``name``. A set in many pairs is dealt over several keys, and so are its pairs."""
    sizes = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    dealt = rows.join(sizes, key).withColumn("salt", F.pmod(F.xxhash64("a", "b"), salted()).cast("int")).drop("size")
    each = sets.select(F.col("key").alias(key), F.col("shingles").alias(name)).join(sizes, key)
    return dealt.join(each.select(key, F.explode(F.sequence(F.lit(0), salted() - 1)).alias("salt"), name), [key, "salt"]).drop("salt")


def verified(spark: SparkSession, docs: DataFrame, classes: DataFrame, pairs: DataFrame, path: str, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """Those pairs (a, b) of classes that are similar to at least ``percent``, by probing one set in the other. All pairs are written to ``path`` first."""

    def flat_sets(column) -> tuple[np.ndarray, np.ndarray]:
        """All sets of a batch in one array as it lies in the batch, and where each begins."""
        return np.frombuffer(column.buffers()[2] or b"", np.uint64), np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8

    def run(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            (all_x, at_x), (all_y, at_y) = flat_sets(batch.column("x")), flat_sets(batch.column("y"))
            for k in range(len(batch)):
                x, y = all_x[at_x[k] : at_x[k + 1]], all_y[at_y[k] : at_y[k + 1]]
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    names = classes.select("rid", "key")
    keyed = pairs.select("a", "b").distinct().join(names.select(F.col("rid").alias("a"), F.col("key").alias("ka")), "a")
    keyed = settle(spark, keyed.join(names.select(F.col("rid").alias("b"), F.col("key").alias("kb")), "b"), path=path)
    if keyed.isEmpty():
        return keyed.select("a", "b")
    sets = sets_of(docs, keyed.select(F.col("ka").alias("key")).union(keyed.select("kb")), width)
    both = with_sets(with_sets(keyed, keyed, sets, "ka", "x"), keyed, sets, "kb", "y")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def needed(a: str, b: str) -> F.Column:
    """The overlap that sets of two sizes must have: ceil(4/9 of their sum)."""
    return F.floor((4 * (F.col(a) + F.col(b)) + 8) / 9)


def enough(hits: F.Column) -> F.Column:
    """Whether a pair's occurrences on the merged lists leave it a chance.

    Of two sets the one whose merged part ends first in the global order has all its
    common shingles of that part counted; the rest of it, T - L shingles, may all be
    common. So a similar pair has at least needed - T + L hits, for one of its sides.
    """
    least = lambda c: F.floor((4 * F.col(c) + 4) / 5)
    side = lambda c: needed("an", "bn") - least(c) + F.least(F.lit(HITS), least(c))
    return hits >= F.least(side("an"), side("bn"))


def in_place(a: str, b: str, an: str, bn: str) -> F.Column:
    """Whether two sets that meet at these places of theirs can share enough before and after them."""
    a, b, an, bn = (F.col(c) for c in (a, b, an, bn))
    return F.least(a, b) + 1 + F.least(an - a, bn - b) - 1 >= F.floor((4 * (an + bn) + 8) / 9)


def similar_sizes(a: str, b: str) -> F.Column:
    return 100 * F.least(a, b) >= 80 * F.greatest(a, b)


def salted(size: str = "size") -> F.Column:
    """Into how many parts a list of that size is dealt."""
    return F.ceil(F.col(size) / SALTED).cast("int")


def salted_count() -> F.Column:
    return F.ceil(F.count(F.lit(1)) / SALTED).cast("int")


def with_components(lists: DataFrame, joined: DataFrame | None) -> DataFrame:
    """The lists on which more than one component is left, with each member's component ``c``."""
    placed = lists.withColumn("c", F.col("rid"))
    if joined is None:
        return placed  # every list has two members at least
    placed = lists.join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("c", F.coalesce("component", "rid")).drop("component")
    mixed = placed.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    return placed.join(mixed, "h", "left_semi")


def to_heads(lists: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of each list's members with two heads: its most central member, and
    the most central one outside that member's component. Linear in the postings; a long
    list is dealt over several keys, each of which gets the heads."""
    member = F.struct("weight", (-F.col("rid")).alias("last"), "n", "c", "at", "size")
    salt = F.pmod(F.xxhash64("rid"), salted()).cast("int").alias("salt")
    dealt = lists.select("h", salt, "rid", "n", "c", "at", "size", "weight")

    def heads(rows: DataFrame, name: str) -> DataFrame:
        found = rows.groupBy("h").agg(F.max(member).alias(name))
        return found.select("h", F.explode(F.sequence(F.lit(0), salted(f"{name}.size") - 1)).alias("salt"), name)

    marked = dealt.join(heads(dealt, "one"), ["h", "salt"])
    marked = marked.join(heads(marked.where("c <> one.c"), "two"), ["h", "salt"], "left")
    pairs = marked.select(F.explode(F.array("one", "two")).alias("o"), "rid", "n", "c", "at").where("o IS NOT NULL AND -o.last <> rid AND o.c <> c").where(similar_sizes("o.n", "n") & in_place("o.at", "at", "o.n", "n"))
    head = -F.col("o.last")
    counted = (
        pairs.select(F.least(head, "rid").alias("a"), F.greatest(head, "rid").alias("b"), F.least("o.n", "n").alias("an"), F.greatest("o.n", "n").alias("bn"))
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.first("an").alias("an"), F.first("bn").alias("bn"))
    )
    return counted.where(enough(F.col("hits"))).select("a", "b")


def across(mixed: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) across components, of all members of each list.

    A list is dealt in blocks of ``SALTED`` members; two blocks (i, j), i <= j, are a key
    of the join: a block stands on the left of itself and all later ones, on the right of
    itself and all earlier. So no key holds more than a block on either side.
    """
    counts = mixed.groupBy("h").agg(salted_count().alias("blocks"))
    rows = mixed.join(counts, "h").withColumn("own", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    side = lambda s: [F.col(k).alias(f"{s}{k}") for k in ("rid", "n", "c", "at", "before", "after", "signs")]
    left = rows.select("h", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *side("a"))
    right = rows.select("h", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *side("b"))
    most = F.least("abefore", "bbefore") + 1 + F.least("aafter", "bafter")
    once = (F.col("i") < F.col("j")) | (F.col("arid") < F.col("brid"))
    met = left.join(right, ["h", "i", "j"]).where(
        once & (F.col("ac") != F.col("bc")) & enough(most) & similar_sizes("an", "bn") & in_place("aat", "bat", "an", "bn") & may_be_similar("asigns", "bsigns", "an", "bn")
    )
    pair = [F.least("arid", "brid").alias("a"), F.greatest("arid", "brid").alias("b")]
    sizes = [F.first(F.when(F.col("arid") < F.col("brid"), F.col(x)).otherwise(F.col(y))).alias(x) for x, y in (("an", "bn"), ("bn", "an"))]
    return met.groupBy(*pair).agg(F.count(F.lit(1)).alias("hits"), *sizes).where(enough(F.col("hits"))).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, component) for every document, repeated rows included.

    ``component`` numbers the components of documents with words (null without words),
    also where no member has an id.
    """
    hot, base = hot_shingles(docs), shared_dir(spark)
    facts = settle(spark, described(docs, hot).withColumn("row", F.monotonically_increasing_id()), "facts")
    some = facts.where("n > 0").groupBy("key")
    classes = settle(spark, some.agg(F.min("row").alias("rid"), F.min("doc_id").alias("first_doc"), F.first("signs").alias("signs")), "classes")
    postings = some.agg(F.min("row").alias("rid"), F.first("n").alias("n"), F.first("short").alias("short")).select(F.posexplode("short").alias("at", "h"), "rid", "n")
    sizes = postings.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = settle(spark, postings.join(sizes, "h"), path=f"{base}/shared")
    # a member that shares most of what it has is the likeliest to be like the others
    central = shared.groupBy("rid").agg((F.sum("size") / F.first("n")).alias("weight"))
    lists = settle(spark, shared.join(central, "rid"), path=f"{base}/lists")
    forget(spark, [f"{base}/shared"])

    links, joined = None, None
    for turn in range(STARS):
        found = settle(spark, verified(spark, docs, classes, to_heads(with_components(lists, joined)), f"{base}/pairs{turn}"), "links")
        forget(spark, [f"{base}/pairs{turn}"])
        links = found if links is None else settle(spark, links.union(found), "links")
        joined = components(spark, links)

    # lists on which more than one component is left: all pairs across components
    # (no pair meets on more lists, before and after one, than either of its documents has left there)
    own = Window.partitionBy("rid")
    left_over = with_components(lists, joined).withColumn("after", F.count(F.lit(1)).over(own))
    left_over = left_over.withColumn("before", F.row_number().over(own.orderBy("at")) - 1).withColumn("after", F.col("after") - F.col("before") - 1)
    left_over = left_over.join(classes.select("rid", "signs"), "rid")
    mixed = settle(spark, left_over.select("h", "rid", "n", "c", "at", "before", "after", "signs"), path=f"{base}/mixed")
    forget(spark, [f"{base}/lists"])
    second = settle(spark, links.union(verified(spark, docs, classes, across(mixed), f"{base}/pairs")), "links")
    forget(spark, [f"{base}/mixed", f"{base}/pairs"])
    final = components(spark, second)

    by_key = named(classes, final)
    return (
        facts.select("doc_id", "n", "key", "text_hash").join(by_key, "key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "component")
    )


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component (its smallest id), and every document without words; own columns.

    Of rows that agree in id and text one stays. The texts are shuffled once, by id and
    text hash, for both the choice among such rows and the join with what is kept.
    """
    found = near_duplicates(spark, docs).where(F.col("component").isNotNull())
    no_id = F.col("doc_id").isNull()
    kept = found.groupBy("component").agg(F.min(F.struct(no_id.alias("k1"), F.coalesce("doc_id", F.lit(0)).alias("k2"), F.col("text_hash").alias("k3"))).alias("k"))
    keys = ["k1", "k2", "k3"]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select(
        own, no_id.alias("k1"), F.coalesce("doc_id", F.lit(0)).alias("k2"), F.xxhash64("text").alias("k3"),
        F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)).alias("has_words"),
    )
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("own"))
    first = rows.where("has_words").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    chosen = first.join(kept.select("k.*").distinct(), keys, "left_semi")
    return chosen.select("own.*").union(rows.where(~F.col("has_words")).select("own.*"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "component")
