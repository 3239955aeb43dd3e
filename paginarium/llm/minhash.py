"""Near-duplicates by MinHash, banded candidates and sequential Bayesian verification.

A document is the set of its three-word shingles. ``BANDS`` times ``ROWS`` random orders
of the shingles give its signature, the first shingle of each order: two sets with
Jaccard similarity s agree on an order with probability s. A band, ``ROWS`` hashes of
``LANE`` bits, is one long; documents that agree on a whole band meet in its bucket. At the
least similarity asked for, 0.85, no band agrees with probability
(1 - 0.85**5)**36, below 1e-9.

A candidate's agreements are counted batch by batch. After k hashes with m agreements
and a flat prior, similarity has the posterior Beta(m + 1, k - m + 1); a pair goes as soon
as the posterior leaves it less than ``MISS`` (1e-9) of a chance to reach 0.85. That is
the binomial sum P(Bin(k + 1, 0.85) <= m), so each batch has one least number of
agreements (``least_agreements``). Whoever is left after the last batch and may still share
enough by the parities of both sets, an exact bound, is verified on the full sets, so no pair is linked wrongly, and a link is missed with a probability of
some 4e-9 at most, the more similar the less.

Documents with the same set form one class from the start. Large groups don't multiply:
each document is first compared with the six it shares most bands with among the most central
members of its buckets, which is linear; only buckets on which more than one component is left then compare all
pairs across components. There a pair meets in the first band it agrees on and nowhere
else, and a bucket's members are dealt in blocks of ``BLOCK``, of which two at a time make
one key of the join: no key holds more than a block on either side. The first batches
are part of the join's condition.

Defined cases: a null text is empty; a text with one or two words has one shingle;
texts without words link with nothing, not even each other; a null doc_id takes part
and names a component only if no member has an id; repeated rows are documents; a text
of any length is cut whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.llm.common import forget, settle, shared_dir
from paginarium.llm.components import components, named
from paginarium.llm.tsearch import SIGNS, set_key, shingle_sets, verified
from paginarium.llm.tsearch import signature as parities

WIDTH, PERCENT = 3, 85
BANDS, ROWS, LANE = 36, 5, 12
#: Bands counted when a batch ends.
BATCHES = (12, 24, 36)
MISS = 1e-9
BLOCK = 500
#: Heads that a document is compared with before pairs across components are.
HEADS = 6
#: Shingles multiplied at a time.
AT_ONCE = 1024

_ODD = np.random.default_rng(2024).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ONES = sum(1 << LANE * k for k in range(ROWS))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The bands of a set: of each order's first shingle ``LANE`` bits, ``ROWS`` of them in a long."""
    first = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), AT_ONCE):
        np.minimum(first, (_ODD * shingles[at : at + AT_ONCE]).min(axis=1), out=first)
    lanes = (first >> np.uint64(20) & np.uint64((1 << LANE) - 1)).reshape(BANDS, ROWS)
    return (lanes << (np.arange(ROWS, dtype=np.uint64) * np.uint64(LANE))).sum(axis=1).view(np.int64)


def least_agreements(k: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The least number of agreements among ``k`` that leaves at least ``miss`` of a chance to be similar enough."""
    s, below = percent / 100, 0.0
    for m in range(k + 1):
        below += math.comb(k + 1, m) * s**m * (1 - s) ** (k + 1 - m)
        if below >= miss:
            return m
    return k


def agreements(a: Column, b: Column) -> Column:
    """On how many of their ``ROWS`` hashes two bands agree: lanes of the difference that are zero."""
    lane = _ONES * ((1 << LANE - 1) - 1)  # all bits of a lane but its highest
    differ = a.bitwiseXOR(b)
    some = (differ.bitwiseAND(F.lit(lane)) + F.lit(lane)).bitwiseOR(differ).bitwiseAND(F.lit(_ONES << LANE - 1))
    return F.lit(ROWS) - F.bit_count(some)


def likely(a: Column, b: Column) -> Column:
    """Whether a pair of signatures passes every batch, in turn."""
    found, agreed, done = F.lit(True), F.lit(0), 0
    for end in BATCHES:
        agreed = sum((agreements(a[k], b[k]) for k in range(done, end)), agreed)
        found, done = found & (agreed >= least_agreements(end * ROWS)), end
    return found


def similar_sizes(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def may_share_enough(x: Column, y: Column, xn: Column, yn: Column) -> Column:
    """Whether the parities of two sets (in each of 512 classes of hashes an odd number or not) leave them
    the overlap they need: no more parities differ than shingles are in one set only."""
    differing = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, SIGNS)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return differing <= xn + yn - 2 * F.ceil(PERCENT * (xn + yn) / (100 + PERCENT))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, sign, odd): set size, digest of the set, ``signature``, parities."""

    def run(batches):
        for batch in batches:
            ids, sets = batch.column(0), shingle_sets(batch.column(1), WIDTH)
            for at in range(0, len(ids), 500):
                n, key, sign, odd = zip(*((len(s), set_key(s), signature(s), parities(s)) for s in islice(sets, 500)))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(n) + 1, k), pa.int32()), pa.array(np.concatenate(x))) for x, k in ((sign, BANDS), (odd, SIGNS))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 500).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), *lists], names=["doc_id", "n", "key", "sign", "odd"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, sign array<long>, odd array<long>")


def with_signs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    own = lambda k, s: classes.select(F.col("rid").alias(k), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "sign", "odd")])
    return pairs.join(own("a", "x"), "a").join(own("b", "y"), "b")


def to_heads(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of members with heads of their buckets, the two most central ones of each.

    Of all heads that a document meets, the ``HEADS`` that it meets most often are compared with it,
    so there are at most so many pairs a document; what they don't join is left to ``across``.
    """
    member = F.struct("weight", (-F.col("rid")).alias("last"), "n")
    bucket = ["band", "value"]
    one = buckets.groupBy(*bucket).agg(F.max(member).alias("one"))
    marked = buckets.join(one, bucket)
    two = marked.where("rid <> -one.last").groupBy(*bucket).agg(F.max(member).alias("two"))
    met = marked.join(two, bucket).select("rid", "n", F.explode(F.array("one", "two")).alias("o")).where("-o.last <> rid").where(similar_sizes(F.col("o.n"), F.col("n")))
    often = met.groupBy("rid", (-F.col("o.last")).alias("head")).agg(F.count(F.lit(1)).alias("hits"), F.first("o.weight").alias("weight"))
    best = often.groupBy("rid").agg(F.slice(F.sort_array(F.collect_list(F.struct("hits", "weight", "head")), asc=False), 1, HEADS).alias("best"))  # at most two a band
    pairs = best.select("rid", F.explode("best.head").alias("head")).select(F.least("head", "rid").alias("a"), F.greatest("head", "rid").alias("b")).distinct()
    return with_signs(pairs, classes).where(likely(F.col("x_sign"), F.col("y_sign")) & may_share_enough(*map(F.col, ("x_odd", "y_odd", "x_n", "y_n")))).select("a", "b")


def across(buckets: DataFrame, joined: DataFrame, classes: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of documents of one bucket that are in different components, each pair once."""
    bucket = ["band", "value"]
    placed = buckets.select(*bucket, "rid", "n").join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("c", F.coalesce("component", "rid")).drop("component")
    mixed = placed.groupBy(*bucket).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select(*bucket, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(mixed, bucket).join(classes.select("rid", "sign", "odd"), "rid").withColumn("own", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    # a pair of blocks (i, j), i <= j, is one key: a block is on the left of all later ones, on the right of all earlier
    named_as = lambda s: [F.col(k).alias(f"{s}_{k}") for k in ("rid", "n", "c", "sign", "odd")]
    left = rows.select(*bucket, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *named_as("a"))
    right = rows.select(*bucket, F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *named_as("b"))
    x, y = F.col("a_sign"), F.col("b_sign")
    first_met = reduce(lambda so_far, k: so_far & ((F.col("band") <= k) | (x[k] != y[k])), range(BANDS - 1), F.lit(True))
    condition = (
        (F.col("a_c") != F.col("b_c")) & ((F.col("i") < F.col("j")) | (F.col("a_rid") < F.col("b_rid")))
        & similar_sizes(F.col("a_n"), F.col("b_n")) & first_met & likely(x, y) & may_share_enough(*map(F.col, ("a_odd", "b_odd", "a_n", "b_n")))
    )
    return left.join(right, [*bucket, "i", "j"]).where(condition).select(F.least("a_rid", "b_rid").alias("a"), F.greatest("a_rid", "b_rid").alias("b"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document, repeated rows included."""
    base = shared_dir(spark)
    facts = settle(spark, described(docs).withColumn("row", F.monotonically_increasing_id()), path=f"{base}/facts")
    some = facts.where("n > 0").groupBy("key")
    classes = settle(spark, some.agg(F.min("row").alias("rid"), F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("sign").alias("sign"), F.first("odd").alias("odd")), path=f"{base}/classes")
    bands = classes.select("rid", "n", F.posexplode("sign").alias("band", "value"))
    sizes = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = settle(spark, bands.join(sizes, ["band", "value"]), path=f"{base}/shared")
    # who shares its bands with many is likely to be like them
    central = shared.groupBy("rid").agg(F.sum("size").alias("weight"))
    buckets = settle(spark, shared.drop("size").join(central, "rid"), path=f"{base}/buckets")
    forget(spark, [f"{base}/shared"])

    links = settle(spark, verified(spark, docs, classes, to_heads(buckets, classes), f"{base}/pairs0", WIDTH, PERCENT), path=f"{base}/links0")
    joined = components(spark, links)
    forget(spark, [f"{base}/pairs0"])
    more = settle(spark, links.union(verified(spark, docs, classes, across(buckets, joined, classes), f"{base}/pairs1", WIDTH, PERCENT)), path=f"{base}/links1")
    forget(spark, [f"{base}/buckets", f"{base}/pairs1", f"{base}/links0"])
    by_key = named(classes, components(spark, more))
    component = F.coalesce("component_id", "doc_id")
    return facts.select("doc_id", "n", "key").join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
