"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are cut into integer components. Candidates and queries are dealt into
blocks of bounded size. A task takes one block of queries and, one after another, the
blocks of candidates of its lane, so that each query's kth score so far goes along and
ends later blocks sooner.

Within a block the candidates stand in one sorted list per principal axis of all
vectors. A few queries walk together: each reads the lists from the end its component's
sign favours, deeper where the component weighs more; whoever is met in any list is
scored for all of the group, in integers. A query stops when the inner product of its
list heads can't beat its kth score, or when nobody is left unmet. There is no other
end and no other path. How early that is depends on the vectors: where a few axes
carry most of their spread, after a small part; on vectors that fill all dimensions
evenly, the bound stays above the kth score until all are met.

Defined cases: vectors that are null, empty or hold null or non-finite components take
no part; vectors of unequal length count as padded with zeros; rows with an equal
vec_id are separate candidates, and a query leaves out all rows of its own id;
repeated query rows give repeated results; an empty table gives no rows; other columns
are ignored, whatever their names. Components are exact as long as every inner product
stays below 2**53.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = 64
#: Candidates of a block; queries of a block, at least and at most.
CANDIDATES, QUERIES = 8192, (512, 65_536)
#: Queries that walk together, and entries read first of the list that weighs most.
TOGETHER, FIRST_STEP, LEVELS = 16, 64, 4
#: Wider vectors keep their own axes.
WIDEST_ROTATED = 512


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id; minus infinity never counts."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > -np.inf]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Top:
    """The k best of one query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    @property
    def kth(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.kth)
        if len(some):
            scores, ids = np.append(self.scores, scores[some].astype(float)), np.append(self.ids, ids[some])
            at = best(scores, ids, self.k)
            self.scores, self.ids = scores[at], ids[at]


class Lists:
    """One block of candidates: vectors, ids, and a sorted list per axis."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, axes: np.ndarray):
        self.ids, self.axes = ids, axes
        self.vectors = vectors
        self.most = float(np.abs(vectors).max(initial=0))
        turned = np.ascontiguousarray((vectors @ axes).T)
        order = np.argsort(turned, axis=1, kind="stable")  # ascending
        self.sorted = np.take_along_axis(turned, order, axis=1)
        self.order = np.ascontiguousarray(order.T.astype(np.int32))  # an entry of all lists a row
        self.spread = turned.std(axis=1) + 1e-9
        self.small = vectors.astype(np.float32)
        self.read = self.scored = 0  # list entries, and scores

    def walk(self, queries: np.ndarray, owns: np.ndarray, tops: list[Top]) -> None:
        """Add the block's candidates to the queries' best, as far as they may belong there."""
        n = len(self.ids)
        exact = self.most * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 1 << 24
        vectors, q = (self.small, queries.astype(np.float32)) if exact else (self.vectors, queries)
        turned = queries @ self.axes
        weight = np.abs(turned) * self.spread
        most = weight.max(axis=1, keepdims=True)
        share = np.where(most > 0, weight / np.maximum(most, 1e-300), 1.0)
        # lists are read to 1, 1/2, ... 1/2**LEVELS of the step, those of less weight not at all
        level = np.ceil(-np.log2(np.maximum(share, 1e-300))).astype(np.int64)
        up, axis, at_level = turned > 0, np.arange(turned.shape[1]), range(LEVELS + 1)
        dims = [[[np.flatnonzero((level[j] == v) & (up[j] == way)) for way in (False, True)] for v in at_level] for j in range(len(queries))]
        places = [np.flatnonzero(self.ids == own) for own in owns]
        met, scored = np.zeros(n, bool), np.zeros(n, bool)
        live, step, before = np.arange(len(queries)), FIRST_STEP, 0
        while len(live):
            for v in at_level:
                a, b = min(n, before >> v), min(n, step >> v)
                for j in live:
                    low, high = dims[j][v]
                    met[self.order[a:b].take(low, axis=1)] = True
                    met[self.order[n - b : n - a].take(high, axis=1)] = True
                    self.read += (b - a) * (len(low) + len(high))
            new = np.flatnonzero(met & ~scored)
            scored[new] = True
            found = q[live] @ vectors[new].T
            self.scored += found.size
            all_met, new_ids = bool(scored.all()), self.ids[new]
            depth = np.minimum(np.where(level <= LEVELS, step >> np.minimum(level, LEVELS), 0), n - 1)
            going = []
            for row, j in zip(found, live):
                for own in places[j]:
                    row[new == own] = -np.inf
                tops[j].add(row, new_ids)
                if not all_met:
                    parts = self.sorted[axis, np.where(up[j], n - 1 - depth[j], depth[j])] * turned[j]
                    if parts.sum() + 1e-6 * (1 + np.abs(parts).sum()) >= tops[j].kth:
                        going.append(j)
            live, before, step = np.array(going, np.int64), step, step * 2


def whole_components(vector: str | Column, scale: int = SCALE) -> Column:
    col = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(col, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def sound(vector: str | Column) -> Column:
    col = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return col.isNotNull() & (F.size(col) > 0) & F.forall(col, finite)


def matrix(vectors, width: int) -> np.ndarray:
    """An Arrow list column as rows padded with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """The eigenvectors of the covariance of ``v``, from sums within tasks; unit axes for very wide vectors."""
    if width > WIDEST_ROTATED:
        return np.eye(width)

    def run(batches):
        import pyarrow as pa

        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), matrix(batch.column(0), width)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

    sums = rows.select("v").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).toPandas()  # (width + 1)**2 rows
    total = np.zeros((width + 1) ** 2)
    total[sums["k"].to_numpy(np.int64)] = sums["s"].to_numpy(float)
    total = total.reshape(width + 1, width + 1)
    mean = total[0, 1:] / max(total[0, 0], 1)
    covariance = total[1:, 1:] / max(total[0, 0], 1) - np.outer(mean, mean)
    return np.linalg.eigh(covariance)[1] if np.isfinite(covariance).all() else np.eye(width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) from a table of (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.where(sound("embedding") & F.col("vec_id").isNotNull()).select(
        "vec_id", whole_components("embedding").alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row")
    )
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("m"), F.max(F.size("v")).alias("d")).first()
    width, tasks = sizes["d"] or 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    n_blocks = max(1, -(-sizes["n"] // CANDIDATES))
    # large blocks of queries, so that candidates are sent few times, but one for each task at least
    n_queries = max(1, -(-sizes["m"] // min(max(QUERIES[0], sizes["m"] // tasks), QUERIES[1])))
    lanes = max(1, min(n_blocks, tasks // n_queries))
    axes = principal_axes(rows, width)
    # salted by the row, so that repeated ids spread
    block = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")
    packed = F.collect_list(F.struct("vec_id", "row", "v")).alias("members")
    candidates = (
        rows.groupBy(block(n_blocks).alias("cb")).agg(packed)
        .select(F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), (F.col("cb") % lanes).alias("lane"), "cb", "members")
    )
    queries = (
        rows.where("q").groupBy(block(n_queries).alias("qb")).agg(packed)
        .select("qb", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).alias("cb"), "members")
    )
    # in each task a block of queries comes first, then its candidates
    stream = candidates.unionByName(queries).repartition(n_queries * lanes, "qb", "lane").sortWithinPartitions("qb", "lane", "cb")

    def run(batches):
        import pyarrow as pa

        at, q, owns, own_rows, tops = None, None, None, None, []

        def report():
            counts = [len(t.ids) for t in tops]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(own_rows, counts)), pa.array(np.repeat(owns, counts)),
                    pa.array(np.concatenate([t.ids for t in tops])), pa.array(np.concatenate([t.scores for t in tops]).astype(np.int64)),
                ],
                names=["row", "query_id", "vec_id", "score"],
            )

        for batch in batches:
            for r in range(len(batch)):
                key, cb = (batch.column("qb")[r].as_py(), batch.column("lane")[r].as_py()), batch.column("cb")[r].as_py()
                members = batch.column("members")[r].values
                ids, vectors = members.field("vec_id").to_numpy(), matrix(members.field("v"), width)
                if cb < 0:
                    if tops:
                        yield report()
                    at, q, owns, own_rows = key, vectors, ids, members.field("row").to_numpy()
                    tops = [Top(k) for _ in ids]
                elif key == at:  # else no query has this block
                    lists = Lists(vectors, ids, axes)
                    for low in range(0, len(q), TOGETHER):
                        lists.walk(q[low : low + TOGETHER], owns[low : low + TOGETHER], tops[low : low + TOGETHER])
        if tops:
            yield report()

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        stream.mapInArrow(run, "row long, query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
