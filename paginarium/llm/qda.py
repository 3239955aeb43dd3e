"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Per class the mean and
covariance are summed over the labelled sample within tasks (sums of x and of x x'),
so only class sums reach the driver. Covariances shrink towards the pooled one and
then towards its diagonal; their Cholesky factors are kept, and a text's score is
the logistic of the difference of the log densities (half squared Mahalanobis
distances and log determinants) plus the log prior odds.

Defined cases: a null text is empty, and an empty text has a vector and a score like
any other; a text of any length is read whole; without labels of both classes every score
is the share of label 1 (0.5 without labels); repeated rows are scored each, and of
sample rows with one id the smallest text counts; an empty table gives no rows;
``keep_good`` returns the columns it got with their values, whatever their names
(``score`` included), and the scorer ignores other columns.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.llm.common import id_remainder, labelled_sample

#: Labelled rows the moments are taken from, at most.
SAMPLE = 20_000
THRESHOLD = 0.3
TO_POOLED, TO_DIAGONAL = 0.1, 0.05

SPACE, LETTER, UPPER, DIGIT, STOP, MARK, SYMBOL = range(7)
#: Marks of ordinary prose; other signs are symbols.
PROSE = ",;:'\"()-\u00ad\u2019\u201c\u201d"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point of the first plane; what lies beyond is a symbol."""
    out = np.full(1 << 16, SYMBOL, np.int8)
    for k in range(len(out) - 1):
        c = chr(k)
        if c.isspace():
            out[k] = SPACE
        elif c.isalpha():
            out[k] = UPPER if c.isupper() else LETTER
        elif c.isdigit():
            out[k] = DIGIT
        elif c in ".?!":
            out[k] = STOP
        elif c in PROSE:
            out[k] = MARK
    return out


def statistics(text: str) -> tuple[float, ...]:
    """The transformed statistics of one text."""
    kind = classes()[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]
    kind = np.append(np.append(np.int8(SPACE), kind), np.int8(SPACE))
    chars = len(text)
    of_kind = np.bincount(kind, minlength=7)
    space = kind == SPACE
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # of every word
    last = np.flatnonzero(~space[:-1] & space[1:])
    lengths = last - first + 1
    upper = kind == UPPER
    words = text.split()
    n, some = len(words), max(len(words), 1)
    index: dict[str, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    most = int(np.bincount(at).max()) if n else 0
    # pairs are numbered first, so that no product leaves 64 bits however long the text
    pairs = np.unique(at[:-1] * n + at[1:], return_inverse=True)[1] if n > 2 else at
    threes = len(np.unique(pairs[:-1] * n + at[2:])) if n > 2 else 0
    lines = [x for x in text.split("\n") if x.strip()]
    per = lambda k, m: float(np.log((k + 0.5) / (m + 1.0)))
    signs = int(of_kind[STOP] + of_kind[MARK] + of_kind[SYMBOL])
    return (
        float(np.log1p(n)), float(np.log1p(chars)), float(np.log1p(len(lines))),
        per(chars - int(of_kind[LETTER] + of_kind[UPPER]), chars), per(int(of_kind[DIGIT]), chars),
        per(int((upper[1:] & upper[:-1]).sum()), chars), per(signs, some),
        per(int((kind[last] == SYMBOL).sum()), some), per(int((kind[last] == STOP).sum()), some),
        float(np.log1p(lengths.mean() if n else 0.0)), float(np.log1p(lengths.std() if n else 0.0)),
        per(n - len(index), some), per(most, some), per(int((at[1:] == at[:-1]).sum()), some),
        per(max(n - 2, 0) - threes, some), per(len(lines) - len(set(lines)), max(len(lines), 1)),
        per(int(upper[first].sum()), some), per(int((lengths <= 3).sum()), some),
    )


WIDTH = len(statistics(""))


def moments(sample: DataFrame) -> DataFrame:
    """(y, n, s, q): per task and class the count, the sum and the sum of outer products."""

    def run(batches):
        import pyarrow as pa

        n, s, q = np.zeros(2), np.zeros((2, WIDTH)), np.zeros((2, WIDTH * WIDTH))
        for batch in batches:
            y = np.asarray(batch.column("y").to_pylist(), int)
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, WIDTH)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(axis=0)
                q[k] += (own.T @ own).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array(n), pa.array(s.tolist(), pa.list_(pa.float64())), pa.array(q.tolist(), pa.list_(pa.float64()))],
            names=["y", "n", "s", "q"],
        )

    return sample.select("text", "y").mapInArrow(run, "y int, n double, s array<double>, q array<double>")


class Discriminant:
    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray):
        self.share = float((n[1] + 0.5) / (n.sum() + 1))
        self.fitted = bool((n >= 2).all())
        if not self.fitted:
            return
        mean = s / n[:, None]
        cov = [q[k].reshape(WIDTH, WIDTH) / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        floor = 1e-3 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        self.mean, self.inverse, self.logdet = mean, [], []
        for c in cov:
            c = (1 - TO_POOLED) * c + TO_POOLED * pooled
            c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + floor
            factor = np.linalg.cholesky(c)
            self.inverse.append(np.linalg.inv(factor))
            self.logdet.append(2 * float(np.log(np.diag(factor)).sum()))
        self.prior = float(np.log(n[1] / n[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        d = [((x - self.mean[k]) @ self.inverse[k].T) for k in (0, 1)]
        odds = self.prior + 0.5 * ((d[0] ** 2).sum(axis=1) - (d[1] ** 2).sum(axis=1) + self.logdet[0] - self.logdet[1])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    rows = moments(labelled_sample(docs, labels, "quality", sample)).groupBy("y").agg(
        F.sum("n").alias("n"), *[F.array(*[F.sum(F.col(c)[k]) for k in range(w)]).alias(c) for c, w in (("s", WIDTH), ("q", WIDTH * WIDTH))]
    ).collect()  # two rows of class sums
    n, s, q = np.zeros(2), np.zeros((2, WIDTH)), np.zeros((2, WIDTH * WIDTH))
    for r in rows:
        n[r["y"]], s[r["y"]], q[r["y"]] = r["n"], r["s"], r["q"]
    return Discriminant(n, s, q)


def with_score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``docs`` with a column ``score``, by the whole text of each row."""
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t or "") for t in text]).reshape(-1, WIDTH)))

    return docs.withColumn("score", F.pandas_udf(score, "double")("text"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # the input's own columns in a struct, so that none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "text")
    return with_score(rows, fit(docs, labels)).where(F.col("score") >= threshold).select("own.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return with_score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", (id_remainder() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
