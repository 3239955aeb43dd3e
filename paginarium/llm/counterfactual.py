"""Toxicity classifier with a counterfactual penalty.

Features of a text are the presence of its lower-cased words and of their first four
and five characters. A bounded sample of labelled rows gives, counted within tasks
first, how often each feature occurs with either label; the ``FEATURES`` most telling
ones (and all identity terms) stay. On the same sample a logistic model is fitted.

Counterfactuals: in every sample sentence that names a group, the identity term is
swapped for another term of its set. One further sentence of every sample text, chosen
by a hash, gets a mention of a group: with one term, with another of its set, and
without. The squared difference of the scores of two such forms, weighted by
``PENALTY``, joins the loss. Mentioning a group as such then cannot carry weight,
whatever the labels of the sample suggest, and also where its texts name no group.

Defined cases: a null text is empty; an empty text scores by the intercept; a text of any
length is read whole; without labels of both classes all scores are the smoothed share of
label 1 (0.5 without labels); repeated rows are scored each, and of sample rows with one
id the smallest text counts; an empty table gives no rows; ``keep_civil`` returns the
columns it got with their values, whatever their names (``score`` included).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.llm.common import id_remainder, labelled_sample

#: Labelled rows to learn from, at most; features kept, at most.
SAMPLE = 20_000
FEATURES = 4_000
#: Sample rows in which a feature must occur.
LEAST = 6
THRESHOLD = 0.5
PENALTY, RIDGE, STEPS = 20.0, 2e-4, 400

# Sets of terms that are exchanged for each other, in the languages of the corpus.
IDENTITY_SETS = (
    ("he", "she", "they"), ("him", "her", "them"), ("his", "hers", "theirs"), ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("mothers", "fathers"), ("black", "white", "asian", "latino", "arab", "african"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"), ("immigrant", "native", "refugee"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("american", "english", "french", "german", "spanish", "mexican", "chinese", "indian", "russian", "polish", "turkish"),
    ("il", "elle"), ("ils", "elles"), ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("noirs", "blancs", "asiatiques", "arabes"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"), ("chrétien", "musulman", "juif", "hindou", "bouddhiste"), ("homosexuels", "hétérosexuels"),
    ("immigrés", "réfugiés"), ("handicapés", "sourds", "aveugles"), ("américains", "anglais", "français", "allemands", "espagnols", "chinois", "russes"),
    ("er", "sie"), ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("schwarze", "weiße", "asiaten", "araber"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"), ("schwule", "lesben"), ("einwanderer", "einheimische", "flüchtlinge"), ("behinderte", "gehörlose", "blinde"),
    ("amerikaner", "engländer", "franzosen", "deutsche", "spanier", "chinesen", "russen", "türken"),
    ("él", "ella"), ("ellos", "ellas"), ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("negros", "blancos", "asiáticos", "árabes"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"), ("homosexuales", "heterosexuales"), ("inmigrantes", "refugiados"), ("sordos", "ciegos"),
    ("estadounidenses", "ingleses", "franceses", "alemanes", "españoles", "mexicanos", "chinos", "rusos"),
)
SWAP = {t: s[(k + 1) % len(s)] for s in IDENTITY_SETS for k, t in enumerate(s)}
TERMS = sorted(SWAP)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?]+\s|\n")


def of_word(w: str) -> tuple[str, ...]:
    return ("=" + w, "4" + w[:4], "5" + w[:5]) if len(w) >= 5 else ("=" + w, "4" + w[:4]) if len(w) == 4 else ("=" + w,)


def of_words(words) -> set[str]:
    return {f for w in set(words) for f in of_word(w)}


def features(text: str) -> set[str]:
    return of_words(WORD.findall(text.lower()))


def counterfactuals(text: str) -> list[tuple[set[str], set[str]]]:
    """Features of pairs of sentences that should score alike: each sentence that names a group and
    its swapped form; and one sentence with a mention of a group, with another, and without."""
    out = []
    sentences = [w for w in (WORD.findall(x.lower()) for x in SENTENCE.split(text)) if w]
    for words in sentences:
        if not SWAP.keys().isdisjoint(words):
            out.append((of_words(words), of_words(SWAP.get(w, w) for w in words)))
    if sentences:
        seed = zlib.crc32(text.encode("utf-8", "replace"))
        words, term = sentences[seed % len(sentences)], TERMS[(seed >> 8) % len(TERMS)]
        plain, one, other = of_words(words), of_words([*words, term]), of_words([*words, SWAP[term]])
        out += [(one, other), (one, plain)]
    return out


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, neg, pos): sample rows of either label that have the feature."""

    def run(batches):
        import pyarrow as pa

        seen = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                seen[y].update(features(text))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([seen[k][f] for f in names], pa.int64()) for k in (0, 1)]], names=["feature", "neg", "pos"]
        )

    return sample.select("text", "y").mapInArrow(run, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def chosen_features(counts: DataFrame, n_neg: int, n_pos: int, limit: int = FEATURES) -> list[str]:
    """The features whose rates differ most between the labels, in standard errors."""
    rate = (F.col("neg") + F.col("pos")) / (n_neg + n_pos)
    z = F.abs(F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt((rate + 1e-4) * (1.0001 - rate))
    rows = counts.where(F.col("neg") + F.col("pos") >= LEAST).orderBy(z.desc(), "feature").limit(limit).select("feature").collect()  # at most ``limit``
    kept = [r["feature"] for r in rows]
    return kept + sorted({f for t in SWAP for f in of_word(t)} - set(kept))


def sparse_rows(sample: DataFrame, index: dict[str, int]) -> pd.DataFrame:
    """The bounded sample as feature numbers: (y, at, pairs of counterfactuals)."""

    def run(batches):
        import pyarrow as pa

        numbers = lambda found: sorted(index[f] for f in found if f in index)
        for batch in batches:
            rows = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                pairs = [numbers(a) + [-1] + numbers(b) for a, b in counterfactuals(text)]
                rows.append((y, numbers(features(text)), pairs))
            y, at, pairs = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(y, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.list_(pa.int32())))], names=["y", "at", "pairs"]
            )

    return sample.select("text", "y").mapInArrow(run, "y int, at array<int>, pairs array<array<int>>").toPandas()


def _csr(rows: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])


def train(rows: pd.DataFrame, width: int) -> np.ndarray:
    """Weights, the intercept last, by Adam over the whole sample and its counterfactuals."""
    y = rows["y"].to_numpy(float)
    order = np.lexsort([rows["at"].map(len), y])  # the same sums whatever the order of rows
    rows, y = rows.iloc[order], y[order]
    r, c = _csr(list(rows["at"]))
    left, right = [], []
    for pairs in rows["pairs"]:
        for p in pairs:
            p = list(p)
            k = p.index(-1)
            left.append(p[:k]), right.append(p[k + 1 :])
    (lr, lc), (rr, rc) = _csr(left), _csr(right)
    n, m = len(y), len(left)
    w = np.zeros(width + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    # rare labels count as much as common ones, up to a factor of 4
    weight = np.where(y > 0, min(4.0, (n - y.sum() + 1) / (y.sum() + 1)), 1.0)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(r, w[c], n) + w[-1]
        d = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        g = np.append(np.bincount(c, d[r], width), d.sum())
        g[:-1] += RIDGE * w[:-1]
        if m:
            p, q = (1 / (1 + np.exp(-np.clip(np.bincount(rows_of, w[cols], m) + w[-1], -60, 60))) for rows_of, cols in ((lr, lc), (rr, rc)))
            gap = 2 * PENALTY * (p - q) / m
            by_p, by_q = gap * p * (1 - p), gap * q * (1 - q)
            g[:-1] += np.bincount(lc, by_p[lr], width) - np.bincount(rc, by_q[rr], width)
            g[-1] += (by_p - by_q).sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.1 * (1 - step / (STEPS + 1)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return w


class Toxicity:
    def __init__(self, names: list[str], weights: np.ndarray):
        self.bias = float(weights[-1])
        self.weight = {f: float(w) for f, w in zip(names, weights)}

    def score(self, text: str) -> float:
        get = self.weight.get
        z = self.bias + sum(get(f, 0.0) for f in features(text))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    rows = labelled_sample(docs, labels, "toxic", sample)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_neg, n_pos = n.get(0, 0), n.get(1, 0)
    if not n_neg or not n_pos:
        return Toxicity([], np.array([np.log((n_pos + 0.5) / (n_neg + 0.5))]))
    names = chosen_features(feature_counts(rows), n_neg, n_pos)
    return Toxicity(names, train(sparse_rows(rows, {f: k for k, f in enumerate(names)}), len(names)))


def with_score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``docs`` with a column ``score``, by the whole text of each row."""

    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in text], dtype="float64")

    return docs.withColumn("score", F.pandas_udf(score, "double")("text"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with their own columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # the input's own columns in a struct, so that none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "text")
    return with_score(rows, fit(docs, labels)).where(F.col("score") < threshold).select("own.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return with_score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", (id_remainder() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
