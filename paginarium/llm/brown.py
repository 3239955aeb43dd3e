"""Brown class-based n-gram model: exchange clustering, class bigrams, word emissions.

    P(w | v) = P(unseen) * [w unseen]
             + (1 - P(unseen)) * P(class w | class v) * P(w | class w)

Words that never occur in training count as one further word, with probability
V / 2N (half of each known word's first count is set aside for it). Class bigrams are
interpolated with the class unigram (Witten-Bell). The end of a text is a token with a
class of its own, and is what precedes the first word.

Passes over the texts:

1. every text belongs to the ``slice`` its task read; a slice numbers its words, and from
   then on its texts are rows of those numbers (a written table). Words are dealt over
   buckets by crc32; a bucket numbers its words over all slices and counts them exactly;
2. bigrams among the ``CORE`` most frequent words are counted (a table of fixed size) and
   the exchange algorithm on the driver moves each word to the class that most raises the
   average mutual information of neighbouring classes until none moves. This only starts
   the classes;
3. exchange rounds over all words: slices count per word the classes left and right of it,
   the buckets add these up over all slices and give each word the class in which it most
   raises the average mutual information, its own counts taken out of the old class. In
   the first round all words outside the core get a class (those without a neighbour in
   the core are dealt over the classes, as the driver's start does), afterwards half of
   all words may move in a round, so that neighbours don't change places together. The
   classes of the round with the greatest average mutual information are kept;
4. the classes go back to the slices, where all texts are scored with their slice's words
   alone. Corpus totals come from the same rows.

A bucket's counts of a slice are one row of packed arrays, so frequent words are no hot
keys. The vocabulary is never broadcast or collected; what moves grows with the words of
the slices.

Defined cases: a null text is empty and has the end token alone; a null doc_id is
never held out; repeated rows are scored each and count each; without training rows
every word is unseen and scores like the base model; a text of any length is read whole,
a very long one as a slice by itself; a word that fits two classes equally well stays in
its class, or takes the one with the smaller number; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.llm.common import forget, id_remainder, settle, shared_dir

CORE, CLASSES = 1000, 24
#: A slice is what one task reads; beyond this much text it is cut (a longer text is a slice by itself).
SLICE_BYTES = 24_000_000
ROUNDS = 12
#: Rounds over all words: the first gives every word a class, then the halves take turns,
#: until two turns raise the average mutual information by less than ``SETTLED`` or this many are done.
ALL_ROUNDS, SETTLED = 12, 0.01
#: Entries of a bucket's counts whose gains are worked out together.
ENTRIES_AT_ONCE = 100_000
END = b"\n"  # no word contains white space


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case, then the end token."""
    return [*(text or "").encode().lower().split(), END]


def packed(arrays, kind) -> list[bytes]:
    return [np.ascontiguousarray(a, kind).tobytes() for a in arrays]


def unpacked(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def numbered(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts as numbers of their slice's words, and those words by bucket. ``docs``: (doc_id, held_out, text).

    Text rows: (slice, doc_id, held_out, ids); word rows have ``bucket`` set: (slice,
    bucket, low, words, n), where the words' numbers go up from ``low`` and ``n`` counts
    training tokens.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 20
        index: dict[bytes, int] = {}
        kept: list[tuple] = []
        names = ["slice", "doc_id", "held_out", "ids", "bucket", "low", "words", "n"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

        def rows(many: int, **given):
            cols = {"slice": [part] * many} | given
            return pa.RecordBatch.from_arrays([pa.array(cols.get(c, [None] * many), k) for c, k in zip(names, kinds)], names=names)

        def report():
            words = list(index)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(words), np.int32)
            number[order] = np.arange(len(words))
            n = np.zeros(len(words), np.int64)
            for low in range(0, len(kept), 2000):
                some = kept[low : low + 2000]
                ids = [number[k[2]] for k in some]
                train = [i for i, k in zip(ids, some) if not k[1]]
                if train:
                    n += np.bincount(np.concatenate(train), minlength=len(words))
                yield rows(len(some), doc_id=[k[0] for k in some], held_out=[k[1] for k in some], ids=packed(ids, np.int32))
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            has = np.flatnonzero(np.diff(cut))
            yield rows(
                len(has), bucket=has, low=cut[has], words=[b" ".join([words[k] for k in order[cut[h] : cut[h + 1]]]) for h in has],
                n=packed([n[cut[h] : cut[h + 1]] for h in has], np.int64),
            )

        size = 0
        for batch in batches:
            for doc, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                if size > SLICE_BYTES:
                    yield from report()
                    index.clear(), kept.clear()
                    part, size = part + 1, 0
                words = words_of(text)
                size += len(text or "")
                kept.append((doc, held, np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))))
        if kept:
            yield from report()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "slice long, doc_id long, held_out boolean, ids binary, bucket int, low int, words binary, n binary")


def dictionary(words: DataFrame, core: int = CORE) -> DataFrame:
    """Words numbered within their bucket, and exact counts.

    Rows (slice, bucket, low, idx, c, lead): ``idx`` numbers the slice's words in the
    bucket, ``c`` has their training tokens in all slices, ``lead`` marks the first slice of
    a word. Rows with ``word`` set: (bucket, word, at, total) of the bucket's ``core`` most frequent.
    """

    def one(table):
        import pyarrow as pa

        table = table.sort_by("slice")
        bucket = table.column("bucket")[0].as_py()
        index: dict[bytes, int] = {}
        idx, lead = [], []
        for blob in table.column("words").to_pylist():
            before = len(index)
            found = blob.split(b" ")
            idx.append(np.fromiter((index.setdefault(w, len(index)) for w in found), np.int32, len(found)))
            lead.append(idx[-1] >= before)
        total = np.zeros(len(index), np.int64)
        for i, n in zip(idx, unpacked(table.column("n"), np.int64)):
            total[i] += n
        words = list(index)
        least = max(1, int(np.partition(total, -core)[-core])) if len(total) > core else 1
        top = sorted(np.flatnonzero(total >= least).tolist(), key=lambda k: (-total[k], words[k]))[:core]
        m, k = len(idx), len(top)
        return pa.table({
            "slice": pa.array(table.column("slice").to_pylist() + [None] * k, pa.int64()), "bucket": pa.array([bucket] * (m + k), pa.int32()),
            "low": pa.array(table.column("low").to_pylist() + [None] * k, pa.int32()), "idx": pa.array(packed(idx, np.int32) + [None] * k, pa.binary()),
            "c": pa.array(packed([total[i] for i in idx], np.int64) + [None] * k, pa.binary()), "lead": pa.array(packed(lead, np.uint8) + [None] * k, pa.binary()),
            "word": pa.array([None] * m + [words[t] for t in top], pa.binary()), "at": pa.array([None] * m + top, pa.int32()),
            "total": pa.array([None] * m + [int(total[t]) for t in top], pa.int64()),
        })

    return words.select("slice", "bucket", "low", "words", "n").groupBy("bucket").applyInArrow(
        one, "slice long, bucket int, low int, idx binary, c binary, lead binary, word binary, at int, total long"
    )


def by_slice(texts: DataFrame, words: DataFrame, one, schema: str) -> DataFrame:
    return texts.groupBy("slice").cogroup(words.groupBy("slice")).applyInArrow(one, schema)


def tokens(texts) -> np.ndarray:
    """The word numbers of a slice's training texts, one text after another."""
    held = texts.column("held_out").to_pylist()
    return np.frombuffer(b"".join(x for x, h in zip(texts.column("ids").to_pylist(), held) if not h), np.int32)


def core_numbers(words, core: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By word of the slice: its number in the core, or the core's size. ``core``: sorted bucket << 32 | idx."""
    key = np.concatenate([(b << 32) + i.astype(np.int64) for b, i in zip(words.column("bucket").to_pylist(), unpacked(words.column("idx"), np.int32))])
    at = np.minimum(np.searchsorted(core, key), len(core) - 1)
    return np.where(core[at] == key, order[at], len(core))


def core_bigrams(texts: DataFrame, words: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Counts of neighbouring core words, by their numbers; other words in the last row and column."""
    order, size = np.argsort(keys), len(keys) + 1
    core = keys[order]

    def one(left, right):
        import pyarrow as pa

        found = core_numbers(right.sort_by("low"), core, order)[tokens(left)]
        pair, n = np.unique(np.append(0, found[:-1]) * size + found, return_counts=True) if len(found) else (found, found)
        return pa.table([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    rows = by_slice(texts, words.select("slice", "bucket", "low", "idx"), one, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most size * size
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each core word: class 0 is the end token's alone.

    Starts from frequency order dealt over the classes. A word moves to the class for
    which sum n(c,d) log n(c,d) - sum of both margins' n log n is greatest.
    """
    n = len(bigrams) - 1
    b = bigrams[:n, :n]
    classes = max(2, min(classes, n))
    label = np.zeros(n, np.int64)
    label[1:] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.eye(classes)[label]
    pair = member.T @ b @ member
    for _ in range(rounds):
        moved = 0
        for w in range(1, n):
            old = label[w]
            right, left, own = member.T @ b[w], member.T @ b[:, w], b[w, w]
            right[old] -= own  # neighbours other than itself, by class
            left[old] -= own
            pair[old] -= right
            pair[:, old] -= left
            pair[old, old] -= own
            row, col = pair.sum(axis=1), pair.sum(axis=0)
            # gain of putting w into each class
            gain = (_xlogx(pair + right) - _xlogx(pair)).sum(axis=1) + (_xlogx(pair.T + left) - _xlogx(pair.T)).sum(axis=1)
            diagonal = np.diag(pair)
            gain += _xlogx(diagonal + right + left + own) - _xlogx(diagonal + right) - _xlogx(diagonal + left) + _xlogx(diagonal)
            row, col = row + left, col + right  # whichever class w goes to
            gain -= _xlogx(row + right.sum() + own) - _xlogx(row) + _xlogx(col + left.sum() + own) - _xlogx(col)
            gain[0] = -np.inf
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else int(old)
            pair[new] += right
            pair[:, new] += left
            pair[new, new] += own
            if new != old:
                member[w, old], member[w, new], label[w] = 0, 1, new
                moved += 1
        if not moved:
            break
    return label


def neighbours(texts: DataFrame, words: DataFrame, classes: int, keys: np.ndarray, label: np.ndarray) -> DataFrame:
    """How often each class stands left and right of each word, by slice and bucket.

    ``words`` has the classes in ``cls``; where it is null, core words have ``label`` and the
    others none yet (``classes``). Rows (slice, bucket, low, idx, cls, step, times): ``step``
    has the differences of the sorted codes, ``times`` their counts; a code is word *
    2 (classes + 1) + side * (classes + 1) + class. A neighbour that is the word itself
    doesn't count. A row with ``pairs`` set has the slice's counts of neighbouring classes.
    """
    order, kinds = np.argsort(keys), classes + 1
    core, known = keys[order], np.append(label, classes).astype(np.uint8)

    def one(left, right):
        import pyarrow as pa

        right = right.sort_by("low")
        if right.column("cls").null_count:
            cls = known[core_numbers(right, core, order)]
        else:
            cls = np.frombuffer(b"".join(right.column("cls").to_pylist()), np.uint8)
        low = right.column("low").to_numpy()
        high = np.append(low[1:], len(cls))
        at = tokens(left).astype(np.int64)
        c = cls[at].astype(np.int64)
        pairs = np.bincount(np.append(0, c[:-1]) * kinds + c, minlength=kinds * kinds) if len(at) else np.zeros(kinds * kinds, np.int64)
        base = at * (2 * kinds)
        before = (base + np.append(0, c[:-1]))[np.append(True, at[1:] != at[:-1])] if len(at) else base
        after = (base[:-1] + kinds + c[1:])[at[1:] != at[:-1]]
        code, times = np.unique(np.concatenate([before, after]), return_counts=True)
        cut = np.searchsorted(code, np.append(low, len(cls)) * np.int64(2 * kinds))
        m = len(low)
        each = [slice(cut[k], cut[k + 1]) for k in range(m)]
        return pa.table({
            "slice": pa.array(right.column("slice").to_pylist() + [None], pa.int64()), "bucket": pa.array(right.column("bucket").to_pylist() + [None], pa.int32()),
            "low": pa.array(low.tolist() + [None], pa.int32()), "idx": pa.array(right.column("idx").to_pylist() + [None], pa.binary()),
            "cls": pa.array(packed([cls[x:y] for x, y in zip(low, high)], np.uint8) + [None], pa.binary()),
            "step": pa.array(packed([np.diff(code[e] - low[k] * np.int64(2 * kinds), prepend=0) for k, e in enumerate(each)], np.int32) + [None], pa.binary()),
            "times": pa.array(packed([times[e] for e in each], np.int32) + [None], pa.binary()),
            "pairs": pa.array([None] * m + [pairs.tolist()], pa.list_(pa.int64())),
        })

    return by_slice(texts, words.select("slice", "bucket", "low", "idx", "cls"), one, "slice long, bucket int, low int, idx binary, cls binary, step binary, times binary, pairs array<long>")


def best_classes(seen: np.ndarray, old: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The class in which each word most raises the average mutual information.

    ``seen``: per word the counts of the classes left of it, then right of it, each with a
    last column for neighbours without a class; ``old``: its class, or len(pair) for none.
    The word's own counts are taken out of its old class. The other words keep their
    classes. Words without any classed neighbour stay as they are or, if they have no
    class, are dealt over the classes.
    """
    classes = len(pair)
    kinds = classes + 1
    left, right = seen[:, :classes], seen[:, kinds : kinds + classes]
    row, col = pair.sum(axis=1), pair.sum(axis=0)
    own = np.arange(classes) == old[:, None]
    gain = np.zeros((len(seen), classes))
    for counts, margin in ((right, row), (left, col)):
        n = counts.sum(axis=1, keepdims=True)
        rest = np.maximum(margin - own * n, 0)
        gain -= _xlogx(rest + n) - _xlogx(rest)
    for counts, table in ((right, pair.T), (left, pair)):
        word, near = np.nonzero(counts)
        for k in range(0, len(word), ENTRIES_AT_ONCE):
            w, d = word[k : k + ENTRIES_AT_ONCE], near[k : k + ENTRIES_AT_ONCE]
            n = counts[w, d][:, None]
            rest = np.maximum(table[d] - own[w] * n, 0)
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[first]] += np.add.reduceat(_xlogx(rest + n) - _xlogx(rest), first)
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    none = left.sum(axis=1) + right.sum(axis=1) == 0
    at = np.arange(len(seen))
    stay = (old < classes) & (none | (gain[at, best] <= gain[at, np.minimum(old, classes - 1)] + 1e-9))
    best = np.where(none, 1 + at % (classes - 1), best)
    return np.where(stay | (old == 0), old, best)


def exchanged(near: DataFrame, pair: np.ndarray, turn: int) -> DataFrame:
    """(slice, bucket, low, idx, cls) after a round; from the first turn on half of the words may move."""
    classes = len(pair)
    kinds = classes + 1

    def one(table):
        import pyarrow as pa

        idx, cls = unpacked(table.column("idx"), np.int32), unpacked(table.column("cls"), np.uint8)
        size = 1 + max(int(i.max()) for i in idx)
        seen, old = np.zeros(size * 2 * kinds), np.full(size, classes, np.int64)
        for i, c, step, times in zip(idx, cls, unpacked(table.column("step"), np.int32), unpacked(table.column("times"), np.int32)):
            old[i] = c
            word, code = np.divmod(np.cumsum(step, dtype=np.int64), 2 * kinds)
            seen[i[word].astype(np.int64) * 2 * kinds + code] += times
        new = best_classes(seen.reshape(size, 2 * kinds), old, pair)
        new = np.where(np.arange(size) % 2 == turn % 2 if turn else old == classes, new, old)
        return table.select(["slice", "bucket", "low", "idx"]).append_column("cls", pa.array(packed([new[i] for i in idx], np.uint8), pa.binary()))

    return near.where("bucket IS NOT NULL").drop("pairs").groupBy("bucket").applyInArrow(one, "slice long, bucket int, low int, idx binary, cls binary")


def information(pair: np.ndarray) -> float:
    """The average mutual information of neighbouring classes, in nats."""
    n = max(pair.sum(), 1.0)
    return float((_xlogx(pair).sum() - _xlogx(pair.sum(axis=0)).sum() - _xlogx(pair.sum(axis=1)).sum() + _xlogx(n)) / n)


def word_classes(spark: SparkSession, texts: DataFrame, words: DataFrame, keys: np.ndarray, label: np.ndarray) -> tuple[DataFrame, list[float]]:
    """(slice, bucket, low, cls) with a class for every training word, and each round's average mutual information."""
    classes = max(2, int(label.max()) + 1)
    now = words.withColumn("cls", F.lit(None).cast("binary"))
    best, chosen, found, base = None, -1, [], shared_dir(spark)
    for turn in range(ALL_ROUNDS + 1):
        near = settle(spark, neighbours(texts, now, classes, keys, label), path=f"{base}/near{turn}")
        sums = near.where("pairs IS NOT NULL").select(F.posexplode("pairs").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        pair = np.zeros((classes + 1) ** 2)
        pair[sums["k"].to_numpy(np.int64)] = sums["v"].to_numpy(float)
        pair = pair.reshape(classes + 1, classes + 1)[:classes, :classes]
        if turn:  # before, most words have no class
            found.append(information(pair))
            if best is None or found[-1] > max(found[:-1]):
                best, chosen = near, turn
            if len(found) > 2 and found[-1] < found[-3] * (1 + SETTLED):
                break
        # no later round reads what this one was made of, unless it is the best so far
        forget(spark, [f"{base}/near{t}" for t in range(turn) if t != chosen])
        now = exchanged(near, pair, turn)
    return best.where("bucket IS NOT NULL").select("slice", "bucket", "low", "cls"), found


def scored(texts: DataFrame, lookup: DataFrame, classes: int) -> DataFrame:
    """Parts of the scores, and a slice's share of the corpus totals.

    Text rows: (doc_id, held_out, n_tokens, n_known, log_counts, log_emit, pairs, times);
    one row of totals a slice with doc_id null and ``totals`` set: per class the training
    tokens and the words first seen here, then the class bigrams.
    """

    def one(left, right):
        import pyarrow as pa

        own_class, counted = right.filter(right.column("c").is_null()).sort_by("low"), right.filter(right.column("c").is_valid()).sort_by("low")
        c = np.frombuffer(b"".join(counted.column("c").to_pylist()), np.int64).astype(float)
        lead = np.frombuffer(b"".join(counted.column("lead").to_pylist()), np.uint8)
        cls = np.frombuffer(b"".join(own_class.column("cls").to_pylist()), np.uint8).astype(np.int64)
        cls = np.where(c > 0, cls, classes)  # ``classes``: unseen
        logs, emits = np.log10(c + 0.5), np.log10(np.maximum(c - 0.5, 0.5))
        mine = (lead == 1) & (c > 0)
        totals = np.zeros(2 * classes + classes * (classes + 1))
        totals[:classes] = np.bincount(cls[mine], c[mine], classes)[:classes]
        totals[classes : 2 * classes] = np.bincount(cls[mine], minlength=classes)[:classes]
        bigrams = np.zeros((classes + 1) * (classes + 1), np.int64)
        rows = []
        for doc, held, at in zip(left.column("doc_id").to_pylist(), left.column("held_out").to_pylist(), unpacked(left.column("ids"), np.int32)):
            own = cls[at]
            pair = np.append(0, own[:-1]) * (classes + 1) + own
            kinds, times = np.unique(pair, return_counts=True)
            if not held:
                bigrams[kinds] += times
            known = own < classes
            rows.append((doc, held, len(at), int(known.sum()), float(logs[at].sum()), float(emits[at[known]].sum()), kinds, times, None))
        totals[2 * classes :] = bigrams.reshape(classes + 1, classes + 1)[:classes].ravel()
        rows.append((None, None, 0, 0, 0.0, 0.0, None, None, totals))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "log_emit", "pairs", "times", "totals"]
        return pa.table([pa.array(col, k) for col, k in zip(zip(*rows), kinds)], names=names)

    return by_slice(texts, lookup, one,
        "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_emit double, pairs array<int>, times array<int>, totals array<double>"
    )


def class_model(totals: np.ndarray, classes: int) -> tuple[int, int, np.ndarray]:
    """(N, V, log10 of each class pair's whole factor except the word's own count)."""
    tokens, types = totals[:classes], totals[classes : 2 * classes]
    pair = totals[2 * classes :].reshape(classes, classes + 1)[:, :classes]
    n, v = int(tokens.sum()), int(types.sum())
    unseen = (v + 1) / (2 * n + 2) if n else 1.0
    unigram = (tokens + 0.5) / (tokens + 0.5).sum()
    unigram = np.where(types > 0, unigram, 0)
    unigram = unigram / unigram.sum() if unigram.sum() else np.full(classes, 1 / classes)
    kinds = np.maximum((pair > 0).sum(axis=1, keepdims=True), 1)
    given = (pair + kinds * unigram) / (pair.sum(axis=1, keepdims=True) + kinds)
    left = np.maximum(tokens - 0.5 * types, 0.5)  # sum of (c - 0.5) over a class
    factor = np.full((classes + 1, classes + 1), np.log10(unseen))
    # after an unseen word the class unigram holds
    for k, row in enumerate([*given, unigram]):
        factor[k, :classes] = np.log10(np.maximum(row, 1e-300)) + np.log10(max(1 - unseen, 1e-300)) - np.log10(left)
    return n, v, factor


def score(spark: SparkSession, docs: DataFrame, held_out: Column, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)."""
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    both = settle(spark, numbered(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))), "texts")
    texts = both.where("bucket IS NULL").select("slice", "doc_id", "held_out", "ids")
    found = settle(spark, dictionary(both.where("bucket IS NOT NULL")), "words")
    words = found.where("slice IS NOT NULL").select("slice", "bucket", "low", "idx", "c", "lead")
    top = found.where("word IS NOT NULL").orderBy(F.desc("total"), "word").select("word", "bucket", "at").limit(CORE).collect()  # at most ``CORE``
    keys = np.array([(r["bucket"] << 32) + r["at"] for r in sorted(top, key=lambda r: r["word"] != END)], np.int64)  # the end token first
    if len(keys):
        label = exchange(core_bigrams(texts, words, keys), classes)
    else:  # no training rows
        keys, label = np.full(1, -1, np.int64), np.zeros(1, np.int64)
    label[0], classes = 0, max(2, int(label.max()) + 1)
    cls, _ = word_classes(spark, texts, words, keys, label)
    none = F.lit(None).cast("binary")
    lookup = words.select("slice", "low", "c", "lead", none.alias("cls")).unionByName(cls.select("slice", "low", none.alias("c"), none.alias("lead"), "cls"))
    parts = settle(spark, scored(texts, lookup, classes), "parts")
    sums = parts.where("totals IS NOT NULL").select(F.posexplode("totals").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    totals = np.zeros(2 * classes + classes * (classes + 1))
    totals[sums["k"].to_numpy(np.int64)] = sums["v"].to_numpy(float)
    n, v, factor = class_model(totals, classes)
    flat = factor.ravel()

    def of_pairs(pairs: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([float(flat[p] @ t) for p, t in zip(pairs, times)], dtype="float64")

    return (
        parts.where("totals IS NULL")
        .withColumn("score", F.col("log_emit") + F.pandas_udf(of_pairs, "double")("pairs", "times"))
        .select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
            (F.col("log_counts") - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
            "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
        )
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), id_remainder() == 1)
