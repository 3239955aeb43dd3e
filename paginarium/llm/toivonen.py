"""Phrases whose words stick together, mined by Toivonen's sampling.

A sample of the documents (``SHARE`` of the rows, by a seeded hash of id and text)
proposes phrases of one to five words: those met at least ``LOWERED`` of the threshold's
share of times. A full pass counts, exactly, every proposed phrase and the negative
border: phrases that weren't proposed but whose two phrases of one word less were (all
words not proposed, too). If a phrase of the border reaches the threshold, longer ones above it may
too and haven't been counted, so it joins the proposal and an expansion pass counts what has
become reachable. That pass follows a phrase it counts for the first time as if it were
frequent, so it reaches phrases of any length above a failure and closes the mining at once:
whatever is frequent has shorter phrases that are proposed, found, or counted in the same
pass. The result doesn't depend on the sample; only the work does.

Passes count 64-bit hashes of phrases. What is proposed reaches the tasks as a table of
bits, 16 a phrase and at most ``MOST_BITS``, whose size the driver thus bounds; a phrase
that shares a bit, or a hash, with another is counted needlessly, never missed. The last
pass counts the spelled phrases among those whose hashes reached the threshold, so what is
returned rests on texts, not on hashes.

Counts are summed in the tasks before they are shuffled, by phrase and not by language, so
neither a frequent phrase nor a frequent language gathers rows. The first 2,000 of a
language are chosen within parts of it first.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated
rows count each; a text of any length is read whole, a long one in slices that end
where a piece ends; an empty table gives no rows; other columns than doc_id, text and lang are not read. Ties:
by score and count descending, then phrase by its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paginarium.llm.common import forget, settle, shared_dir

LEAST, LONGEST, FIRST = 100, 5, 2000
SHARE, LOWERED = 0.1, 0.4
MOST_BITS = 1 << 28
SLICE_BYTES = 1_000_000
#: Hashes a task holds before it sums them up and sends them.
HELD = 2_000_000
#: Spelled phrases a task holds before it sends them.
SPELLED = 1_000_000
PARTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_ENDS = re.compile(r"[.,;:!?\n\x0b\x0c\r]")
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _mixed(s: np.ndarray) -> np.ndarray:
    s = s ^ (s >> np.uint64(30))
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(27)
    s *= np.uint64(0x94D049BB133111EB)
    return s ^ (s >> np.uint64(31))


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Words:
    """The words of some texts, one after another: where they are, their pieces and hashes."""

    def __init__(self, texts: list[str], langs: list[str]) -> None:
        import xxhash

        raw = [t.encode() for t in texts]
        self.bytes = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        kind = _KIND[self.bytes]
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        until = np.cumsum([len(r) + 1 for r in raw])
        self.text = np.searchsorted(until, self.starts, side="right")
        self.langs = langs
        n = (len(self.bytes) >> 18) + 1 << 18
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[: len(self.bytes)])])
        spelled = (sums[self.ends] - sums[self.starts]) * _powers(_UNBASE, n)[self.starts]
        seeds = np.array([xxhash.xxh64_intdigest(lang.encode(), 7) for lang in langs], np.uint64)
        self.one = _mixed(spelled + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ seeds[self.text])

    def longer(self, at: np.ndarray, shorter: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the phrases of ``k`` words at ``at``, from those of ``k - 1`` there."""
        return _mixed(shorter * np.uint64(0xD6E8FEB86659FD93) + self.one[at + k - 1])

    def starts_of(self, k: int) -> np.ndarray:
        """For each word whether ``k`` words of one piece begin there."""
        n = len(self.one) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, bool)

    def spelled(self, at: int, k: int) -> str:
        return b" ".join(self.bytes[s:e].tobytes() for s, e in zip(self.starts[at : at + k], self.ends[at : at + k])).decode()


def slices(batches, most: int) -> Iterator[Words]:
    """The words of all batches of (text, lang), some texts at a time; a long text is cut between pieces."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            text, lang, at = text.as_py() or "", lang.as_py(), 0
            while at < len(text):
                end = len(text)
                if end - at > most and (found := _ENDS.search(text, at + most)):
                    end = found.end()
                texts.append(text[at:end])
                langs.append("und" if lang is None else lang)
                size += end - at
                at = end
                if size > most:
                    yield Words(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs)


def met(words: Words, proposed: np.ndarray | None, before: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, positions, hashes, whether proposed) of the phrases to count: all words, then the
    phrases whose two shorter ones were proposed (all phrases without a proposal).

    After a pass with the proposal ``before`` only what that didn't count is left, and
    such phrases count as proposed.
    """
    done = {} if before is None else {k: at for k, at, _, _ in met(words, before)}
    at, hashes, held = np.arange(len(words.one)), words.one, None
    for k in range(1, LONGEST + 1):
        if k > 1:
            both = words.starts_of(k) & held[: len(words.one) - k + 1] & held[1 : len(words.one) - k + 2]
            if not both.any():
                return
            keep = both[at[: np.searchsorted(at, len(both))]]
            at, hashes = at[: len(keep)][keep], hashes[: len(keep)][keep]
            hashes = words.longer(at, hashes, k)
        here = np.ones(len(at), bool) if proposed is None else has(proposed, hashes)
        if before is None:
            yield k, at, hashes, here
        else:
            new = np.isin(at, done.get(k, at[:0]), assume_unique=True, invert=True)
            here |= new
            yield k, at[new], hashes[new], here[new]
        held = np.zeros(len(words.one) + 1, bool)
        held[at] = here


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def counted(docs: DataFrame, proposed=None, before=None) -> DataFrame:
    """(h, n): how often each phrase occurs that ``proposed`` lets count and ``before`` (broadcasts of bits) didn't."""

    def run(batches):
        bits, old = (None if b is None else b.value for b in (proposed, before))
        held, size = [], 0

        def summed():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for words in slices(batches, SLICE_BYTES):
            for _, _, hashes, _ in met(words, bits, old):
                held.append(hashes)
                size += len(hashes)
            if size > HELD:
                yield summed()
                held, size = [], 0
        if held:
            yield summed()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def bits_of(phrases: DataFrame, size: int) -> np.ndarray:
    """A table of ``size`` bits with those of the phrases' hashes set; its rows are a 64th of ``size`` at most."""
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    rows = phrases.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("m"))
    found = rows.groupBy("at").agg(F.bit_or("m").alias("m")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[found["at"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64).view(np.uint64)
    return bits


def bits_for(n: int) -> int:
    return min(MOST_BITS, 1 << max(16, (16 * n).bit_length()))


def spelled(docs: DataFrame, frequent) -> DataFrame:
    """(lang, phrase, words, n) of the phrases with hashes in ``frequent``; phrase '' has all words of a language."""

    def run(batches):
        bits = frequent.value
        places, said, counts, totals = {}, [], np.zeros(1024, np.int64), {}

        def sent():
            rows = [(*what, n) for what, n in zip(said, counts.tolist())] + [(lang, "", 0, n) for lang, n in totals.items()]
            columns = zip(*rows) if rows else ([],) * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "words", "n"])

        for words in slices(batches, SLICE_BYTES):
            for k, at, hashes, here in met(words, bits):
                if k == 1:
                    for text, n in zip(*np.unique(words.text, return_counts=True)):
                        totals[words.langs[text]] = totals.get(words.langs[text], 0) + int(n)
                at, hashes = at[here], hashes[here]
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                place = np.fromiter((places.setdefault(h, len(places)) for h in found.tolist()), np.int64, len(found))
                for new in np.flatnonzero(place >= len(said)).tolist():
                    i = int(at[first[new]])
                    said.append((words.langs[words.text[i]], words.spelled(i, k), k))
                if len(counts) < len(said):
                    counts = np.concatenate([counts, np.zeros(len(said), np.int64)])
                counts[place] += n
            if len(said) > SPELLED:
                yield sent()
                places, said, counts, totals = {}, [], np.zeros(1024, np.int64), {}
        yield sent()

    return docs.mapInArrow(run, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def frequent_phrases(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of one to five words with at least ``LEAST`` occurrences, and phrase '' of each language."""
    base, sc = shared_dir(spark), spark.sparkContext
    texts = docs.select("text", "lang")
    sample = docs.where(F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 20)) < int(SHARE * (1 << 20))).select("text", "lang")
    # a word met once in the sample says nothing, however small the sample
    proposal = settle(spark, counted(sample).where(F.col("n") >= max(2, int(LEAST * SHARE * LOWERED))).select("h"), path=f"{base}/proposal")
    size = bits_for(proposal.count())
    bits = sc.broadcast(bits_of(proposal, size))
    frequent = settle(spark, counted(texts, bits).where(F.col("n") >= LEAST).select("h"), path=f"{base}/frequent")
    more = bits_of(frequent, size)
    if (more & ~bits.value).any():  # the border holds frequent phrases
        found = counted(texts, sc.broadcast(bits.value | more), bits).where(F.col("n") >= LEAST).select("h")
        frequent = frequent.union(settle(spark, found, path=f"{base}/above"))
    kept = sc.broadcast(bits_of(frequent, bits_for(frequent.count())))
    phrases = settle(spark, spelled(texts, kept).where((F.col("n") >= LEAST) | (F.col("phrase") == "")), "phrases")
    forget(spark, [f"{base}/proposal", f"{base}/frequent", f"{base}/above"])
    return phrases


def collocations(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to five words."""
    phrases = frequent_phrases(spark, docs)
    total = phrases.where("phrase = ''").select("lang", F.col("n").alias("all"))  # a row for each language
    counts = phrases.where("phrase <> ''")
    candidates = counts.where("words > 1").withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    each = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(total, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast((cast(1000 as decimal(38,0)) * (cast(a as decimal(19,0)) * cast(all as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    lowest = each.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.first("all").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("words > 2").select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda s: part(s, n))))).alias("phrase")).distinct()
    kept = lowest.join(inner, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = dealt.withColumn("nth", first(["lang", "part"])).where(F.col("nth") <= FIRST)
    return some.withColumn("rank", first(["lang"]).cast("long")).where(F.col("rank") <= FIRST).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, LONGEST + 1))
ORACLE = f"""WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM cut),
f AS (SELECT lang, k, phrase, count(*) AS n FROM ({_GRAMS}) GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
total AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS after FROM c),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.k, a, after, l.n AS l, r.n AS r, total.n AS n, CAST((1000::HUGEINT * a * total.n) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(w[1:after], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[after + 1:], ' ') JOIN total ON total.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, after) = 1),
inside AS (SELECT DISTINCT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest ANTI JOIN inside USING (lang, phrase, a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= {FIRST}"""
