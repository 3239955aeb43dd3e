"""Search in texts with offsets and hit lines. All offsets come from arrays within a row: no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paginarium.functions.arrays import running_sums
from paginarium.functions.wrapping import TOGETHER, simple_lower

#: A neighbour that makes a hit part of a longer word: letters, digits, and the code points between Z and a.
JOINS_WORD = r"[A-Za-z0-9\[\\\]^_`]"


def placed(pieces: Column, gap: int) -> Column:
    """(piece, start) of consecutive pieces with ``gap`` characters between two."""
    starts = running_sums(F.transform(pieces, lambda x: F.length(x) + gap))
    return F.zip_with(pieces, starts, lambda p, s: F.struct(p.alias("piece"), s.alias("start")))


def hits(docs: DataFrame, needle: str, ignore_case: bool = False, whole_word: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, start, end, line) of every hit, from the left, none overlapping the one before.

    Offsets count characters of the whole text. The text is cut into lines and each line
    at the needle; starts are running sums of the pieces' lengths. Without case, letters
    are folded one for one, so offsets hold in the text as it is.
    """
    size = len(needle)
    folded = simple_lower if ignore_case else (lambda c: c)
    needle = needle.lower() if ignore_case else needle
    contains = lambda c: F.contains(folded(c), F.lit(needle))
    found = docs.where(contains(F.col("text")))
    lines = F.filter(placed(F.split("text", "\n", -1), 1), lambda x: contains(x["piece"]))
    each = found.select(key, F.explode(lines).alias("l")).select(key, F.col("l.piece").alias("line"), F.col("l.start").alias("line_start"))
    # of the pieces of a line, all but the first follow a hit
    pieces = placed(F.split(folded(F.col("line")), _quoted(needle), -1), size)
    at = each.select(key, "line", "line_start", F.explode(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda x: x["start"])).alias("before"))
    start = F.col("before") - size
    if whole_word:
        left = F.when(start > 0, F.expr(f"substring(line, cast(before - {size} as int), 1)")).otherwise("")
        right = F.expr("substring(line, cast(before + 1 as int), 1)")
        at = at.where(~left.rlike(JOINS_WORD) & ~right.rlike(JOINS_WORD))
    return at.select(key, (F.col("line_start") + start).alias("start"), (F.col("line_start") + F.col("before")).alias("end"), "line")


def _quoted(needle: str) -> str:
    return "\\Q" + needle + "\\E"


def words_with_offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, word, start, end): the words between spaces and line breaks, with offsets."""
    line = docs.select(key, F.explode(placed(F.split("text", "\n", -1), 1)).alias("l"))
    words = F.filter(placed(F.split("l.piece", " ", -1), 1), lambda x: x["piece"] != "")
    each = line.select(key, F.col("l.start").alias("line_start"), F.explode(words).alias("w"))
    each = each.select(key, F.col("w.piece").alias("word"), (F.col("line_start") + F.col("w.start")).alias("start"))
    return each.select(key, "word", "start", (F.col("start") + F.length("word")).alias("end"))


def splits(character: str) -> bool:
    """``wrapping.splits_needle`` of a character that is at hand when the plan is made."""
    spans = re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", TOGETHER)
    return not any(int(a, 16) <= ord(character) <= int(b or a, 16) for a, b in spans)


SEPARATOR = r"[\n \r\x{A0}]"


def phrase_pattern(needle: str) -> str:
    """The pattern of a needle of several parts, for Java and RE2.

    Runs between spaces follow each other over one or more separators (line ends count),
    characters of scripts without spaces also over none. A space at either end takes one
    separator into the hit; a needle of spaces alone is meant as it is. Soft hyphens in
    the text count as not there.
    """
    if not needle.strip(" "):
        return needle or "(?!)"
    quote = lambda c: c if c.isalnum() or ord(c) > 127 else "\\" + c
    out, words = "", re.split(" +", needle)
    for k, word in enumerate(words):
        if not word:
            out += SEPARATOR if k == 0 else ""
            continue
        units: list[str] = []
        for c in word:
            if units and not splits(c) and not splits(units[-1][-1]):
                units[-1] += c
            else:
                units.append(c)
        if k and words[k - 1]:
            loose = splits(word[0]) or splits(words[k - 1][-1])
            out += SEPARATOR + ("*" if loose else "+")
        out += (SEPARATOR + "*").join("\\x{AD}*".join(map(quote, u)) for u in units)
    return out + (SEPARATOR if not words[-1] else "")


def phrase_hits(docs: DataFrame, needle: str, ignore_case: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, start, end, hit) of every hit of a needle of several words, also across line ends; no shuffle."""
    fold = simple_lower if ignore_case else (lambda c: c)
    pattern = phrase_pattern(needle.lower() if ignore_case else needle)
    body = fold(F.col("text"))
    found = docs.where(body.rlike(pattern)).select(key, "text", F.split(body, pattern, -1).alias("pieces"), F.regexp_extract_all(body, F.lit(f"({pattern})")).alias("hits"))
    sizes = F.zip_with("pieces", "hits", lambda p, h: F.length(p) + F.coalesce(F.length(h), F.lit(0)))
    each = F.zip_with(F.zip_with("pieces", running_sums(sizes), lambda p, s: s + F.length(p)), "hits", lambda s, h: F.struct(s.alias("start"), h.alias("hit")))
    at = found.select(key, "text", F.explode(F.filter(each, lambda x: x["hit"].isNotNull())).alias("x"))
    start, end = F.col("x.start"), F.col("x.start") + F.length("x.hit")
    return at.select(key, start.alias("start"), end.alias("end"), F.substring(F.col("text"), (start + 1).cast("int"), F.length("x.hit")).alias("hit"))
