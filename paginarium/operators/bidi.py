"""Lines with text from right to left: direction segments, and logical order out of the order seen on the page."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Characters by direction. Letters are right-to-left in the blocks of Hebrew, Arabic and their
# neighbours; the signs listed beside them count with those letters.
RIGHT = r"[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}&&[\p{L}]]|[\x{5BE}\x{5C0}\x{5C3}\x{5C6}\x{5F3}\x{5F4}\x{61B}\x{61E}\x{61F}\x{6D4}\x{200F}]"
NUMBER = r"[0-9\x{B2}\x{B3}\x{B9}\x{660}-\x{669}\x{66B}\x{66C}\x{6F0}-\x{6F9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{FF10}-\x{FF19}]"
SEPARATOR = r"[,./:+\-\x{A0}\x{60C}\x{2044}\x{202F}\x{207A}\x{207B}\x{208A}\x{208B}\x{2212}\x{FF0B}-\x{FF0F}\x{FF1A}]"
TERMINATOR = r"[#$%\x{A2}-\x{A5}\x{B0}\x{B1}\x{66A}\x{2030}-\x{2034}\x{20A0}-\x{20CF}\x{2213}\x{FF03}-\x{FF05}]"
WEAK = r"[\p{Mn}\p{Me}\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{200B}-\x{200D}\x{FEFF}]"
LEFT = r"[\p{L}\p{Mc}\p{Nl}\x{200E}]"
#: Brackets and signs and what they become when turned round.
MIRRORS = "()<>[]{}«»‹›≤≥⁅⁆⁽⁾₍₎〈〉《》「」『』【】〔〕〖〗〘〙〚〛（）＜＞［］｛｝"
TURNED = "".join(MIRRORS[k + 1] + MIRRORS[k] for k in range(0, len(MIRRORS), 2))


def kind(c: Column) -> Column:
    """What a character is: L and R letters, N digits, S separators, T terminators, W marks and controls, else O."""
    found = F.when(c.rlike(f"^(?:{WEAK})"), "W").when(c.rlike(f"^(?:{RIGHT})"), "R").when(c.rlike(f"^{NUMBER}"), "N")
    return found.when(c.rlike(f"^{SEPARATOR}"), "S").when(c.rlike(f"^{TERMINATOR}"), "T").when(c.rlike(f"^{LEFT}"), "L").otherwise("O")


#: Kinds, and their numbers in the arrays below.
KINDS = "LRNSTWO"
LEFTS, RIGHTS, NUMBERS, SEPARATORS, TERMINATORS, _, OTHERS = range(7)


@functools.cache
def _packed_kinds(version: str) -> bytes:
    spark = SparkSession.active()
    points = spark.range(0, 0x110000, 1, 8).where(~F.col("id").between(0xD800, 0xDFFF))
    marked = F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))  # a mark of its own, so U+FEFF is not taken for one
    told = points.select("id", kind(F.decode(F.unhex(marked), "UTF-32")).alias("kind")).where("kind <> 'O'").toArrow()
    table = np.full(0x110000, OTHERS, np.uint8)
    table[np.asarray(told["id"])] = np.array([KINDS.index(k) for k in told["kind"].to_pylist()], np.uint8)
    return zlib.compress(table.tobytes())


def kind_table() -> bytes:
    """The ``kind`` of every code point, asked of Spark once: a table of fixed size, packed, that goes with the functions below."""
    return _packed_kinds(SparkSession.active().version)


@functools.cache
def _unpacked(table: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.uint8)


class _Lines:
    """The characters of a batch of lines end to end: code points, the line and the place in it of each."""

    def __init__(self, texts: pa.Array):
        found = [t or "" for t in texts.to_pylist()]
        self.size = np.fromiter(map(len, found), np.int64, len(found))
        self.point = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
        self.line = np.repeat(np.arange(len(found)), self.size)
        self.first = np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.last = self.first + np.repeat(self.size, self.size) - 1
        self.all = np.arange(len(self.point))

    def before(self, holds: np.ndarray) -> np.ndarray:
        """For each character the nearest one before it in its line of which something holds, or -1."""
        found = np.concatenate([[-1], np.maximum.accumulate(np.where(holds, self.all, -1))])[:-1]
        return np.where(found >= self.first, found, -1)

    def after(self, holds: np.ndarray) -> np.ndarray:
        n = len(self.all)
        found = np.concatenate([np.minimum.accumulate(np.where(holds, self.all, n)[::-1])[::-1], [n]])[1:]
        return np.where(found <= self.last, found, -1)

    def nearest(self, values: np.ndarray, holds: np.ndarray, nothing) -> tuple[np.ndarray, np.ndarray]:
        """The values of these characters on either side; ``nothing`` where there is none."""
        return tuple(np.where(at >= 0, values[at], nothing) if len(values) else values for at in (self.before(holds), self.after(holds)))

    def texts(self, points: np.ndarray) -> pa.Array:
        whole = points.astype(np.uint32).tobytes().decode("utf-32-le")
        ends = np.cumsum(self.size)
        return pa.array([whole[a:b] for a, b in zip((ends - self.size).tolist(), ends.tolist())], pa.string())


def runs_of(text: Column) -> Column:
    """The runs of one direction of a line, in order: an array of (n, first, length, direction), as ``segments`` has them."""
    table = kind_table()

    def found(texts: pa.Array) -> pa.Array:
        own = _Lines(texts)
        way = np.array([0, 1, 2, 2, 2, 2, 3], np.int8)[_unpacked(table)[own.point]]
        head = own.all == own.first
        at = np.flatnonzero(head | np.concatenate([[True], way[1:] != way[:-1]])) if len(way) else own.all
        length = np.diff(np.append(at, len(way)))
        # an empty neutral run goes before a line's first one of another direction
        lead = head[at] & (way[at] != 3)
        times = 1 + lead
        n = np.repeat(at, times)
        empty = np.zeros(len(n), bool)
        empty[(np.cumsum(times) - times)[lead]] = True
        line = own.line[n]
        counts = np.bincount(line, minlength=len(texts))
        number = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts)
        fields = [pa.array(number), pa.array((n - own.first[n]).astype(np.int32)), pa.array(np.where(empty, 0, np.repeat(length, times))), pa.array(np.where(empty, "neutral", np.array(["left", "right", "weak", "neutral"])[way[n]]), pa.string())]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays(fields, ["n", "first", "length", "direction"]))

    return F.arrow_udf(found, "array<struct<n:bigint,first:int,length:bigint,direction:string>>")(text)


def segments(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, n, first, length, direction): runs of one direction (left, right, weak, neutral) in each line.

    As readers count them, a line that doesn't start with a neutral character has an empty neutral run
    first. Null and empty lines have no runs. ``rights_lead`` tells lines apart by these runs. Within the row, no shuffle.
    """
    return lines.select(*keys, F.explode(runs_of(F.col(text))).alias("run")).select(*keys, "run.*")


def rights_lead(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, right_to_left): whether a line has more runs to the left than to the right."""
    return runs.groupBy(*keys).agg((F.count_if(F.col("direction") == "right") > F.count_if(F.col("direction") == "left")).alias("right_to_left"))


def logical_order(lines: DataFrame, doc: str, line: str, text: str) -> DataFrame:
    """(doc, line, text, right_to_left): lines with right-to-left letters, put from the order seen into the order read.

    A line reads right to left if it has more letters of that kind; a line without letters follows the
    line before it. A single separator between digits and terminators beside them belong to the number; a number
    in a left-to-right line belongs to Latin before it (or around it); other signs take the direction their
    neighbours share, else the line's. Then runs of level 2 and of level 1 are turned round, and brackets
    in right-to-left runs are mirrored. Lines without right-to-left letters before or in them are as seen.

    Characters never become rows: an Arrow function reorders a batch of lines in numpy. What a character needs of its
    neighbours are running values of the line from both ends, and the two turns are sums of positions: nothing is
    quadratic. Only whole lines are moved, once, to be put in order within their document.
    """
    counted = lines.select(doc, line, F.coalesce(text, F.lit("")).alias("text"))
    counted = counted.select("*", _letters(F.col("text")).alias("letters")).select(doc, line, "text", "letters.*")
    own = F.when(F.col("rights") + F.col("lefts") > 0, F.col("rights") > F.col("lefts"))
    before = Window.partitionBy(doc).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    flagged = counted.select("*", F.coalesce(F.last(own, ignorenulls=True).over(before), F.lit(False)).alias("right_to_left"))
    turns = (F.col("rights") > 0) | ((F.col("lefts") == 0) & F.col("right_to_left"))
    return flagged.select(doc, line, _read(F.col("text"), F.col("right_to_left"), turns).alias("text"), "right_to_left")


def _letters(text: Column) -> Column:
    """How many right-to-left and left-to-right letters a line has: (rights, lefts)."""
    table = kind_table()

    def found(texts: pa.Array) -> pa.Array:
        own = _Lines(texts)
        k = _unpacked(table)[own.point]
        count = lambda which: pa.array(np.bincount(own.line[k == which], minlength=len(texts)))
        return pa.StructArray.from_arrays([count(RIGHTS), count(LEFTS)], ["rights", "lefts"])

    return F.arrow_udf(found, "struct<rights:bigint,lefts:bigint>")(text)


def _read(text: Column, right_to_left: Column, turns: Column) -> Column:
    """Lines in the order read; those that don't turn stay."""
    table = kind_table()
    mirrored = [ord(c) for c in MIRRORS], [ord(c) for c in TURNED]

    def found(texts: pa.Array, rights: pa.Array, turns: pa.Array) -> pa.Array:
        at = np.flatnonzero(np.asarray(turns))
        out = texts.to_pylist()
        for k, read in zip(at.tolist(), reordered(texts.take(pa.array(at)), np.asarray(rights)[at]).to_pylist()):
            out[k] = read
        return pa.array(out, pa.string())

    def reordered(texts: pa.Array, rtl: np.ndarray) -> pa.Array:
        own = _Lines(texts)
        k = _unpacked(table)[own.point].astype(np.int64)
        rtl = rtl[own.line]
        nothing = -1
        # a single separator between digits, then terminators beside a number
        p, q = (np.where(ok, np.roll(k, by), nothing) for ok, by in ((own.all > own.first, 1), (own.all < own.last, -1)))
        k = np.where((k == SEPARATORS) & (p == NUMBERS) & (q == NUMBERS), NUMBERS, k)
        a, b = own.nearest(k, k != TERMINATORS, nothing)
        k = np.where((k == TERMINATORS) & ((a == NUMBERS) | (b == NUMBERS)), NUMBERS, np.where(k <= NUMBERS, k, OTHERS))
        a, b = own.nearest(k, k <= RIGHTS, nothing)
        k = np.where(~rtl & (k == NUMBERS) & ((a == LEFTS) | ((a == nothing) & (b != RIGHTS))), LEFTS, k)
        whole = np.where(rtl, RIGHTS, LEFTS)
        a, b = own.nearest(np.where(k == NUMBERS, RIGHTS, k), k != OTHERS, nothing)
        a, b = np.where(a == nothing, whole, a), np.where(b == nothing, whole, b)
        settled = np.where(k != OTHERS, k, np.where(a == b, a, whole))
        level = np.where(settled == LEFTS, 2 * rtl, np.where(settled == RIGHTS, 1, 2))
        place = own.all
        for least in (2, 1):
            # a run of this level or more: from behind the last lower character to before the next
            a, b = own.before(level < least), own.after(level < least)
            place = np.where(level >= least, np.where(a >= 0, a, own.first - 1) + np.where(b >= 0, b, own.last + 1) - place, place)
        turned = np.arange(0x110000, dtype=np.uint32)
        turned[mirrored[0]] = mirrored[1]
        read = np.empty(len(k), np.uint32)
        read[place] = np.where(level % 2 == 1, turned[own.point], own.point)
        return own.texts(read)

    return F.arrow_udf(found, "string")(text, right_to_left, turns)
