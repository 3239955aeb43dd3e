"""Text scalars as Column expressions: lines, words, keys of running lines, markers, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paginarium.functions.wrapping import SPACES, TIGHT, WIDE

# Signs a list item may start with (the last range: private use), numerals of lists,
# and what a finished paragraph ends in.
BULLETS = r"•·‣◦▪*–\-\x{E000}-\x{F8FF}"
DIGITS, NUMERALS = "0-9０-９", "〇零一二三四五六七八九十百"
FINISHED = ".!?:;…\"')\\]”’。！？：；」』）】》"
#: The label of a numbered line, in the first or the second group: a number in full-width brackets or before an
#: enumeration comma needs no space after it; ``1.``, ``2)`` and ``2.1`` do. Groups have up to three numerals.
NUMBERED = (
    f"^(?:(（(?:[{DIGITS}]{{1,3}}|[{NUMERALS}]{{1,3}})）|[{NUMERALS}]{{1,3}}、|(?:[{DIGITS}]{{1,3}}\\.)*[{DIGITS}]{{1,3}}、)[{SPACES}]*"
    f"|((?:[{DIGITS}]{{1,3}}\\.)*[{DIGITS}]{{1,3}}[.)]|(?:[{DIGITS}]{{1,3}}\\.)+[{DIGITS}]{{1,3}})[{SPACES}]+)[^{SPACES}]"
)
#: Dots of a leader, spaces between them or not, at least.
LEADER = 5
#: Latin ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def lines(text: Column) -> Column:
    """The lines of a text: CRLF counts as LF, blank lines are dropped."""
    return F.filter(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1), lambda x: F.trim(x) != "")


def words(text: Column) -> Column:
    """The runs of a text between ASCII white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+", -1), lambda x: x != "")


def running_key(line: Column) -> Column:
    """What lines that differ in page numbers alone share: digit runs are one mark, spacing is single."""
    return F.regexp_replace(F.trim(F.regexp_replace(line, r"[ \t\n\x0B\f\r]+", " ")), "[0-9]+", "#")


def starts_with_bullet(line: Column) -> Column:
    return line.rlike(f"^[{BULLETS}][{SPACES}]")


def leading_number(line: Column) -> Column:
    """The label of a numbered line with its marks (``12.``, ``2.1``, ``（一）``), or null."""
    return F.when(line.rlike(NUMBERED), F.concat(F.regexp_extract(line, NUMBERED, 1), F.regexp_extract(line, NUMBERED, 2)))


def item_text(line: Column) -> Column:
    """A list item without its label or bullets."""
    label = leading_number(line)
    rest = F.when(label.isNotNull(), F.substring(line, F.length(label) + 1, F.length(line))).otherwise(F.regexp_replace(line, f"^[{BULLETS}]+", ""))
    return F.regexp_replace(rest, f"^[{SPACES}]+", "")


def line_class(line: Column) -> Column:
    return F.when(starts_with_bullet(line), "bullet").when(leading_number(line).isNotNull(), "numbered").otherwise("body")


def without_ligatures(text: Column) -> Column:
    for sign, plain in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def short_leaders(text: Column) -> Column:
    """Runs of dots and spaces with five dots or more, as in a table of contents, become three dots between two spaces."""
    return F.regexp_replace(text, rf"[{SPACES}]*\.(?: *\.){{{LEADER - 1},}}[. ]*", " ... ")


def carries_on(before: Column, after: Column) -> Column:
    """Whether a paragraph goes on over a page break: it ends in no sign that finishes a sentence or closes a
    quote or bracket, and what follows starts in lower case or in a script that has no capitals and no spaces."""
    return ~before.rlike(f"[{FINISHED}][{SPACES}]*$") & after.rlike(rf"^[{SPACES}]*[\p{{Ll}}ªº{WIDE}{TIGHT}]")


def roman(number: Column) -> Column:
    """Lower-case roman numerals of the number modulo a million, a m for every thousand; empty below 1."""
    number = F.when(number >= 1, number % 1_000_000)
    tens = (
        (100, ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]),
        (10, ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]), (1, ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]),
    )
    digit = lambda scale: F.floor(number / scale) % 10
    parts = [F.element_at(F.array(*map(F.lit, marks)), (digit(scale) + 1).cast("int")) for scale, marks in tens]
    thousands = F.repeat(F.lit("m"), F.floor(number / 1000).cast("int"))
    return F.coalesce(F.concat(thousands, *parts), F.lit(""))


def letters(number: Column) -> Column:
    """a to z, then aa to zz and so on; empty below 1."""
    letter = F.char((F.lit(97) + (number - 1) % 26).cast("long"))
    return F.when(number >= 1, F.repeat(letter, (F.floor((number - 1) / 26) + 1).cast("int"))).otherwise("")
