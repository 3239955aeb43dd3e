"""Lines of a page as Column expressions: joining wrapped lines, counting words, telling folios and leaders.

The patterns are read alike by Java and RE2, so the SQL counterparts use the same
strings.
"""

from __future__ import annotations

import re
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paginarium.functions.arrays import let

# White space of Unicode; scripts written without spaces (East Asian wide
# characters but Hangul, then Thai and Lao, Myanmar, Khmer); signs that end a wrapped word.
SPACES = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WIDE = (
    r"\x{2E80}-\x{303E}\x{3041}-\x{312F}\x{3190}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{F900}-\x{FAFF}\x{FE10}-\x{FE19}"
    r"\x{FE30}-\x{FE6F}\x{FF01}-\x{FF60}\x{FF61}-\x{FF9F}\x{FFE0}-\x{FFE6}\x{16FE0}-\x{18AFF}\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFD}"
)
TIGHT = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{19E0}-\x{19FF}"
HYPHENS = r"\-\x{2010}\x{AD}"
#: Dots of the leader in an entry of a table of contents, at least.
LEADER = 5

LAST_WORD = f"([^{SPACES}]*)$"
TRAILING, LEADING = f"[{SPACES}]+$", f"^[{SPACES}]+"
WRAPPED, GOES_ON = rf"\p{{L}}[{HYPHENS}]$", r"^[\p{L}\p{N}]"
COMPOUND_END, COMPOUND_START, CAPITAL = f"[{HYPHENS}][^{SPACES}]*$", f"^[^{SPACES}]*[{HYPHENS}]", r"^[\p{Lu}\p{N}]"
VANISHING = ((r"\x{200B}$", ""), ("", r"^\x{200B}"), (f"[{WIDE}]$", f"^[{WIDE}]"), (f"[{TIGHT}]$", f"^[{TIGHT}]"))
FOLIO_WORD = r"(?is)^(?:[!-@\[-`{-~]+|page|of|www\..*|.*://.*|.*\.(?:com|org|net|edu|gov|io)(?:/.*)?)$"
FOLIO_LINE = f"^[{SPACES}]*(?:(?i:{FOLIO_WORD[6:-2].replace('.*', f'[^{SPACES}]*')}))(?:[{SPACES}]+|$))+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, TRAILING, ""), LEADING, "")


def pieces(text: Column) -> Column:
    """The runs of a text between white space of any kind."""
    return F.filter(F.split(text, f"[{SPACES}]+", -1), lambda x: x != "")


def _python(pattern: str) -> str:
    """A pattern as Python writes it."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U" + m[1].rjust(8, "0"), pattern)


WHITE_SIGNS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{_python(SPACES)}]", c))
HYPHEN_SIGNS = "-\u2010\xad"
WORD_TURNED, FIRST_WORD, WIDE_SIGN, TIGHT_SIGN = (re.compile(_python(p)) for p in (f"[^{SPACES}]*", f"[^{SPACES}]*", f"[{WIDE}]", f"[{TIGHT}]"))


def _join_two(word: str, line: str) -> str:
    """A line joined onto the last word of a text across a line break; neither has white space at the break."""
    if not word or not line:
        return word + " " if word and not word.endswith("\u200b") else word + line
    end, start = word[-1], line[0]
    if end in HYPHEN_SIGNS and word[-2:-1].isalpha() and category(start)[0] in "LN":
        # the hyphen is the word's own in a compound, before a capital or a digit
        own = category(start) == "Lu" or category(start)[0] == "N" or any(h in word[:-1] for h in HYPHEN_SIGNS) or any(h in FIRST_WORD.match(line)[0] for h in HYPHEN_SIGNS)
        return word[:-1] + "-" * own + line
    if end == "\u200b" or start == "\u200b" or (WIDE_SIGN.match(end) and WIDE_SIGN.match(start)) or (TIGHT_SIGN.match(end) and TIGHT_SIGN.match(start)):
        return word + line
    return f"{word} {line}"


def _joined(lines: list[str]) -> str:
    done, last = [], ""
    for line in lines:
        both = _join_two(last, line.strip(WHITE_SIGNS))
        word = WORD_TURNED.match(both[::-1]).end()
        done.append(both[: len(both) - word])
        last = both[len(both) - word :]
    return "".join(done) + last + (lines[-1][len(lines[-1].rstrip(WHITE_SIGNS)) :] if lines else "")


def joined_each(paragraphs: Column) -> Column:
    """Each paragraph, an array of lines, as one text. Not for use within a lambda: an Arrow function joins the lines of a batch of rows.

    How a line joins depends on the last word before it alone; what comes before that word
    is kept in pieces and put together once.
    """

    def found(paragraphs: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [None if lines is None else _joined(lines) for lines in row] for row in paragraphs.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(found, "array<string>")(paragraphs)


def joined(lines: Column) -> Column:
    """All lines of a paragraph as one text (see ``joined_each``)."""
    return F.get(joined_each(F.array(lines)), F.lit(0))


def word_count(text: Column) -> Column:
    """Words; two characters of a script without spaces count as one."""

    def of(piece: Column) -> Column:
        rest = F.regexp_replace(piece, f"[{WIDE}{TIGHT}]", "")
        tight = F.length(piece) - F.length(rest)
        return F.greatest(F.ceil(tight / 2).cast("int"), F.when((tight == 0) | rest.rlike(r"[\p{L}\p{N}]"), 1).otherwise(0))

    plain = F.size(pieces(text))
    return F.when(text.rlike(f"[{WIDE}{TIGHT}]"), F.aggregate(pieces(text), F.lit(0), lambda n, piece: n + of(piece))).otherwise(plain)


def is_folio(line: Column) -> Column:
    """Page numbers, addresses, marks and the words "page" and "of" alone."""
    return line.rlike(FOLIO_LINE)


def is_leader_entry(line: Column) -> Column:
    """Whether a run of dots and spaces with enough dots leads to the line's last word."""
    run = F.regexp_extract(F.regexp_replace(line, TRAILING, ""), r"([. ]*)[^. ]*$", 1)
    return F.length(F.replace(run, F.lit(" "), F.lit(""))) >= LEADER


def lead_in(text: Column) -> Column:
    """(lead, rest) of a paragraph that opens in bold; null where it doesn't."""
    pattern = r"(?s)^\*\*(.+?)\*\*(.*)$"
    found = F.struct(F.regexp_extract(text, pattern, 1).alias("lead"), F.regexp_extract(text, pattern, 2).alias("rest"))
    return F.when(text.rlike(pattern) & ~text.startswith("****"), found)


def escaped(text: Column) -> Column:
    """Markup marks escaped, at a line's start also those that would open a heading, quote or list."""
    return F.regexp_replace(F.regexp_replace(text, r"([*_`\[\]\\])", r"\\$1"), r"(^|\n)([#>+\-]|\\\*)", r"$1\\$2")


def table_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(escaped(stripped(text)), F.lit("|"), F.lit("\\|")), r"[\r\n]", " ")


def collapsed(text: Column) -> Column:
    """Runs of spaces as one."""
    return F.regexp_replace(text, " +", " ")


def folded_spaces(text: Column) -> Column:
    """No-break and typographic spaces as plain ones."""
    return F.regexp_replace(text, r"[\x{A0}\x{2000}-\x{200A}\x{202F}]", " ")


def simple_lower(text: Column) -> Column:
    """Lower case one character for one: no dotted i in two parts, no final sigma."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def is_alpha(character: Column) -> Column:
    return character.rlike(r"^\p{L}$")


def is_alnum(character: Column) -> Column:
    return character.rlike(r"^[\p{L}\p{Nd}]$")


# --- needles ---------------------------------------------------------------------------

# Characters that stay together in a needle (Latin-1 below 255, Arabic, Cyrillic,
# the script l, general punctuation).
TOGETHER = r"\x{0}-\x{FE}\x{600}-\x{6FF}\x{FE70}-\x{FEFF}\x{FB50}-\x{FDFF}\x{400}-\x{52F}\x{A640}-\x{A69F}\x{2DE0}-\x{2DFF}\x{2113}\x{2000}-\x{206F}"


def splits_needle(character: Column) -> Column:
    """Whether a needle is cut around the character."""
    return character.rlike(f"^[^{TOGETHER}]$")


def split_needle(needle: Column) -> Column:
    """What a hit must find in order: runs between spaces, cut around characters of scripts without
    spaces. A needle of spaces alone stays whole; a space at either end leaves an empty part."""
    parts = F.transform(
        F.split(needle, " +", -1), lambda w: F.when(w == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(w, F.lit(f"([^{TOGETHER}]|[{TOGETHER}]+)")))
    )
    return F.when(needle.rlike("^ *$"), F.array(needle)).otherwise(F.flatten(parts))


# --- addresses -------------------------------------------------------------------------

OPENERS = {"(": ")", "[": "]", "{": "}", "<": ">", '"': '"', "'": "'"}
#: What can't end a host name; a sign outside ASCII stays.
NO_HOST_END = r"[\x00-\x2D\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"
BRACKETED = r"^(\[[^\]]+\](?::[0-9]+)?|\[\])"


def candidates(text: Column) -> Column:
    """What may be an address: more than five characters between spaces and line ends, closed without
    sentence marks. A hyphen before a line end joins the halves."""
    joined_halves = F.regexp_replace(F.replace(text, F.lit("\u00ad"), F.lit("-")), r"-[\r\n]+", "-")
    cut = F.transform(F.split(joined_halves, r"[ \r\n]", -1), lambda c: F.when(F.length(c) > 5, F.regexp_replace(c, r"[),>.]+$", "")))
    return F.filter(cut, lambda c: F.length(c) > 5)


def web_address(candidate: Column) -> Column:
    """The address in a candidate, ``http://`` put before a bare ``www.``; null without one."""

    def found(start: Column, after: Column, host: Column) -> Column:
        # ``start``: where the address begins, ``after``: where something must follow, ``host``: where its host begins (from 1)
        head = F.substring(candidate, F.lit(1), start - 1)
        openers = F.create_map(*[F.lit(x) for pair in OPENERS.items() for x in pair])
        opened = F.filter(F.transform(F.split(head, ""), lambda c: F.try_element_at(openers, c)), lambda c: c.isNotNull())
        # each bracket or quote opened before the address cuts it at its last closing one
        kept = F.aggregate(
            opened, F.substring(candidate, start, F.length(candidate)),
            lambda k, c: F.when(k.contains(c), F.substring(k, F.lit(1), F.length(k) - F.instr(F.reverse(k), c))).otherwise(k),
        )
        tail = F.substring(candidate, host, F.length(candidate))
        bracketed = F.regexp_extract(tail, BRACKETED, 1)
        trimmed = F.regexp_replace(kept, NO_HOST_END, "")
        end = (
            F.when(tail.contains("/"), kept)
            .when(tail.startswith("["), F.when(bracketed != "", F.concat(F.substring(candidate, start, host - start), bracketed)).otherwise(kept))
            .when(F.length(trimmed) > host - start, trimmed).otherwise(F.substring(kept, F.lit(1), host - start + 1))
        )
        return F.when(F.length(end) > after - start + 1, end)

    low = simple_lower(candidate)
    scheme, bare = F.locate("http", low), F.locate("www.", low)
    secure = F.when(F.substring(low, scheme + 4, F.lit(1)) == "s", 1).otherwise(0)
    host = scheme + 7 + secure
    with_scheme = F.when((scheme > 0) & (F.length(low) > scheme + 7) & (F.substring(low, scheme + 4 + secure, F.lit(3)) == "://"), found(scheme, host, host))
    without = F.when((bare > 0) & (F.length(low) > bare + 3), found(bare, bare + 4, bare))
    return F.coalesce(with_scheme, F.concat(F.lit("http://"), without))
