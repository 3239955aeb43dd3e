"""Text strings and names as bytes and back, as Column expressions: byte orders, the document encoding, escapes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of the document encoding at 18 to 1F, at 80 to 9E and at A0; 7F, 9F and AD have none,
# all other bytes stand for the character of their own number.
LOW, HIGH, AT_A0 = "˘ˇˆ˙˝˛˚˜", "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", "€"
MARKED = LOW + HIGH + AT_A0
BYTES = "".join(map(chr, [*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0]))
WITHOUT = "\x7f\x9f\xad"
#: Bytes of a name that are written as ``#`` and two digits.
IS_ESCAPED = np.isin(np.arange(256), [*range(0x80, 0x100), *b"\x00\t\n\f\r #%()/<>[]{}"])
DIGITS = "0123456789ABCDEF"


def latin(data: Column) -> Column:
    """Bytes as characters of the same numbers."""
    return F.decode(data, "ISO-8859-1")


def text_bytes(text: Column) -> Column:
    """A text as bytes: the document encoding where it has every character, else a mark and UTF-16, high byte first."""
    known = text.rlike(rf"(?s)^[\x00-\x17\x20-\x7E\x{{A1}}-\x{{AC}}\x{{AE}}-\x{{FF}}{MARKED}]*+$(?![\n\r])")
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    return F.when(known, F.encode(F.translate(text, MARKED, BYTES), "ISO-8859-1")).otherwise(wide)


def utf16_text(digits: Column) -> Column:
    """The text of UTF-16 units spelled in hexadecimal digits, high byte first; halves without their other half become U+FFFD."""
    units = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - F.length(digits) % 4), "(.{4})", "$1 ")
    paired = F.regexp_replace(F.regexp_replace(units, "(?<!D[89AB].. )D[C-F].. ", "FFFD "), "D[89AB].. (?!D[C-F])", "FFFD ")
    return F.decode(F.unhex(F.replace(paired, F.lit(" "), F.lit(""))), "UTF-16BE")


def bytes_text(data: Column) -> Column:
    """The text of a text string's bytes.

    ``FE FF`` and ``FF FE`` mark UTF-16, ``EF BB BF`` marks UTF-8; broken pieces become U+FFFD, an odd last byte
    goes, and language codes between two escape characters (or from one to the end) are left out. Without a
    mark a byte is a character of the document encoding, and bytes that have none read as U+0000.
    """
    spelled = F.hex(data)
    rest = lambda n: F.substring(spelled, F.lit(n + 1), F.length(spelled))
    spoken = lambda text: F.regexp_replace(text, r"\x1B[^\x1B]*+(?:\x1B|\z)", "")
    swapped = F.regexp_replace(rest(4), "(..)(..)", "$2$1")
    # an odd last byte is a pair of digits left over: cut before the halves are swapped back
    plain = F.regexp_replace(F.translate(latin(data), BYTES, MARKED), f"[{WITHOUT}]", "\x00")
    return (
        F.when(spelled.startswith("FEFF"), spoken(utf16_text(rest(4)))).when(spelled.startswith("FFFE"), spoken(utf16_text(swapped)))
        .when(spelled.startswith("EFBBBF"), spoken(F.make_valid_utf8(F.unhex(rest(6)).cast("string")))).otherwise(plain)
    )


def literal_string(data: Column) -> Column:
    """Bytes between round brackets, as characters of the same numbers: line ends, brackets and backslashes are escaped."""
    marked = F.regexp_replace(latin(data), r"([()\\])", r"\\$1")
    return F.concat(F.lit("("), F.replace(F.replace(marked, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit(")"))


def hex_string(data: Column) -> Column:
    return F.concat(F.lit("<"), F.hex(data), F.lit(">"))


def name_spelled(data: Column) -> Column:
    """A name's bytes as written in a file: what is no plain character becomes ``#`` and two digits."""

    def found(data: pa.Array) -> pa.Array:
        given = [d or b"" for d in data.to_pylist()]
        sizes = np.fromiter(map(len, given), np.int64, len(given))
        own = np.frombuffer(b"".join(given), np.uint8)
        escaped = IS_ESCAPED[own]
        at = np.concatenate([[0], np.cumsum(1 + 2 * escaped.astype(np.int64))])  # where each byte is written
        out = np.empty(at[-1], np.uint8)
        out[at[:-1]] = np.where(escaped, ord("#"), own)
        begin, codes, digits = at[:-1][escaped], own[escaped], np.frombuffer(DIGITS.encode(), np.uint8)
        out[begin + 1], out[begin + 2] = digits[codes >> 4], digits[codes & 15]
        ends = at[np.concatenate([[0], np.cumsum(sizes)])]
        whole = out.tobytes()
        return pa.array([None if d is None else whole[a:b] for d, a, b in zip(data.to_pylist(), ends[:-1].tolist(), ends[1:].tolist())], pa.binary()).cast(pa.string())

    return F.arrow_udf(found, "string")(data)


def name_bytes(spelled: Column) -> Column:
    """The bytes of a written name (characters of the same numbers): a ``#`` takes the next two characters as digits,
    others than digits count as 0; without two characters after it, it stands for itself."""

    def value(pair: re.Match) -> str:
        high, low = (max(DIGITS.find(c.upper()), 0) for c in pair[1])
        return chr(high * 16 + low)

    def found(spelled: pa.Array) -> pa.Array:
        return pa.array([None if s is None else re.sub("(?s)#(..)", value, s) for s in spelled.to_pylist()], pa.string())

    return F.encode(F.arrow_udf(found, "string")(spelled), "ISO-8859-1")
