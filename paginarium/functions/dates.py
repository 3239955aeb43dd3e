"""Dates of documents and form fields as Column expressions.

An instant is milliseconds since 1970 in UTC, as a long. Pattern letters: ``m`` month,
``d`` day, ``y`` year, ``H`` and ``h`` hour of 24 and of 12, ``M`` minute, ``s`` second,
``t`` half of the day; a letter's number of repeats says how it is written.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paginarium.functions.arrays import let

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
DAY = 86_400_000
LETTERS = re.compile(r"(y+|m+|d+|H+|h+|M+|s+|t+)")


def floor_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def is_leap_year(year: Column) -> Column:
    return (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))


def instant(timestamp: Column) -> Column:
    """The milliseconds of a timestamp's civil time, whatever the session's time zone."""
    second = F.floor(F.date_part(F.lit("SECOND"), timestamp) * 1000).cast("long")
    return F.unix_date(timestamp.cast("date")).cast("long") * DAY + (F.hour(timestamp).cast("long") * 60 + F.minute(timestamp)) * 60_000 + second


def day_number(ms: Column) -> Column:
    return floor_div(ms, DAY).cast("int")


def date_of(ms: Column) -> Column:
    return F.date_from_unix_date(day_number(ms))


def parts(ms: Column) -> dict[str, Column]:
    """year, month, day, weekday (Sunday is 0), hour, minute, second."""
    day, within = date_of(ms), F.pmod(ms, F.lit(DAY))
    return {
        "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day), "weekday": F.dayofweek(day) - 1,
        "hour": floor_div(within, 3_600_000).cast("int"), "minute": (floor_div(within, 60_000) % 60).cast("int"), "second": (floor_div(within, 1000) % 60).cast("int"),
    }


def make_day(year: Column, month: Column, day: Column) -> Column:
    """The day number of a civil date; months outside 1 to 12 and days outside the month carry over."""
    months = year.cast("long") * 12 + month - 1
    first = F.make_date(floor_div(months, 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.unix_date(first).cast("long") + day - 1


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    return ((hour.cast("long") * 60 + minute) * 60 + second) * 1000


def make_date(day: Column, time: Column) -> Column:
    return day.cast("long") * DAY + time


def expand_year(year: Column) -> Column:
    """Below 50 this century, from 50 to 99 the last one; others as they are."""
    return F.when(year.between(0, 49), year + 2000).when(year.between(50, 99), year + 1900).otherwise(year)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _four(n: Column) -> Column:
    return F.lpad(n.cast("string"), 4, "0")


def _name(names: tuple[str, ...], at: Column, size: int | None = None) -> Column:
    return F.element_at(F.array(*[F.lit(n[:size]) for n in names]), at)


def twelve(hour: Column) -> Column:
    return F.pmod(hour + 11, F.lit(12)) + 1


def printed(ms: Column, pattern: str) -> Column:
    """An instant written by a pattern; letters in unknown numbers stand for themselves."""
    p = parts(ms)
    half = F.when(p["hour"] >= 12, "p").otherwise("a")
    plain = {"m": p["month"], "d": p["day"], "H": p["hour"], "h": twelve(p["hour"]), "M": p["minute"], "s": p["second"]}
    out = []
    for piece in LETTERS.split(pattern):
        c = piece[:1]
        if not LETTERS.fullmatch(piece) or not piece:
            out.append(F.lit(piece))
            continue
        while len(piece) > 4:  # of a longer run the first letters stand for themselves
            out.append(F.lit(c))
            piece = piece[1:]
        n = len(piece)
        if n <= 2 and c in plain:
            out.append(plain[c].cast("string") if n == 1 else _two(plain[c]))
        elif c == "t" and n <= 2:
            out.append(half if n == 1 else F.concat(half, F.lit("m")))
        elif c == "y" and n in (2, 4):
            out.append(_two(p["year"] % 100) if n == 2 else _four(p["year"]))
        elif c == "m" and n in (3, 4):
            out.append(_name(MONTHS, p["month"], 3 if n == 3 else None))
        else:
            out.append(F.lit(piece))
    return F.concat(*out)


def printd(ms: Column, style: int | str) -> Column:
    """Styles 0, 1 and 2 of ``util.printd``; a pattern may also have ``dddd`` and ``ddd`` for weekdays."""
    if isinstance(style, int):
        pattern = {0: "D:yyyymmddHHMMss", 1: "yyyy.mm.dd HH:MM:ss", 2: "yyyy/mm/dd HH:MM:ss"}[style]
        return printed(ms, pattern)
    out, weekday = [], parts(ms)["weekday"] + 1
    for piece in re.split("(d+)", style.replace("%", "")):
        out.append(_name(WEEKDAYS, weekday, 3 if len(piece) == 3 else None) if piece in ("ddd", "dddd") else printed(ms, piece) if piece else F.lit(""))
    return F.concat(*out)


def pdf_date(ms: Column) -> Column:
    return F.concat(printed(ms, "D:yyyymmddHHMMss"), F.lit("Z00'00'"))


def pdf_date_to_iso(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSSOHH'mm'`` as ISO 8601, as far as it goes; unchanged below a four-digit year."""
    body = F.regexp_replace(text, "^(?:D:)+", "")
    digits = F.regexp_extract(body, "^([0-9]*)", 1)
    at = lambda first, n: F.substring(digits, first + 1, n)
    size = F.length(digits)
    rest = F.substring(body, size + 1, F.length(body))
    zone = F.regexp_replace(rest, "[^0-9]", "")
    offset = F.when(rest.rlike(r"^[+\-]") & (F.length(zone) >= 4), F.concat(F.substring(rest, 1, 1), F.substring(zone, 1, 2), F.lit(":"), F.substring(zone, 3, 2))).otherwise("Z")
    seconds = F.when(size >= 14, at(12, 2)).otherwise("00")
    day = F.concat(at(0, 4), F.lit("-"), at(4, 2), F.lit("-"), at(6, 2))
    return (
        F.when(size < 4, text).when(size < 6, at(0, 4)).when(size < 8, F.concat(at(0, 4), F.lit("-"), at(4, 2)))
        .when(size < 12, day).otherwise(F.concat(day, F.lit("T"), at(8, 2), F.lit(":"), at(10, 2), F.lit(":"), seconds, offset))
    )


def scanned(text: Column, pattern: str, now: int) -> Column:
    """The instant a text gives by a pattern, missing parts from ``now``; null where it doesn't fit.

    Numbers may have fewer digits than letters; ``mmm`` and ``mmmm`` also take names;
    marks between the parts match any sign; an empty text is ``now``.
    """
    expression, fields = _expression(pattern)
    return _instant_of(text, expression, fields, now)


def guessed(text: Column, now: int) -> Column:
    """The instant that a text's first two or three numbers (of up to four digits) give, the rest from ``now``.

    Two are month and day, or day and month where only that fits. Three are year, month and day
    (the first beyond 12), or month, day and year, or day, month and year (the last beyond 31).
    Numbers that fit no order leave ``now``; a day beyond its month runs over into the next;
    null with fewer than two numbers.
    """
    start = dates_at(now)
    kept = [F.lit(start[k]) for k in ("year", "month", "day")]
    month, day = (lambda n: n.between(1, 12)), (lambda n: n.between(1, 31))

    def of(g: Column) -> Column:
        a, b, c = (F.get(g, F.lit(k)) for k in range(3))
        orders = [
            ((F.size(g) == 2) & month(a) & day(b), (kept[0], a, b)), ((F.size(g) == 2) & day(a) & month(b), (kept[0], b, a)),
            ((F.size(g) > 2) & (a > 12) & month(b) & day(c), (a, b, c)), ((F.size(g) > 2) & month(a) & day(b) & (c > 31), (c, a, b)), ((F.size(g) > 2) & day(a) & month(b) & (c > 31), (c, b, a)),
        ]
        found = F.struct(*[k.alias(n) for k, n in zip(kept, "ymd")])
        for fits, ymd in reversed(orders):
            found = F.when(fits, F.struct(*[v.alias(n) for v, n in zip(ymd, "ymd")])).otherwise(found)
        time = make_time(F.lit(start["hour"]), F.lit(start["minute"]), F.lit(start["second"]))
        return F.when(F.size(g) > 1, let(found, lambda d: make_date(make_day(d["y"], d["m"], d["d"]), time)))

    return let(F.transform(F.regexp_extract_all(text, F.lit("([0-9]{1,4})")), lambda x: x.cast("int")), of)


def parsed(text: Column, pattern: str, now: int) -> Column:
    """The instant a text gives by a pattern, or else by its numbers alone; null where neither fits."""
    return F.coalesce(scanned(text, pattern, now), guessed(text, now))


def _expression(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    expression, fields = "", []
    for piece in LETTERS.split(pattern):
        if not piece:
            continue
        if LETTERS.fullmatch(piece):
            c, n = piece[0], len(piece)
            if c == "t":
                expression += "(p?a?m?)" if n == 2 else "(.)"
            elif c == "m" and n == 3:
                expression += "([A-Za-z]{3}|[0-9]{1,3})"
            elif c == "m" and n == 4:
                expression += "([A-Za-z]{1,9}|[0-9]{1,4})"
            elif c == "y" and n == 1:
                expression += "(.)"
            else:
                expression += "([0-9]{1,%d})" % (4 if n >= 4 else 2)
            fields.append((c, n))
        else:
            expression += "".join("." if x in ":.-\\/" else re.escape(x) for x in piece)
    return "(?s)^" + expression, fields


def _instant_of(text: Column, expression: str, fields: list[tuple[str, int]], now: int) -> Column:
    """Texts of the fields first, then their numbers, then the instant: each is worked out once."""
    raw = F.struct(text.rlike(expression).alias("fits"), *[F.regexp_extract(text, expression, k + 1).alias(f"part_{k}") for k in range(len(fields))])
    width, at = dict(fields), {c: f"part_{k}" for k, (c, _) in enumerate(fields)}
    start = dates_at(now)

    def numbers(r: Column) -> Column:
        def number(c: str, name: str) -> Column:
            return F.coalesce(r[at[c]].try_cast("int"), F.lit(-1)) if c in width else F.lit(start[name])

        year = expand_year(number("y", "year")) if width.get("y", 0) > 1 else F.lit(start["year"])
        month = number("m", "month")
        if width.get("m", 0) >= 3:
            name = F.lower(r[at["m"]])
            names = F.array(*[F.lit(m.lower()[: 3 if width["m"] == 3 else None]) for m in MONTHS])
            fits = F.transform(names, lambda full, k: F.when(F.contains(full, name) if width["m"] > 3 else full == name, k + 1))
            month = F.when(name != "", F.coalesce(F.array_min(fits), month)).otherwise(month)
        hour = number("H", "hour") if "H" in width else number("h", "hour")
        if "t" in width:
            hour = hour + F.when(r[at["t"]] == ("pm" if width["t"] == 2 else "p"), 12).otherwise(0)
        return F.struct(
            r["fits"].alias("fits"), year.alias("year"), month.alias("month"), number("d", "day").alias("day"),
            hour.alias("hour"), number("M", "minute").alias("minute"), number("s", "second").alias("second"),
        )

    def whole(n: Column) -> Column:
        sound = n["fits"] & n["month"].between(1, 12) & n["day"].between(1, 31) & n["hour"].between(0, 24) & n["minute"].between(0, 60) & n["second"].between(0, 60)
        return F.when(sound, make_date(make_day(n["year"], n["month"], n["day"]), make_time(n["hour"], n["minute"], n["second"])))

    return F.when(text == "", F.lit(now).cast("long")).otherwise(let(raw, lambda r: let(numbers(r), whole)))


def dates_at(now: int) -> dict[str, int]:
    """The civil parts of an instant that is at hand when the plan is made."""
    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=now)
    return {k: getattr(at, k) for k in ("year", "month", "day", "hour", "minute", "second")}
