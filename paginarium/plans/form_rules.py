"""Queries on masks, dates and numbers of form fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paginarium.functions import dates, masks, numbers
from paginarium.plans.registry import query, table
from paginarium.plans.text_rules import literal_rows, quoted, with_literals

# --- masks -------------------------------------------------------------------------------

MASKS = ("(999) 999-9999", ">AAA-999", "<*", "?XX\\9*", "=X<X>X", "99/99")
SOURCES = ["555 867 5309", "ab1c2", "x", "", "Größe 7b9", "a\nb\nc1"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def printx_sql(mask: str, source: str) -> str:
    out, rest = [], source
    fold = {"": "{}", "lower": f"translate({{}}, '{UPPER}', '{LOWER}')", "upper": f"translate({{}}, '{LOWER}', '{UPPER}')"}
    for kind, what, case in masks.mask_parts(mask):
        if kind == "literal":
            out.append(quoted(what))
        elif what == "*":
            out.append(fold[case].format(rest))
            rest = "''"
        elif what == "?":
            out.append(fold[case].format(f"substr({rest}, 1, 1)"))
            rest = f"substr({rest}, 2)"
        else:
            taken = masks.TAKES[what]
            out.append(fold[case if what != "9" else ""].format(f"regexp_extract({rest}, '^[^{taken}]*([{taken}])', 1)"))
            rest = f"regexp_replace({rest}, '^[^{taken}]*[{taken}]?', '')"
    return " || ".join(out)


@query(
    "printx_masks",
    f"WITH s AS (SELECT c_custkey, c_name FROM customer UNION ALL {literal_rows(SOURCES, 'c_custkey', 'c_name')}) "
    f"SELECT c_custkey, {', '.join(f'{printx_sql(m, chr(99) + '_name')} AS mask_{k}' for k, m in enumerate(MASKS))} FROM s",
)
def printx_masks(spark, sf_dir):
    rows = with_literals(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), SOURCES)
    return rows.select("c_custkey", *[masks.printx(m, F.col("c_name")).alias(f"mask_{k}") for k, m in enumerate(MASKS)])


SIGNS = {"nine": "9", "letter": "A", "either": "O", "any": "X", "hyphen": "-"}


@query(
    "mask_signs",
    "WITH c AS (SELECT unnest(regexp_extract_all(p_name || p_brand || '-' || p_type, '(?s).')) AS c FROM part) SELECT c, count(*) AS n, "
    + ", ".join(f"regexp_matches(c, '^{masks.ACCEPTS[m]}$') AS {k}" if m in masks.ACCEPTS else f"c = '{m}' AS {k}" for k, m in SIGNS.items()) + " FROM c GROUP BY c",
)
def mask_signs(spark, sf_dir):
    text = F.concat("p_name", "p_brand", F.lit("-"), "p_type")
    counted = table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(text, F.lit("((?s).)"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("c", "n", *[masks.mask_satisfied(F.col("c"), m).alias(k) for k, m in SIGNS.items()])


LISTS = ["", "a,", "a, b ,c", ",", " a ,, b"]


@query(
    "field_lists",
    f"WITH l AS (SELECT p_partkey, replace(p_type, ' ', ' , ') AS names FROM part UNION ALL {literal_rows(LISTS, 'p_partkey', 'names')}), s AS (SELECT *, string_split(names, ',') AS a FROM l) "
    "SELECT p_partkey, array_to_string(list_transform(CASE WHEN a[-1] = '' THEN list_slice(a, 1, len(a) - 1) ELSE a END, lambda x: trim(x, ' ')), '|') AS fields, "
    "len(CASE WHEN a[-1] = '' THEN list_slice(a, 1, len(a) - 1) ELSE a END) AS n FROM s",
)
def field_lists(spark, sf_dir):
    rows = with_literals(table(spark, sf_dir, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit(" , ")).alias("names")), LISTS)
    fields = masks.split_fields(F.col("names"))
    return rows.select("p_partkey", F.array_join(fields, "|").alias("fields"), F.size(fields).cast("long").alias("n"))


@query(
    "printf_values",
    "SELECT c_custkey, printf('%d|%5d|%-6d|%06d', CAST(c_custkey AS INTEGER), CAST(c_custkey AS INTEGER), CAST(c_custkey AS INTEGER), CAST(c_custkey AS INTEGER)) AS whole, "
    "printf('%x-%X-%o', CAST(c_custkey AS INTEGER), CAST(c_custkey * 77 AS INTEGER), CAST(c_custkey AS INTEGER)) AS bases, printf('[%-20s][%.4s]', c_name, c_mktsegment) AS words, "
    "CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END || printf('%.2f', abs(c_acctbal)) AS signed, "
    "CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || replace(replace(replace(format('{:,.1f}', abs(c_acctbal)), ',', '_'), '.', ','), '_', '.') AS european, "
    "CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || replace(printf('%.2f', abs(c_acctbal)), '.', ',') AS plain FROM customer",
)
def printf_values(spark, sf_dir):
    key, name, part, money = (F.col(c) for c in ("c_custkey", "c_name", "c_mktsegment", "c_acctbal"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", masks.printf("%d|%5d|%-6d|%06d", key, key, key, key).alias("whole"), masks.printf("%x-%X-%o", key, key * 77, key).alias("bases"),
        masks.printf("[%-20s][%.4s]", name, part).alias("words"), masks.printf("%+.2f", money).alias("signed"), masks.printf("%,2.1f", money).alias("european"), masks.printf("%,3.2f", money).alias("plain"),
    )


# --- dates ---------------------------------------------------------------------------------

MS = "epoch_ms(ts)"


def events_ms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.instant(F.col("ts")).alias("ms"))


@query(
    "date_parts_of_ms",
    f"SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, dayofweek(ts) AS weekday, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, "
    f"(year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0)) AS leap, CAST(floor({MS} / 86400000) AS INTEGER) AS day_number FROM events",
)
def date_parts_of_ms(spark, sf_dir):
    p = dates.parts(F.col("ms"))
    return events_ms(spark, sf_dir).select("event_id", *[c.cast("long").alias(k) for k, c in p.items()], dates.is_leap_year(p["year"]).alias("leap"), dates.day_number(F.col("ms")).alias("day_number"))


@query(
    "made_dates",
    "SELECT o_orderkey, datediff('day', DATE '1970-01-01', CAST(make_date(CAST(year(o_orderdate) AS BIGINT), 1, 1) + to_months(CAST(o_orderkey % 30 - 6 AS INTEGER)) AS DATE)) + o_custkey % 50 AS day, "
    "((o_orderkey % 30 * 60 + 75) * 60 + o_custkey % 100) * 1000 AS time, epoch_ms(date_trunc('day', o_orderdate)) + ((hour(o_orderdate) * 60 + 5) * 60 + 7) * 1000 AS ms, "
    "CASE WHEN o_orderkey % 120 < 50 THEN o_orderkey % 120 + 2000 WHEN o_orderkey % 120 < 100 THEN o_orderkey % 120 + 1900 ELSE o_orderkey % 120 END AS year FROM orders",
)
def made_dates(spark, sf_dir):
    at, key = F.col("o_orderdate"), F.col("o_orderkey")
    day = dates.make_day(F.year(at), F.lit(1) + key % 30 - 6, F.lit(1) + F.col("o_custkey") % 50)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", day.alias("day"), dates.make_time(key % 30, F.lit(75), F.col("o_custkey") % 100).alias("time"),
        dates.make_date(dates.make_day(F.year(at), F.month(at), F.dayofmonth(at)), dates.make_time(F.hour(at), F.lit(5), F.lit(7))).alias("ms"),
        dates.expand_year(key % 120).alias("year"),
    )


HOUR12 = "(hour(ts) + 11) % 12 + 1"


@query(
    "printed_dates",
    f"SELECT event_id, strftime(ts, '%m/%d/%Y') AS us, CAST(month(ts) AS VARCHAR) || '/' || CAST(day(ts) AS VARCHAR) || '/' || strftime(ts, '%y') AS short, "
    f"strftime(ts, '%B ') || CAST(day(ts) AS VARCHAR) || strftime(ts, ', %Y') AS long, CAST({HOUR12} AS VARCHAR) || strftime(ts, ':%M:%S ') || CASE WHEN hour(ts) >= 12 THEN 'pm' ELSE 'am' END AS time, "
    f"'yyy ' || strftime(ts, '%b') || ' ddd y' AS odd, strftime(ts, 'D:%Y%m%d%H%M%S') || 'Z00''00''' AS pdf, strftime(ts, '%Y.%m.%d %H:%M:%S') AS style_1, strftime(ts, '%Y/%m/%d %H:%M:%S') AS style_2, "
    f"strftime(ts, '%A, %b %d') AS weekday FROM events",
)
def printed_dates(spark, sf_dir):
    ms = F.col("ms")
    return events_ms(spark, sf_dir).select(
        "event_id", dates.printed(ms, "mm/dd/yyyy").alias("us"), dates.printed(ms, "m/d/yy").alias("short"), dates.printed(ms, "mmmm d, yyyy").alias("long"),
        dates.printed(ms, "h:MM:ss tt").alias("time"), dates.printed(ms, "yyy mmm ddd y").alias("odd"), dates.pdf_date(ms).alias("pdf"),
        dates.printd(ms, 1).alias("style_1"), dates.printd(ms, 2).alias("style_2"), dates.printd(ms, "dddd, mmm dd").alias("weekday"),
    )


PDF_DATES = ["D:20231114221320Z00'00'", "D:199812231952-08'00'", "2001", "D:200102", "D:20010203", "D:2001020304", "no date", "D:D:20230101000000+05'30", "D:20230101000000+0", "D:12"]
ISO_DAY = "substr(g, 1, 4) || '-' || substr(g, 5, 2) || '-' || substr(g, 7, 2)"


@query(
    "pdf_dates_to_iso",
    f"WITH s AS (SELECT o_orderkey, strftime(o_orderdate, 'D:%Y%m%d%H%M%S') || CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+05''30''' ELSE '-08''00''' END AS text FROM orders UNION ALL {literal_rows(PDF_DATES, 'o_orderkey')}), "
    "b AS (SELECT *, regexp_replace(text, '^(?:D:)+', '') AS body FROM s), d AS (SELECT *, regexp_extract(body, '^([0-9]*)', 1) AS g FROM b), "
    "z AS (SELECT *, substr(body, length(g) + 1) AS rest FROM d), n AS (SELECT *, regexp_replace(rest, '[^0-9]', '', 'g') AS zone FROM z) "
    f"SELECT o_orderkey, CASE WHEN length(g) < 4 THEN text WHEN length(g) < 6 THEN substr(g, 1, 4) WHEN length(g) < 8 THEN substr(g, 1, 4) || '-' || substr(g, 5, 2) WHEN length(g) < 12 THEN {ISO_DAY} "
    f"ELSE {ISO_DAY} || 'T' || substr(g, 9, 2) || ':' || substr(g, 11, 2) || ':' || CASE WHEN length(g) >= 14 THEN substr(g, 13, 2) ELSE '00' END || "
    "CASE WHEN regexp_matches(rest, '^[+\\-]') AND length(zone) >= 4 THEN substr(rest, 1, 1) || substr(zone, 1, 2) || ':' || substr(zone, 3, 2) ELSE 'Z' END END AS iso FROM n",
)
def pdf_dates_to_iso(spark, sf_dir):
    zone = F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+05'30'").otherwise("-08'00'")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(dates.printed(dates.instant(F.col("o_orderdate")), "D:yyyymmddHHMMss"), zone).alias("text"))
    return with_literals(rows, PDF_DATES).select("o_orderkey", dates.pdf_date_to_iso(F.col("text")).alias("iso"))


NOW = 1_399_672_130_000  # 9 May 2014 21:48:50
WHEN = "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE"


@query(
    "scanned_dates",
    f"SELECT o_orderkey, {WHEN} strftime(o_orderdate, '%d/%m/%Y') END AS text, CASE WHEN o_orderkey % 10 = 0 THEN {NOW} ELSE epoch_ms(date_trunc('day', o_orderdate)) + ((21 * 60 + 48) * 60 + 50) * 1000 END AS day_first, "
    f"CASE WHEN o_orderkey % 10 = 0 THEN {NOW} ELSE epoch_ms(date_trunc('day', o_orderdate)) + ((17 * 60 + 9) * 60 + 5) * 1000 END AS named, "
    f"CASE WHEN o_orderkey % 10 = 0 THEN {NOW} WHEN day(o_orderdate) <= 12 THEN epoch_ms(make_date(CAST(year(o_orderdate) AS BIGINT), CAST(day(o_orderdate) AS BIGINT), CAST(month(o_orderdate) AS BIGINT))) + ((21 * 60 + 48) * 60 + 50) * 1000 ELSE -1 END AS month_first, "
    "CASE WHEN o_orderkey % 10 = 0 THEN 1399672130000 ELSE epoch_ms(date_trunc('day', o_orderdate)) + ((21 * 60 + 48) * 60 + 50) * 1000 END AS two_digits FROM orders",
)
def scanned_dates(spark, sf_dir):
    at = dates.instant(F.col("o_orderdate"))
    patterns = {"text": "dd/mm/yyyy", "short": "d/m/yyyy", "words": "mmmm d, yyyy", "two": "yy.mm.dd"}
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 10 == 0).alias("blank"))
    written = [F.when(F.col("blank"), "").otherwise(dates.printed(at, p)).alias(k) for k, p in patterns.items()]
    scan = lambda column, pattern: F.coalesce(dates.scanned(F.col(column), pattern, NOW), F.lit(-1))
    # orders share their dates: each is written and scanned once, and meets its orders by an equi-join
    each = orders.select("o_orderdate", "blank").distinct()
    rows = each.select(F.col("o_orderdate").alias("_date"), F.col("blank").alias("_blank"), *written)
    rows = rows.withColumn("words", F.when(F.col("words") == "", "").otherwise(F.concat("words", F.lit(" 5:09:05 pm"))))
    scanned = rows.select(
        "_date", "_blank", "text", scan("short", "dd/mm/yyyy").alias("day_first"), scan("words", "mmmm d, yyyy h:MM:ss tt").alias("named"),
        scan("text", "mm/dd/yyyy").alias("month_first"), scan("two", "yy-mm-dd").alias("two_digits"),
    )
    met = orders.join(scanned, F.col("o_orderdate").eqNullSafe(F.col("_date")) & F.col("blank").eqNullSafe(F.col("_blank")))
    return met.select("o_orderkey", "text", "day_first", "named", "month_first", "two_digits")


# --- numbers --------------------------------------------------------------------------------

NUMBERS = ["12abc", " -3.5e2x", "+.5", "1e", "0x1F", "0xFFFFFFFF", "Infinity", "-Infinity", "NaN", "1.", "1.5.2", "", "  7  ", "- 1", "e5"]


@query(
    "read_numbers",
    f"WITH s AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE '.25' END AS text FROM part UNION ALL {literal_rows(NUMBERS, 'p_partkey')}), "
    rf"t AS (SELECT *, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS w FROM s) "
    rf"SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(text, '{numbers.PREFIX}', 1) AS DOUBLE), 0) AS atof, "
    rf"CASE WHEN w = 'NaN' THEN 'NaN'::DOUBLE WHEN w IN ('Infinity', '+Infinity') THEN 'Infinity'::DOUBLE WHEN w = '-Infinity' THEN '-Infinity'::DOUBLE "
    rf"WHEN regexp_matches(w, '^0[xX][0-9A-Fa-f]{{1,8}}$') THEN CASE WHEN CAST(lower(w) AS BIGINT) < 2147483648 THEN CAST(CAST(lower(w) AS BIGINT) AS DOUBLE) END "
    rf"WHEN regexp_matches(w, '{numbers.DECIMAL}') THEN TRY_CAST(w AS DOUBLE) END AS js, length(replace(text, ',', '.')) AS size FROM t",
)
def read_numbers(spark, sf_dir):
    tail = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(".25")
    rows, t = with_literals(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), tail).alias("text")), NUMBERS), F.col("text")
    return rows.select("p_partkey", numbers.c_atof(t).alias("atof"), numbers.js_number(t).alias("js"), F.length(F.replace(t, F.lit(","), F.lit("."))).cast("long").alias("size"))


@query(
    "narrowed_numbers",
    "SELECT o_orderkey, (o_orderkey * 123456789 + 2147483648) % 4294967296 - 2147483648 AS narrow, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders",
)
def narrowed_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.narrow_to_signed32(F.col("o_orderkey") * 123456789).alias("narrow"), F.col("o_totalprice").cast("long").alias("whole"))


STITCHED = ((0.2, 0.6), ((0.0, 1.0), (1.0, 0.0), (0.5, 0.5)))


@query(
    "function_values",
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 12 - 0.1 AS x FROM lineitem), c AS (SELECT *, greatest(least(x, 1.0), 0.0) AS u FROM x) "
    "SELECT l_orderkey, l_linenumber, round(10 + (x - 0.5) * (30 - 10) / (2.5 - 0.5), 9) AS line, round(0.1 + pow(u, 1.5) * 0.7, 9) AS power, "
    "round(CASE WHEN u < 0.2 THEN 0.1 + pow(greatest(least(u / 0.2, 1.0), 0.0), 1.5) * 0.7 WHEN u < 0.6 THEN pow(greatest(least(1 - (u - 0.2) / (0.6 - 0.2), 1.0), 0.0), 2.0) ELSE 0.5 * 2 END, 9) AS stitched, 7.0 AS flat FROM c",
)
def function_values(spark, sf_dir):
    x = F.col("l_discount") * 12 - 0.1
    parts = (lambda v: numbers.exponential(v, 0.1, 0.8, 1.5), lambda v: numbers.exponential(v, 0, 1, 2), lambda v: v * 2)
    nine = lambda c: F.round(c, 9)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", nine(numbers.interpolate(x, 0.5, 2.5, 10, 30)).alias("line"), nine(numbers.exponential(x, 0.1, 0.8, 1.5)).alias("power"),
        nine(numbers.stitching(x, parts, *STITCHED)).alias("stitched"), numbers.interpolate(x, 1, 1, 7, 9).alias("flat"),
    )


# --- dates without a pattern ------------------------------------------------------------------

#: 2023-11-14 22:13:20.
AT_HAND = 1_700_000_000_000
WRITTEN = ["2024-02-31", "12/25", "25/12", "25.13.", "3 4 1999", "14/3/1999", "1999/3/14", "99/3/14", "13-1-2", "1/2/3", "20240115", "no date", "7", "", "31 31 31", "Jan 5, 2020 10:30", "0/0", "10 11 12 13", "12345/6/7"]
WRITTEN_SQL = f"""(SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 3 THEN strftime(o_orderdate, '%d %m') ELSE 'on ' || strftime(o_orderdate, '%m-%d') END AS s FROM orders
  UNION ALL {literal_rows(WRITTEN, 'o_orderkey', 's')})"""
GUESSED_SQL = f"""w AS {WRITTEN_SQL}, g AS (SELECT o_orderkey, s, list_transform(regexp_extract_all(s, '[0-9]{{1,4}}'), lambda x: CAST(x AS INTEGER)) AS g FROM w),
o AS (SELECT o_orderkey, s, CASE len(g) WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN g[1] BETWEEN 1 AND 12 AND g[2] BETWEEN 1 AND 31 THEN [2023, g[1], g[2]] WHEN g[1] BETWEEN 1 AND 31 AND g[2] BETWEEN 1 AND 12 THEN [2023, g[2], g[1]] ELSE [2023, 11, 14] END
  ELSE CASE WHEN g[1] > 12 AND g[2] BETWEEN 1 AND 12 AND g[3] BETWEEN 1 AND 31 THEN g[1:3] WHEN g[1] BETWEEN 1 AND 12 AND g[2] BETWEEN 1 AND 31 AND g[3] > 31 THEN [g[3], g[1], g[2]] WHEN g[1] BETWEEN 1 AND 31 AND g[2] BETWEEN 1 AND 12 AND g[3] > 31 THEN [g[3], g[2], g[1]] ELSE [2023, 11, 14] END END AS d FROM g),
m AS (SELECT o_orderkey, s, CAST(coalesce(epoch(CAST(make_date(d[1], d[2], 1) AS TIMESTAMP)) * 1000 + (d[3] - 1)::BIGINT * 86400000 + 80000000, -1) AS BIGINT) AS ms FROM o)"""


def written_dates(spark, sf_dir):
    at, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    s = F.when(kind == 0, F.date_format(at, "yyyy-MM-dd")).when(kind == 1, F.date_format(at, "MM/dd/yyyy")).when(kind == 2, F.date_format(at, "dd.MM.yyyy")).when(kind == 3, F.date_format(at, "dd MM")).otherwise(F.concat(F.lit("on "), F.date_format(at, "MM-dd")))
    return with_literals(table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")), WRITTEN)


@query("guessed_dates", f"WITH {GUESSED_SQL} SELECT o_orderkey, s, ms FROM m")
def guessed_dates(spark, sf_dir):
    """Dates read by their numbers alone; -1 where there are too few."""
    return written_dates(spark, sf_dir).select("o_orderkey", "s", F.coalesce(dates.guessed(F.col("s"), AT_HAND), F.lit(-1)).alias("ms"))


@query(
    "parsed_dates",
    f"""WITH {GUESSED_SQL}, p AS (SELECT *, regexp_extract(s, '^([0-9]{{1,2}}).([0-9]{{1,2}}).([0-9]{{1,4}})', ['d', 'm', 'y']) AS f FROM m),
q AS (SELECT *, TRY_CAST(f.d AS INTEGER) AS d, TRY_CAST(f.m AS INTEGER) AS mon, TRY_CAST(f.y AS INTEGER) AS y FROM p)
SELECT o_orderkey, s, CASE WHEN s = '' THEN {AT_HAND} WHEN mon BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN CAST(epoch(CAST(make_date(CASE WHEN y < 50 THEN 2000 + y WHEN y < 100 THEN 1900 + y ELSE y END, mon, 1) AS TIMESTAMP)) * 1000 + (d - 1)::BIGINT * 86400000 + 80000000 AS BIGINT) ELSE ms END AS ms FROM q""",
)
def parsed_dates(spark, sf_dir):
    """Dates read by a pattern, and by their numbers where the pattern doesn't fit; -1 where neither does."""
    return written_dates(spark, sf_dir).select("o_orderkey", "s", F.coalesce(dates.parsed(F.col("s"), "dd/mm/yyyy", AT_HAND), F.lit(-1)).alias("ms"))
