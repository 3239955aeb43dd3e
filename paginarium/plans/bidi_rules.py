"""Queries on lines from right to left. The tables hold none, so in every third line of a text the small Latin
letters become Hebrew and Arabic ones: capitals, accented letters, digits and brackets among them stay."""

from __future__ import annotations

from pyspark.sql import functions as F

from paginarium.operators import bidi
from paginarium.plans.registry import quoted, query, table

LATIN, OTHER = "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתابجد"
LITERAL = ["אבג 123 abc", "abc אבג 12,5% (דה)", "3/5.", "", "abc 3 אב", "(אב) [ג] «ד»", "12 אב", "אב 1,2,3 גד", "$5 אב 50% ג", "abc", "3/5.", "א", "א̀ב", "אב - cd - הו", "1.2 abc אב 3"]
LINES = f"""lines AS (SELECT doc_id, CAST(ln AS BIGINT) AS line, CASE WHEN ln % 3 = 1 THEN translate(part, '{LATIN}', '{OTHER}') ELSE part END AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents)
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(line AS BIGINT), text FROM (VALUES {', '.join(f'({k}, {quoted(t)})' for k, t in enumerate(LITERAL))}) AS literal(line, text))"""
CHARS = f"""{LINES}, split AS (SELECT doc_id, line, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM lines WHERE text <> '' AND __WHICH__),
chars AS (SELECT doc_id, line, i, c, CASE WHEN regexp_matches(c, '^[\\p{{Mn}}\\p{{Me}}]') OR ord(c) IN (173, 65279) OR ord(c) BETWEEN 8203 AND 8205 OR (ord(c) < 32 AND ord(c) NOT BETWEEN 9 AND 13 AND ord(c) < 28) OR (ord(c) BETWEEN 127 AND 159 AND ord(c) <> 133) THEN 'W'
 WHEN regexp_matches(c, '^[\\p{{Hebrew}}\\p{{Arabic}}]') AND regexp_matches(c, '^\\p{{L}}') THEN 'R' WHEN regexp_matches(c, '^[0-9²³¹٠-٩]') THEN 'N' WHEN c IN (',', '.', '/', ':', '+', '-', chr(160), '−') THEN 'S'
 WHEN c IN ('#', '$', '%', '¢', '£', '¤', '¥', '°', '±', '€', '‰') THEN 'T' WHEN regexp_matches(c, '^\\p{{L}}') THEN 'L' ELSE 'O' END AS kind FROM split)"""


def lines(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    shown = F.when(F.col("line") % 3 == 1, F.translate("text", LATIN, OTHER)).otherwise(F.col("text"))
    literal = spark.createDataFrame([(-1, k, t) for k, t in enumerate(LITERAL)], "doc_id long, line long, text string")
    return each.select("doc_id", F.col("line").cast("long").alias("line"), shown.alias("text")).union(literal)


@query(
    "bidi_segments",
    f"""WITH {CHARS.replace('__WHICH__', '(line % 3 = 1 OR doc_id < 0)')}, ways AS (SELECT doc_id, line, i, CASE kind WHEN 'L' THEN 'left' WHEN 'R' THEN 'right' WHEN 'O' THEN 'neutral' ELSE 'weak' END AS direction FROM chars),
starts AS (SELECT *, CASE WHEN coalesce(lag(direction) OVER (PARTITION BY doc_id, line ORDER BY i), 'neutral') <> direction THEN 1 ELSE 0 END AS start FROM ways),
numbered AS (SELECT *, sum(start) OVER (PARTITION BY doc_id, line ORDER BY i) AS n FROM starts),
runs AS (SELECT doc_id, line, n, min(i) AS first, count(*) AS length, min(direction) AS direction FROM numbered GROUP BY doc_id, line, n UNION ALL SELECT doc_id, line, 0, 0, 0, 'neutral' FROM numbered WHERE i = 0 AND n = 1)
SELECT doc_id, line, string_agg(first || '+' || length || direction[1], ' ' ORDER BY n) AS runs, sum(CASE direction WHEN 'right' THEN 1 WHEN 'left' THEN -1 ELSE 0 END) > 0 AS right_to_left FROM runs GROUP BY doc_id, line""",
)
def bidi_segments(spark, sf_dir):
    """Runs of one direction in each changed line, and which lines read from the right by them."""
    changed = lines(spark, sf_dir).where("line % 3 = 1 OR doc_id < 0")
    runs = changed.where("text <> ''").select("doc_id", "line", bidi.runs_of(F.col("text")).alias("runs"))
    word = lambda r: F.concat(r["first"].cast("string"), F.lit("+"), r["length"].cast("string"), F.substring(r["direction"], 1, 1))
    many = lambda way: F.size(F.filter("runs", lambda r: r["direction"] == way))
    return runs.select("doc_id", "line", F.array_join(F.transform("runs", word), " ").alias("runs"), (many("right") > many("left")).alias("right_to_left"))


PAST, AHEAD = "(PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "(PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
OF_LINE = "(PARTITION BY doc_id, line ORDER BY i)"


def around(value: str) -> str:
    return f"last_value({value} IGNORE NULLS) OVER {PAST} AS a, first_value({value} IGNORE NULLS) OVER {AHEAD} AS b"


@query(
    "logical_lines",
    f"""WITH {CHARS.replace('__WHICH__', 'true')},
letters AS (SELECT doc_id, line, count(*) FILTER (kind = 'R') AS rights, count(*) FILTER (kind = 'L') AS lefts FROM chars GROUP BY doc_id, line),
own AS (SELECT doc_id, line, text, coalesce(rights, 0) AS rights, coalesce(lefts, 0) AS lefts FROM lines LEFT JOIN letters USING (doc_id, line)),
flags AS (SELECT *, coalesce(last_value(CASE WHEN rights + lefts > 0 THEN rights > lefts END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line), false) AS rtl FROM own),
todo AS (SELECT *, rights > 0 OR (lefts = 0 AND rtl) AS turns FROM flags),
k0 AS (SELECT c.*, rtl, lag(kind) OVER {OF_LINE} AS p, lead(kind) OVER {OF_LINE} AS q FROM chars c JOIN todo USING (doc_id, line) WHERE turns),
k1 AS (SELECT doc_id, line, i, c, rtl, CASE WHEN kind = 'S' AND p = 'N' AND q = 'N' THEN 'N' ELSE kind END AS kind FROM k0),
t1 AS (SELECT *, {around("CASE WHEN kind <> 'T' THEN kind END")} FROM k1),
k2 AS (SELECT doc_id, line, i, c, rtl, CASE WHEN kind = 'T' AND (coalesce(a, '') = 'N' OR coalesce(b, '') = 'N') THEN 'N' WHEN kind IN ('L', 'R', 'N') THEN kind ELSE 'O' END AS kind FROM t1),
t2 AS (SELECT *, {around("CASE WHEN kind IN ('L', 'R') THEN kind END")} FROM k2),
k3 AS (SELECT doc_id, line, i, c, rtl, CASE WHEN kind = 'N' AND NOT rtl AND (coalesce(a, '') = 'L' OR (a IS NULL AND coalesce(b, 'L') = 'L')) THEN 'L' ELSE kind END AS kind, CASE WHEN rtl THEN 'R' ELSE 'L' END AS whole FROM t2),
t3 AS (SELECT *, {around("CASE kind WHEN 'N' THEN 'R' WHEN 'O' THEN NULL ELSE kind END")} FROM k3),
k4 AS (SELECT *, CASE WHEN kind <> 'O' THEN kind WHEN coalesce(a, whole) = coalesce(b, whole) THEN coalesce(a, whole) ELSE whole END AS settled FROM t3),
lv AS (SELECT doc_id, line, i, c, rtl, CASE settled WHEN 'L' THEN CASE WHEN rtl THEN 2 ELSE 0 END WHEN 'R' THEN 1 ELSE 2 END AS level, count(*) OVER (PARTITION BY doc_id, line) AS n FROM k4),
r2 AS (SELECT *, {around("CASE WHEN level < 2 THEN i END")} FROM lv),
p2 AS (SELECT doc_id, line, i, c, rtl, level, n, CASE WHEN level >= 2 THEN coalesce(a, -1) + coalesce(b, n) - i ELSE i END AS place FROM r2),
r1 AS (SELECT *, {around("CASE WHEN level < 1 THEN i END")} FROM p2),
p1 AS (SELECT doc_id, line, rtl, CASE WHEN level >= 1 THEN coalesce(a, -1) + coalesce(b, n) - place ELSE place END AS place, CASE WHEN level = 1 THEN translate(c, '()<>[]{{}}«»', ')(><][}}{{»«') ELSE c END AS c FROM r1)
SELECT doc_id, line, string_agg(c, '' ORDER BY place) AS text, rtl AS right_to_left FROM p1 GROUP BY doc_id, line, rtl
UNION ALL SELECT doc_id, line, text, rtl FROM todo WHERE text IS NOT NULL AND (NOT turns OR text = '')""",
)
def logical_lines(spark, sf_dir):
    """All lines in the order they are read, out of the order they are seen in."""
    return bidi.logical_order(lines(spark, sf_dir), "doc_id", "line", "text")
