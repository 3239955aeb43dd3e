"""Named queries of the document engine and their DuckDB counterparts.

A row of ``documents`` is a one-page document; a conversation is a document whose
turns are its pages (page = turn + 1); ``pages`` holds marked-up pages; amounts,
keys and dates of the other tables stand for form values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.functions import forms, text, wrapping
from paginarium.operators import lookup, pages, search, structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def literal_rows(values: list[str], key: str = "doc_id", column: str = "text") -> str:
    """The literal rows in SQL: keys -1, -2, ..."""
    return f"SELECT * FROM (VALUES {', '.join(f'(CAST({-1 - k} AS BIGINT), {quoted(v)})' for k, v in enumerate(values))}) AS literal({key}, {column})"


def with_literals(rows: DataFrame, values: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.unionByName(rows.sparkSession.createDataFrame([(-1 - k, v) for k, v in enumerate(values)], schema))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), "role", "text")


TURNS = 'turns AS (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, role, text FROM conversations)'
SPACE = r"[ \t\n\x0B\f\r]+"


# --- search ---------------------------------------------------------------------------


def hits_sql(needle: str, ignore_case: bool = False, whole_word: bool = False) -> str:
    n, hay = len(needle), (lambda c: f"lower({c})") if ignore_case else (lambda c: c)
    keep = ""
    if whole_word:
        bad = r"[A-Za-z0-9\[\\\]^_`]"
        left = f"CASE WHEN b > {n} THEN substr(line, CAST(b - {n} AS BIGINT), 1) ELSE '' END"
        keep = f" AND NOT regexp_matches({left}, '{bad}') AND NOT regexp_matches(substr(line, CAST(b + 1 AS BIGINT), 1), '{bad}')"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents WHERE contains({hay('text')}, '{needle}')),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ls FROM l),
c AS (SELECT doc_id, line, ls, i, unnest(string_split({hay('line')}, '{needle}')) AS piece,
             generate_subscripts(string_split({hay('line')}, '{needle}'), 1) AS k FROM o WHERE contains({hay('line')}, '{needle}')),
p AS (SELECT *, sum(length(piece) + {n}) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c)
SELECT doc_id, CAST(ls + b - {n} AS BIGINT) AS start, CAST(ls + b AS BIGINT) AS "end", line FROM p WHERE k > 1{keep}"""


@query("text_search", hits_sql("tion"))
def text_search(spark, sf_dir):
    return search.hits(table(spark, sf_dir, "documents"), "tion")


@query("text_search_ignore_case", hits_sql("the", ignore_case=True))
def text_search_ignore_case(spark, sf_dir):
    return search.hits(table(spark, sf_dir, "documents"), "the", ignore_case=True)


@query("text_search_whole_word", hits_sql("en", whole_word=True))
def text_search_whole_word(spark, sf_dir):
    return search.hits(table(spark, sf_dir, "documents"), "en", whole_word=True)


@query(
    "hit_counts",
    """SELECT lang, CAST(sum(CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT)) AS BIGINT) AS hits,
              count(*) AS documents FROM documents GROUP BY lang""",
)
def hit_counts(spark, sf_dir):
    n = F.size(F.split("text", "tion", -1)) - 1
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).alias("hits"), F.count(F.lit(1)).alias("documents"))


@query(
    "words_with_offsets",
    r"""WITH c AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) AS k FROM documents),
p AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
SELECT doc_id, word, CAST(start AS BIGINT) AS start, CAST(start + length(word) AS BIGINT) AS "end" FROM p WHERE word <> ''""",
)
def words_with_offsets(spark, sf_dir):
    return search.words_with_offsets(table(spark, sf_dir, "documents"))


# --- text scalars ---------------------------------------------------------------------


@query("content_word_count", rf"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '')) AS INTEGER) AS words FROM documents")
def content_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.words(F.col("text"))).alias("words"))


PAGE_LINES = "list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x) <> '')"


@query("page_lines", f"WITH l AS (SELECT doc_id, {PAGE_LINES} AS ls FROM documents) SELECT doc_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no FROM l")
def page_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))


KEY = rf"regexp_replace(trim(regexp_replace(line, '{SPACE}', ' ', 'g')), '[0-9]+', '#', 'g')"


@query("running_key", f"WITH l AS (SELECT doc_id, unnest({PAGE_LINES}) AS line FROM documents) SELECT {KEY} AS key, count(*) AS n, count(DISTINCT doc_id) AS documents FROM l GROUP BY 1")
def running_key(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    return each.groupBy(text.running_key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


# White space of Unicode, and literal cases of the rules below.
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
RULES = [
    "Intro ..... 4", "a . . . . . 7", "a.\t..... . b", "one ... two", "x. . . .y", ".....", "ﬁt . . . . .ﬂy",
    "2.1 Scope", "（1）显示", "（一）子", "一、款", "1.1、項", "12) b", "1234. no", "3.x", "7.", "１２. wide", "2.1.3 deep", "2.1", " private", "• nbsp", "•tight", "-- two", "（1234）x", "( 1) x", "12.  ",
    "# no > heading\n> quote\n+ plus *x* <a> | b\n#tag", "\\_`[]",
]
WITH_RULES = f"SELECT doc_id, text FROM documents UNION ALL {literal_rows(RULES)}"


def with_rules(spark, sf_dir) -> DataFrame:
    return with_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), RULES)


@query(
    "ligature_normalize",
    "SELECT doc_id, regexp_replace(" + "replace(" * 7 + "text" + "".join(f", '{a}', '{b}')" for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")))
    + rf", '[{WHITE}]*[.] *[.] *[.] *[.] *[.][. ]*', ' ... ', 'g') AS text FROM ({WITH_RULES})",
)
def ligature_normalize(spark, sf_dir):
    return with_rules(spark, sf_dir).select("doc_id", text.short_leaders(text.without_ligatures(F.col("text"))).alias("text"))


@query("markdown_escape", rf"SELECT doc_id, regexp_replace(regexp_replace(text, '([*_`\[\]\\])', '\\\1', 'g'), '(^|\n)(#|>|[+]|-|\\[*])', '\1\\\2', 'g') AS text FROM ({WITH_RULES})")
def markdown_escape(spark, sf_dir):
    return with_rules(spark, sf_dir).select("doc_id", wrapping.escaped(F.col("text")).alias("text"))


D, N = "[0-9０-９]{1,3}", "[〇零一二三四五六七八九十百]{1,3}"
LABELS = [(f"（(?:{D}|{N})）", "*"), (f"{N}、", "*"), (rf"(?:{D}[.])*{D}、", "*"), (rf"(?:{D}[.])*{D}[.)]", "+"), (rf"(?:{D}[.])+{D}", "+")]
CLASS = rf"""CASE WHEN regexp_matches(line, '^[-•·‣◦▪*–\x{{E000}}-\x{{F8FF}}][{WHITE}]') THEN 'bullet' WHEN {' OR '.join(f"regexp_matches(line, '^{p}[{WHITE}]{n}[^{WHITE}]')" for p, n in LABELS)} THEN 'numbered' ELSE 'body' END"""


@query("line_classes", f"WITH l AS (SELECT doc_id, unnest({PAGE_LINES}) AS line FROM ({WITH_RULES})) SELECT {CLASS} AS class, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM l GROUP BY 1")
def line_classes(spark, sf_dir):
    each = with_rules(spark, sf_dir).select("doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    return each.groupBy(text.line_class(F.col("line")).alias("class")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("doc_id").alias("documents"))


# --- running lines, lists, comparison -----------------------------------------------------

HEADED = (
    "SELECT conv_id, page, role || ' no. ' || page || chr(10) || 'Chapter One' || chr(10) || text || chr(10) || CASE WHEN page % 2 = 0 THEN 'page ' || page ELSE 'odd' || conv_id || page || text END AS text FROM turns"
)


def headed(spark, sf_dir):
    """The turns with a head of two lines and a foot, as scanned pages have them."""
    foot = F.when(F.col("page") % 2 == 0, F.concat(F.lit("page "), "page")).otherwise(F.concat(F.lit("odd"), "conv_id", "page", "text"))
    return turns(spark, sf_dir).select("conv_id", "page", F.concat_ws("\n", F.concat("role", F.lit(" no. "), "page"), F.lit("Chapter One"), "text", foot).alias("text"))


@query(
    "running_lines",
    f"""WITH {TURNS}, h AS ({HEADED}), l AS (SELECT conv_id, page, {PAGE_LINES} AS ls FROM h),
b AS (SELECT conv_id, page, 'top' AS band, unnest(ls[1:2]) AS line FROM l UNION ALL SELECT conv_id, page, 'bottom', unnest(ls[-2:]) FROM l),
k AS (SELECT DISTINCT conv_id, page, band, {KEY} AS key FROM b),
t AS (SELECT conv_id, count(DISTINCT page) AS total FROM turns GROUP BY conv_id)
SELECT k.conv_id, band, key, count(*) AS pages FROM k JOIN t ON k.conv_id = t.conv_id GROUP BY k.conv_id, band, key, total
HAVING count(*) >= 3 AND count(*) > total * 0.5""",
)
def running_lines(spark, sf_dir):
    return structure.running_lines(headed(spark, sf_dir), "conv_id", "page", depth=2)


@query(
    "list_group_islands",
    f"""WITH l AS (SELECT doc_id, {PAGE_LINES} AS ls FROM ({WITH_RULES})),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l),
c AS (SELECT doc_id, i, {CLASS} AS class FROM e),
g AS (SELECT *, CASE WHEN lag(class) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM class THEN 1 ELSE 0 END AS changed FROM c),
n AS (SELECT *, sum(changed) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM g)
SELECT doc_id, CAST(grp AS BIGINT) AS "group", class, CAST(min(i) AS INTEGER) AS first_line, count(*) AS n_lines FROM n GROUP BY doc_id, grp, class""",
)
def list_group_islands(spark, sf_dir):
    return structure.list_groups(with_rules(spark, sf_dir))


@query(
    "repeated_lines",
    f"WITH l AS (SELECT doc_id, unnest({PAGE_LINES}) AS line FROM documents) SELECT doc_id, line, count(*) AS n FROM l GROUP BY doc_id, line HAVING count(*) >= 3",
)
def repeated_lines(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    return each.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(
    "line_diff_sets",
    f"""WITH {TURNS}, l AS (SELECT conv_id, page, {PAGE_LINES} AS ls FROM turns),
b AS (SELECT *, coalesce(lag(ls) OVER (PARTITION BY conv_id ORDER BY page), []) AS before FROM l)
SELECT conv_id, page, CAST(len(list_distinct(list_filter(before, lambda x: NOT list_contains(ls, x)))) AS INTEGER) AS removed,
       CAST(len(list_distinct(list_filter(ls, lambda x: NOT list_contains(before, x)))) AS INTEGER) AS added FROM b""",
)
def line_diff_sets(spark, sf_dir):
    found = structure.line_changes(turns(spark, sf_dir), "conv_id", "page")
    return found.select("conv_id", "page", F.size("removed").alias("removed"), F.size("added").alias("added"))


@query("line_diff")
def line_diff(spark, sf_dir):
    return structure.consecutive_diff(turns(spark, sf_dir), "conv_id", "page")


#: Literal pairs of pages (what the first ends in, what the second starts with).
BREAKS = [("the parser recovers from a", "broken table"), ("the end.", "and yet"), ("he said “no”", "then left"), ("(see below)", "for more"), ("trailing  \n", "  lower"), ("買賣有價", "證券"), ("申報事項。", "證券"), ("ภาษา", "ไทย"), ("Intro", "The"), ("été", "Ça"), ("ends…", "ça"), ("no. 5", "ªbc"), ("a", "1b")]
BROKEN = [(-1 - k, page, "user", pair[page]) for k, pair in enumerate(BREAKS) for page in (0, 1)]
BROKEN_TURNS = "turns AS (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, role, text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({c}, {t}, '{r}', {quoted(x)})" for c, t, r, x in BROKEN) + ")))"
CARRIES = (
    rf"right(regexp_replace(before, '[{WHITE}]+$', ''), 1) NOT IN ('.', '!', '?', ':', ';', '…', chr(34), chr(39), ')', ']', '”', '’', '。', '！', '？', '：', '；', '」', '』', '）', '】', '》') "
    rf"AND regexp_matches(text, '^[{WHITE}]*[\p{{Ll}}ªº\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Myanmar}}\p{{Khmer}}]')"
)


def broken_turns(spark, sf_dir) -> DataFrame:
    literal = spark.createDataFrame([(c, t + 1, r, x) for c, t, r, x in BROKEN], "conv_id long, page int, role string, text string")
    return turns(spark, sf_dir).unionByName(literal)


@query(
    "carries_on",
    f"WITH {BROKEN_TURNS}, b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY page) AS before FROM turns) SELECT conv_id, page, coalesce({CARRIES}, false) AS carries_on FROM b",
)
def carries_on(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("page"))
    each = broken_turns(spark, sf_dir).withColumn("before", before)
    return each.select("conv_id", "page", F.coalesce(text.carries_on(F.col("before"), F.col("text")), F.lit(False)).alias("carries_on"))


@query("file_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def file_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    "semantic_hash",
    f"WITH {TURNS} SELECT conv_id, sha256(string_agg(role || chr(31) || text, chr(30) ORDER BY page)) AS digest FROM turns GROUP BY conv_id",
)
def semantic_hash(spark, sf_dir):
    return structure.document_digest(turns(spark, sf_dir), "conv_id", "page", ["role", "text"])


@query("duplicate_files", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_files(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    )


# --- links and outline --------------------------------------------------------------------

MAIL_SQL = r"regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+')"


def unnested(key: str, found: str, source: str, uri: str) -> str:
    return f"SELECT {key}, {uri} AS uri, CAST(n - 1 AS INTEGER) AS n FROM (SELECT {key}, unnest({found}) AS u, generate_subscripts({found}, 1) AS n FROM {source})"


MAIL_LINKS = unnested("doc_id", MAIL_SQL, "documents", "'mailto:' || u")


@query("mail_links", MAIL_LINKS)
def mail_links(spark, sf_dir):
    return structure.mail_links(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


OUTLINE = (
    f"WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '{structure.HEADING}')) AS tag, generate_subscripts(regexp_extract_all(html, '{structure.HEADING}'), 1) AS n FROM pages) "
    r"SELECT page_id, CAST(n - 1 AS INTEGER) AS n, CAST(substr(tag, 3, 1) AS INTEGER) AS depth, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS title FROM t"
)


@query("outline", OUTLINE)
def outline(spark, sf_dir):
    return structure.outline(table(spark, sf_dir, "pages"))


# --- pages ---------------------------------------------------------------------------------

SPEC = "2,1,3-end,2"
COUNTS = f"{TURNS}, counts AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS cnt FROM turns GROUP BY conv_id)"
SELECTED = "list_filter(list_concat([2, 1], CASE WHEN cnt >= 3 THEN CAST(range(3, cnt + 1) AS INTEGER[]) ELSE [] END, [2]), lambda x: x <= cnt)"


@query(
    "page_select",
    f"""WITH {COUNTS}, s AS (SELECT conv_id, unnest({SELECTED}) AS page, generate_subscripts({SELECTED}, 1) AS position FROM counts)
SELECT s.conv_id, CAST(s.page AS INTEGER) AS page, CAST(position AS INTEGER) AS position, role, text FROM s JOIN turns USING (conv_id, page)""",
)
def page_select(spark, sf_dir):
    return pages.select_pages(turns(spark, sf_dir), "conv_id", "page", SPEC)


@query("page_delete", f"WITH {COUNTS} SELECT conv_id, page, role, text FROM turns JOIN counts USING (conv_id) WHERE page <> 1 AND page <> cnt")
def page_delete(spark, sf_dir):
    return pages.delete_pages(turns(spark, sf_dir), "conv_id", "page", "1,end")


@query(
    "booklet_order",
    f"""WITH {COUNTS}, p AS (SELECT conv_id, cnt, CAST(ceil(cnt / 4.0) * 4 AS INTEGER) AS padded FROM counts),
k AS (SELECT *, unnest(range(padded)) AS k FROM p),
o AS (SELECT conv_id, cnt, k, CASE k % 4 WHEN 0 THEN padded - 2 * (k // 4) WHEN 1 THEN 2 * (k // 4) + 1 WHEN 2 THEN 2 * (k // 4) + 2 ELSE padded - 1 - 2 * (k // 4) END AS page FROM k)
SELECT conv_id, CAST(k + 1 AS INTEGER) AS position, CAST(page AS INTEGER) AS page, page > cnt AS blank FROM o""",
)
def booklet_order(spark, sf_dir):
    return pages.booklet(turns(spark, sf_dir), "conv_id")


@query(
    "nup_sheets",
    f"""WITH {TURNS} SELECT conv_id, page, CAST((page - 1) // 4 AS INTEGER) AS sheet, CAST((page - 1) % 4 // 2 AS INTEGER) AS sheet_row,
CAST((page - 1) % 2 AS INTEGER) AS sheet_column FROM turns""",
)
def nup_sheets(spark, sf_dir):
    return pages.n_up(turns(spark, sf_dir).select("conv_id", "page"), "page", 2, 2)


@query(
    "document_merge",
    f"""WITH {TURNS} SELECT conv_id, page, CAST(conv_id % 10 AS INTEGER) AS volume,
CAST(row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, page) AS INTEGER) AS merged_page FROM turns""",
)
def document_merge(spark, sf_dir):
    each = turns(spark, sf_dir).select("conv_id", "page", (F.col("conv_id") % 10).cast("int").alias("volume"))
    return pages.merge(each, "volume", "conv_id", "page")


@query(
    "page_label_asof",
    f"""WITH {TURNS}, r(start, style, prefix, first) AS (VALUES (1, 'r', '', 1), (3, 'D', 'A-', 5), (6, 'a', 'x', 26)),
m AS (SELECT t.conv_id, t.page, max(r.start) AS start FROM turns t JOIN r ON r.start <= t.page GROUP BY ALL)
SELECT conv_id, page, prefix || CASE style WHEN 'D' THEN CAST(page - start + first AS VARCHAR)
  WHEN 'r' THEN ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][page - start + first + 1]
  ELSE repeat(chr(CAST(97 + (page - start + first - 1) % 26 AS INTEGER)), (page - start + first - 1) // 26 + 1) END AS label
FROM m JOIN r USING (start)""",
)
def page_label_asof(spark, sf_dir):
    ranges = [(1, "r", "", 1), (3, "D", "A-", 5), (6, "a", "x", 26)]
    return pages.page_labels(turns(spark, sf_dir).select("conv_id", "page"), ranges, "page")


# --- form values ------------------------------------------------------------------------------


def _six(x: str) -> str:
    return f"floor({x} * 1e6 + 0.49) / 1e6"


#: Fields without a value: order, quantity.
UNFILLED = [(-1, 3.0), (-1, None), (-2, None), (-3, 2.0), (-3, -5.0), (-3, None), (-4, 7.0)]


def _calculate(op: str, sql: str):
    rows = ", ".join(f"({k}, {'NULL' if v is None else v})" for k, v in UNFILLED)
    filled = f"(SELECT l_orderkey, CASE WHEN l_quantity IS NULL THEN 0 ELSE l_quantity END AS q FROM (SELECT l_orderkey, l_quantity FROM lineitem UNION ALL SELECT * FROM (VALUES {rows})))"

    @query(f"af_simple_{op.lower()}", f"SELECT l_orderkey, {_six(f'CAST({sql}(q) AS DOUBLE)')} AS value FROM {filled} GROUP BY l_orderkey")
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").union(spark.createDataFrame(UNFILLED, "l_orderkey long, l_quantity double"))
        return rows.groupBy("l_orderkey").agg(forms.simple_calculate(op, F.col("l_quantity")).alias("value"))


for _op, _sql in (("SUM", "sum"), ("AVG", "avg"), ("PRD", "product"), ("MIN", "min"), ("MAX", "max")):
    _calculate(_op, _sql)


def _number(style: int) -> str:
    body = "format('{:,.2f}', abs(c_acctbal))"
    group, point = forms.STYLES[style]
    body = f"replace(replace(replace({body}, ',', chr(1)), '.', '{point}'), chr(1), '{group}')"
    below = f"'(' || '$' || {body} || ')'" if style % 2 else f"'-' || '$' || {body}"
    return f"CASE WHEN c_acctbal < 0 THEN {below} ELSE '$' || {body} END AS style_{style}"


@query("af_number_format", f"SELECT c_custkey, {', '.join(map(_number, range(4)))} FROM customer")
def af_number_format(spark, sf_dir):
    cols = [forms.number_format(F.col("c_acctbal"), 2, s, 2 if s % 2 else 0, "$").alias(f"style_{s}") for s in range(4)]
    return table(spark, sf_dir, "customer").select("c_custkey", *cols)


@query("af_percent_format", "SELECT l_orderkey, l_linenumber, format('{:,.1f}', l_discount * 100) || '%' AS discount, '%' || replace(format('{:,.2f}', l_tax * 100), '.', ',') AS tax FROM lineitem")
def af_percent_format(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", forms.percent_format(F.col("l_discount"), 1).alias("discount"), forms.percent_format(F.col("l_tax"), 2, style=3, prepend=True).alias("tax")
    )


@query("af_range_validate", "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN 'must be between 0 and 5000' END AS message FROM customer")
def af_range_validate(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", forms.range_validate(F.col("c_acctbal"), 0, 5000).alias("message"))


def _masked(mask: str, d: str) -> str:
    parts, at = [], 1
    for c in mask:
        parts.append(f"substr({d}, {at}, 1)" if c == "9" else f"'{c}'")
        at += c == "9"
    return " || ".join(parts)


DIGITS = "regexp_replace(c_name, '[^0-9]', '', 'g')"


@query(
    "af_special_format",
    f"SELECT c_custkey, {_masked('99999', DIGITS)} AS zip, {_masked('99999-9999', DIGITS)} AS zip4, "
    f"CASE WHEN length({DIGITS}) >= 10 THEN {_masked('(999) 999-9999', DIGITS)} ELSE {_masked('999-9999', DIGITS)} END AS phone, {_masked('999-99-9999', DIGITS)} AS ssn FROM customer",
)
def af_special_format(spark, sf_dir):
    names = ("zip", "zip4", "phone", "ssn")
    return table(spark, sf_dir, "customer").select("c_custkey", *[forms.special_format(F.col("c_name"), k).alias(n) for k, n in enumerate(names)])


@query("af_extract_nums", "SELECT p_partkey, array_to_string(regexp_extract_all(p_brand || '/' || p_size, '[0-9]+'), '|') AS numbers FROM part")
def af_extract_nums(spark, sf_dir):
    source = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(forms.extract_numbers(source), "|").alias("numbers"))


#: Literal texts of fields that are read as numbers.
TYPED = ["0x1F", "12d", "7f", "1,5", "  345 ", "e-5", ".", "+", "-1e5", "1e-9", "-1.23e+23", "1,000,000", "560,024", "1%", "", "  ", "0123", ".5", "1e+3", "+-5", "1e-9.5", "e-", "2e+1e+1", "12 3", "\t7"]
TYPED_PARTS = f"(SELECT p_partkey, replace(p_brand, 'Brand#', '') AS s FROM part UNION ALL SELECT p_partkey, p_name FROM part UNION ALL {literal_rows(TYPED, 'p_partkey', 's')})"


def typed(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    both = part.select("p_partkey", F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).alias("s")).union(part.select("p_partkey", "p_name"))
    return with_literals(both, TYPED)


@query(
    "af_make_number",
    rf"""WITH t AS (SELECT p_partkey, s, replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), ',', '.') AS x FROM {TYPED_PARTS})
SELECT p_partkey, s, CASE WHEN regexp_matches(x, '^0[xX][0-9A-Fa-f]+$') THEN CAST(TRY_CAST(x AS BIGINT) AS DOUBLE) WHEN regexp_matches(x, '^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$') THEN TRY_CAST(ltrim(x, '+') AS DOUBLE) ELSE 0 END AS number FROM t""",
)
def af_make_number(spark, sf_dir):
    return typed(spark, sf_dir).select("p_partkey", "s", forms.make_number(F.col("s")).alias("number"))


@query(
    "af_date_format",
    "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day_first, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS iso, strftime(o_orderdate, '%b %d, %Y') AS long_form FROM orders",
)
def af_date_format(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(at, "dd/MM/yyyy").alias("day_first"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("iso"), F.date_format(at, "MMM dd, yyyy").alias("long_form")
    )


@query("af_time_format", "SELECT event_id, strftime(ts, '%H:%M') AS short_time, strftime(ts, '%I:%M:%S %p') AS long_time FROM events")
def af_time_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm").alias("short_time"), F.date_format("ts", "hh:mm:ss a").alias("long_time"))


# --- flags, lookups, logs -------------------------------------------------------------------------

ANNOTATION_FLAGS = {"invisible": 1, "hidden": 2, "print": 3, "no_zoom": 4, "no_rotate": 5, "no_view": 6, "read_only": 7, "locked": 8}
PERMISSIONS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "extract": 10, "assemble": 11, "print_high": 12}


def _flags(key: str, flags: dict[str, int]) -> str:
    return ", ".join(f"(({key} >> {p - 1}) & 1) = 1 AS {n}" for n, p in flags.items())


@query("annotation_flags", f"SELECT o_orderkey, {_flags('o_orderkey', ANNOTATION_FLAGS)} FROM orders")
def annotation_flags(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *[forms.flag(F.col("o_orderkey"), p).alias(n) for n, p in ANNOTATION_FLAGS.items()])


@query("permission_bits", f"SELECT o_orderkey, {_flags('o_custkey', PERMISSIONS)} FROM orders")
def permission_bits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *[forms.flag(F.col("o_custkey"), p).alias(n) for n, p in PERMISSIONS.items()])


@query("diagnostic_counts", "SELECT event_type, least(count(*), 4096) AS kept, greatest(count(*) - 4096, 0) AS dropped FROM events GROUP BY event_type")
def diagnostic_counts(spark, sf_dir):
    return structure.capped_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    "newest_wins",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1",
)
def newest_wins(spark, sf_dir):
    found = structure.newest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return found.select("user_id", "event_id", "event_type", "value")


@query(
    "inherited_attribute",
    """SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 5 = 0 THEN s_name END, CASE WHEN n_nationkey % 3 = 0 THEN n_name END, r_name) AS attribute
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def inherited_attribute(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    own = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name"))
    above = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return joined.select("s_suppkey", F.coalesce(own, above, "r_name").alias("attribute"))


@query(
    "name_lookup",
    "SELECT p_type, count(*) AS uses, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type",
)
def name_lookup(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line.l_partkey == part.p_partkey).groupBy("p_type").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("l_partkey").alias("parts"))


@query(
    "dangling_references",
    "SELECT l_suppkey, count(*) AS uses FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal >= 3000) GROUP BY l_suppkey",
)
def dangling_references(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where("s_acctbal >= 3000")
    line = table(spark, sf_dir, "lineitem")
    return line.join(known, line.l_suppkey == known.s_suppkey, "left_anti").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("uses"))


@query(
    "body_size_mode",
    """WITH v AS (SELECT p_brand, p_size, sum(strlen(p_name)) AS votes FROM part GROUP BY p_brand, p_size)
SELECT p_brand, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY votes DESC, p_size DESC) AS nth FROM v) WHERE nth = 1""",
)
def body_size_mode(spark, sf_dir):
    return structure.weighted_mode(table(spark, sf_dir, "part"), "p_brand", "p_size", F.octet_length("p_name"))


@query("property_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NOT NULL AS has_missing FROM events")
def property_get(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("has_missing")
    )


@query(
    "scoreboard",
    "SELECT CAST(coalesce(quality, -1) AS INTEGER) AS quality, CAST(coalesce(toxic, -1) AS INTEGER) AS toxic, CAST(level AS INTEGER) AS level, n "
    "FROM (SELECT quality, toxic, grouping_id(quality, toxic) AS level, count(*) AS n FROM labels GROUP BY ROLLUP (quality, toxic))",
)
def scoreboard(spark, sf_dir):
    """``level`` tells totals (1: of a quality, 3: of all) from rows whose label is null."""
    found = table(spark, sf_dir, "labels").rollup("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
    return found.select(*[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("quality", "toxic")], "level", "n")


@query(
    "event_windows",
    "SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def event_windows(spark, sf_dir):
    from paginarium.streaming import windows

    return windows.counted(table(spark, sf_dir, "events"))


@query("document_sizes", "SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def document_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


# --- geometry on a character grid: column and line are a character's place ---------------------


@query(
    "text_in_rect",
    f"""WITH l AS (SELECT doc_id, {PAGE_LINES} AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(ls[2:5], lambda x: substr(x, 11, 30)), chr(10)) AS text FROM l WHERE len(ls) >= 2""",
)
def text_in_rect(spark, sf_dir):
    """What stands in columns 10 to 39 of lines 1 to 4 of each page (both from 0)."""
    each = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("ls")).where(F.size("ls") >= 2)
    return each.select("doc_id", F.array_join(F.transform(F.slice("ls", 2, 4), lambda x: F.substring(x, 11, 30)), "\n").alias("text"))


@query(
    "page_extent",
    f"""WITH l AS (SELECT doc_id, {PAGE_LINES} AS ls FROM documents)
SELECT doc_id, CAST(len(ls) AS INTEGER) AS height, CAST(coalesce(list_max(list_transform(ls, lambda x: length(x))), 0) AS INTEGER) AS width FROM l""",
)
def page_extent(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("ls"))
    width = F.coalesce(F.array_max(F.transform("ls", lambda x: F.length(x))), F.lit(0))
    return each.select("doc_id", F.size("ls").alias("height"), width.alias("width"))


# --- pairing, as-of, uses, rejoining ---------------------------------------------------------------


@query(
    "diff_pairing",
    f"""WITH {TURNS}, l AS (SELECT conv_id // 2 AS pair, conv_id % 2 AS side, page, CAST(len({PAGE_LINES}) AS INTEGER) AS n FROM turns)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.page, b.page) AS page, coalesce(a.n, -1) AS "left", coalesce(b.n, -1) AS "right"
FROM (SELECT * FROM l WHERE side = 0) a FULL JOIN (SELECT * FROM l WHERE side = 1) b ON a.pair = b.pair AND a.page = b.page""",
)
def diff_pairing(spark, sf_dir):
    each = turns(spark, sf_dir).select(F.floor(F.col("conv_id") / 2).alias("pair"), (F.col("conv_id") % 2).alias("side"), "page", F.size(text.lines(F.col("text"))).alias("n"))
    found = lookup.paired(each.where("side = 0"), each.where("side = 1"), ["pair", "page"], "n")
    return found.select("pair", "page", *[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("left", "right")])


@query(
    "asof_lookup",
    """WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), c AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT e.user_id, e.event_id, coalesce(c.event_id, -1) AS last_click FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""",
)
def asof_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    errors, clicks = (events.where(F.col("event_type") == k).drop("event_type") for k in ("error", "click"))
    return lookup.as_of(errors, clicks, "user_id", "ts", "event_id", "last_click", F.date_trunc("day", "ts")).select("user_id", "event_id", F.coalesce("last_click", F.lit(-1)).alias("last_click"))


@query(
    "object_uses",
    "SELECT l_partkey, count(*) AS uses, min(l_orderkey) AS first_use, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY l_partkey",
)
def object_uses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("uses"), F.min("l_orderkey").alias("first_use"), F.countDistinct("l_orderkey").alias("documents")
    )


@query("unreferenced_objects", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '5-LOW')")
def unreferenced_objects(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query(
    "rejoined_paragraphs",
    f"""WITH {BROKEN_TURNS}, b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY page) AS before FROM turns),
c AS (SELECT *, CASE WHEN coalesce({CARRIES}, false) THEN 0 ELSE 1 END AS starts FROM b),
g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paragraph FROM c)
SELECT conv_id, CAST(paragraph AS BIGINT) AS paragraph, min(page) AS first_page, string_agg(trim(text), ' ' ORDER BY page) AS text FROM g GROUP BY conv_id, paragraph""",
)
def rejoined_paragraphs(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("page")
    goes_on = F.coalesce(text.carries_on(F.lag("text").over(order), F.col("text")), F.lit(False))
    each = broken_turns(spark, sf_dir).withColumn("starts", F.when(goes_on, 0).otherwise(1))
    each = each.withColumn("paragraph", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page", F.trim("text").alias("t")))), lambda x: x["t"])
    return each.groupBy("conv_id", "paragraph").agg(F.min("page").alias("first_page"), F.array_join(parts, " ").alias("text"))


@query("af_merge_change", "SELECT c_custkey, substr(c_name, 1, 8) || 'No ' || substr(c_name, 10) AS merged FROM customer")
def af_merge_change(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", forms.merge_change(F.col("c_name"), "No ", 8, 9).alias("merged"))


@query("af_simple", "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS sum, (l_quantity + l_tax) / 2 AS avg, l_quantity * l_tax AS prd, least(l_quantity, l_tax) AS min, greatest(l_quantity, l_tax) AS max FROM lineitem")
def af_simple(spark, sf_dir):
    cols = [forms.simple(op, F.col("l_quantity"), F.col("l_tax")).alias(op.lower()) for op in ("SUM", "AVG", "PRD", "MIN", "MAX")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)


@query(
    "af_is_number",
    rf"""WITH t AS (SELECT p_partkey, s, trim(s, ' ') AS x FROM {TYPED_PARTS})
SELECT p_partkey, s, x <> '' AND NOT regexp_matches(x, '[^-+0-9.,eE]') AND length(regexp_replace(x, '[^.,]', '', 'g')) <= 1 AND length(regexp_replace(x, '[^eE]', '', 'g')) <= 1
  AND NOT regexp_matches(x, '[eE]([^-+]|$)') AND NOT regexp_matches(x, '[^eE][-+]') AS number FROM t""",
)
def af_is_number(spark, sf_dir):
    return typed(spark, sf_dir).select("p_partkey", "s", forms.is_number(F.col("s")).alias("number"))


@query(
    "date_round_trip",
    "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS shown, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders",
)
def date_round_trip(spark, sf_dir):
    shown = F.date_format("o_orderdate", "dd.MM.yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), F.unix_timestamp(F.try_to_timestamp(shown, F.lit("dd.MM.yyyy"))).alias("seconds"))


@query("hex_and_base64", "SELECT doc_id, md5(hex(encode(text))) AS hex_md5, length(base64(encode(text))) AS base64_length, octet_length(encode(text)) AS bytes FROM documents")
def hex_and_base64(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    b64 = F.length(F.regexp_replace(F.base64(raw), "[\r\n]", "")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.hex(raw)).alias("hex_md5"), b64.alias("base64_length"), F.octet_length("text").cast("long").alias("bytes"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with offsets and hit lines."""
    return text_search(spark, sf_dir)
