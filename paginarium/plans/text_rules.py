"""Queries on lines, needles and addresses; their SQL states the rules a second time.

Where the tables hold no case of a rule, a few literal rows with negative keys join
the table's rows on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paginarium.functions import text, wrapping as w
from paginarium.operators import search, structure
from paginarium.plans.registry import MAIL_LINKS, PAGE_LINES, literal_rows, mail_links, query, quoted, table, with_literals


# --- joining lines ---------------------------------------------------------------------

WRAPPED = ["a hyphen-\nated word", "state-of-\nthe-art", "non-\nEnglish", "COVID-\n19 cases", "日本\n語の", "ไทย\nไทย", "soft­\nware", "end. \n  Next", "zero​\nwidth", "漢字\nlatin", "well-known-\nrule here", "1-\nst"]


def joined_sql(t0: str, n0: str) -> str:
    t, n = f"regexp_replace({t0}, '{w.TRAILING}', '')", f"regexp_replace({n0}, '{w.LEADING}', '')"
    body = f"substr({t}, 1, length({t}) - 1)"
    keeps = f"(regexp_matches({n}, '{w.CAPITAL}') OR regexp_matches({body}, '{w.COMPOUND_END}') OR regexp_matches({n}, '{w.COMPOUND_START}'))"
    vanishes = " OR ".join("(" + " AND ".join(f"regexp_matches({x}, '{p}')" for x, p in ((t, a), (n, b)) if p) + ")" for a, b in w.VANISHING)
    return (
        f"CASE WHEN regexp_matches({t}, '{w.WRAPPED}') AND regexp_matches({n}, '{w.GOES_ON}') THEN {body} || CASE WHEN {keeps} THEN '-' ELSE '' END || {n} "
        f"WHEN {t} <> '' AND NOT ({vanishes}) THEN {t} || ' ' || {n} ELSE {t} || {n} END"
    )


@query(
    "joined_lines",
    f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL {literal_rows(WRAPPED)}), l AS (SELECT doc_id, {PAGE_LINES} AS ls FROM d) "
    f"SELECT doc_id, list_reduce(list_prepend('', ls), lambda a, b: {joined_sql('a', 'b')}) AS text FROM l",
)
def joined_lines(spark, sf_dir):
    rows = with_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), WRAPPED)
    return rows.select("doc_id", w.joined(text.lines(F.col("text"))).alias("text"))


# --- facts of single lines --------------------------------------------------------------

LINES = ["7", "- 7 -", "1 / 11 www.example.com", "Page 3 of 9", "page of contents", "see http://x.io/a", "2.1 Background ..... 4", "2.1 Background . . . . . 4", "Intro.... 4", "日本語の文章", "日本 text 語", "ไทย", "...", "漢 1", "foo.org/bar"]


def words_sql(line: str) -> str:
    rest = f"regexp_replace(x, '[{w.WIDE}{w.TIGHT}]', '', 'g')"
    one = f"greatest(CAST(ceil((length(x) - length({rest})) / 2.0) AS INTEGER), CASE WHEN length(x) = length({rest}) OR regexp_matches({rest}, '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END)"
    return f"CAST(coalesce(list_sum(list_transform(list_filter(string_split_regex({line}, '[{w.SPACES}]+'), lambda x: x <> ''), lambda x: {one})), 0) AS INTEGER)"


PIECES = f"list_filter(string_split_regex(line, '[{w.SPACES}]+'), lambda x: x <> '')"
LEADER_RUN = rf"regexp_extract(regexp_replace(line, '{w.TRAILING}', ''), '([. ]*)[^. ]*$', 1)"


@query(
    "line_facts",
    f"WITH l AS (SELECT doc_id, unnest({PAGE_LINES}) AS line FROM documents UNION ALL {literal_rows(LINES, column='line')}) "
    f"SELECT doc_id, line, {words_sql('line')} AS words, len({PIECES}) > 0 AND len(list_filter({PIECES}, lambda x: NOT regexp_matches(x, '{w.FOLIO_WORD}'))) = 0 AS folio, "
    f"length(replace({LEADER_RUN}, ' ', '')) >= {w.LEADER} AS leader FROM l",
)
def line_facts(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    line = F.col("line")
    return with_literals(each, LINES).select("doc_id", "line", w.word_count(line).alias("words"), w.is_folio(line).alias("folio"), w.is_leader_entry(line).alias("leader"))


OPENINGS = ["**Redaction** - Lets you", "**** x", "***a** b", "plain", "**open", "# no | heading\n- item\n* star", "a*b_c`d[e]f\\g\r\nh"]
LEAD = r"(?s)^\*\*(.+?)\*\*(.*)$"


@query(
    "lead_ins_and_cells",
    rf"WITH d AS (SELECT doc_id, '**' || split_part(text, ' ', 1) || '**' || substr(text, length(split_part(text, ' ', 1)) + 1) AS text FROM documents UNION ALL {literal_rows(OPENINGS)}), "
    rf"p AS (SELECT doc_id, text, regexp_matches(text, '{LEAD}') AND NOT starts_with(text, '****') AS opens, regexp_replace(regexp_replace(text, '{w.TRAILING}', ''), '{w.LEADING}', '') AS s FROM d) "
    rf"SELECT doc_id, CASE WHEN opens THEN regexp_extract(text, '{LEAD}', 1) END AS lead, CASE WHEN opens THEN md5(regexp_extract(text, '{LEAD}', 2)) END AS rest, "
    r"md5(regexp_replace(replace(regexp_replace(regexp_replace(s, '([*_`\[\]\\])', '\\\1', 'g'), '(^|\n)([#>+\-]|\\\*)', '\1\\\2', 'g'), '|', '\|'), '[\r\n]', ' ', 'g')) AS cell FROM p",
)
def lead_ins_and_cells(spark, sf_dir):
    first = F.substring_index("text", " ", 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("**"), first, F.lit("**"), F.substring(F.col("text"), F.length(first) + 1, F.length("text"))).alias("text"))
    found = with_literals(docs, OPENINGS).select("doc_id", w.lead_in(F.col("text")).alias("o"), w.table_cell(F.col("text")).alias("cell"))
    return found.select("doc_id", F.col("o.lead").alias("lead"), F.md5(F.col("o.rest").cast("binary")).alias("rest"), F.md5(F.col("cell").cast("binary")).alias("cell"))


# --- characters and needles ---------------------------------------------------------------

SIGNS = ["漢aЖلẞ’ÿ", "İΣςß5٣Ⅷ", "a b c d", "x   y"]


@query(
    "character_classes",
    f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL {literal_rows(SIGNS)}), c AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM d) "
    rf"SELECT c, count(*) AS n, regexp_matches(c, '^\p{{L}}$') AS alpha, regexp_matches(c, '^[\p{{L}}\p{{Nd}}]$') AS alnum, regexp_matches(c, '^[^{w.TOGETHER}]$') AS splits, "
    f"lower(replace(replace(c, 'İ', 'i'), 'Σ', 'σ')) AS lower FROM c GROUP BY c",
)
def character_classes(spark, sf_dir):
    docs = with_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), SIGNS)
    counted = docs.select(F.explode(F.regexp_extract_all("text", F.lit("((?s).)"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("c")
    return counted.select("c", "n", w.is_alpha(c).alias("alpha"), w.is_alnum(c).alias("alnum"), w.splits_needle(c).alias("splits"), w.simple_lower(c).alias("lower"))


@query(
    "single_spaces",
    f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL {literal_rows(SIGNS)}) "
    r"SELECT doc_id, md5(regexp_replace(text, ' +', ' ', 'g')) AS collapsed, md5(regexp_replace(text, '[\x{A0}\x{2000}-\x{200A}\x{202F}]', ' ', 'g')) AS folded, md5(trim(text, ' ')) AS trimmed FROM d",
)
def single_spaces(spark, sf_dir):
    docs, t = with_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), SIGNS), F.col("text")
    digest = lambda c: F.md5(c.cast("binary"))
    return docs.select("doc_id", digest(w.collapsed(t)).alias("collapsed"), digest(w.folded_spaces(t)).alias("folded"), digest(F.trim(t)).alias("trimmed"))


NEEDLES = ["", "   ", "a  b", "a b ", " a", "漢字かな mix漢", "don’t stop", "한국 x", "Жук"]


@query(
    "needle_parts",
    f"WITH n AS (SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS needle FROM documents UNION ALL {literal_rows(NEEDLES, column='needle')}) "
    f"SELECT doc_id, needle, array_to_string(CASE WHEN regexp_matches(needle, '^ *$') THEN [needle] ELSE flatten(list_transform(string_split_regex(needle, ' +'), "
    f"lambda x: CASE WHEN x = '' THEN [''] ELSE regexp_extract_all(x, '[^{w.TOGETHER}]|[{w.TOGETHER}]+') END)) END, '|') AS parts FROM n",
)
def needle_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("needle"))
    return with_literals(docs, NEEDLES).select("doc_id", "needle", F.array_join(w.split_needle(F.col("needle")), "|").alias("parts"))


# --- addresses ------------------------------------------------------------------------------

ADDRESSES = [
    "see HTTP://Example.ORG/a(b), or", "0(http://www.abc.com)0 x", "http://www.abc.com)0 x", "www.thering.example.org. end", "http://a http://ab https://c.de", "http://long-\nname.example.com/x y",
    "at [http://x.example/y] or <www.b.example>", "http://[::1]:8080 http://[::1]x http://[]a", "http://host.example!!! http://host.example。", "wwww.short", "'http://q.example/a'b 'x", "(['http://m.example])')",
]
CANDIDATES = (
    r"list_filter(list_transform(regexp_split_to_array(regexp_replace(replace({0}, chr(173), '-'), '-[\r\n]+', '-', 'g'), '[ \r\n]'), "
    r"lambda c: CASE WHEN length(c) > 5 THEN regexp_replace(c, '[),>.]+$', '') END), lambda c: length(c) > 5)"
)


def address_sql() -> str:
    """From cand(key, n, c) to address(key, n, uri): both forms with their places, cut step by step."""
    closers = "CASE o " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in w.OPENERS.items()) + " END"
    opened = f"list_filter(list_transform(regexp_extract_all(substr(c, 1, s - 1), '(?s).'), lambda o: {closers}), lambda o: o IS NOT NULL)"
    cut = "CASE WHEN contains(k, o) THEN substr(k, 1, length(k) - instr(reverse(k), o)) ELSE k END"
    return f"""
low AS (SELECT *, lower(replace(replace(c, 'İ', 'i'), 'Σ', 'σ')) AS low FROM cand),
spots AS (SELECT *, instr(low, 'http') AS h, instr(low, 'www.') AS b FROM low),
hs AS (SELECT *, CASE WHEN substr(low, h + 4, 1) = 's' THEN 1 ELSE 0 END AS secure FROM spots),
forms AS (
  SELECT key, n, c, 1 AS form, h AS s, h + 7 + secure AS after, h + 7 + secure AS host FROM hs WHERE h > 0 AND length(low) > h + 7 AND substr(low, h + 4 + secure, 3) = '://'
  UNION ALL SELECT key, n, c, 2, b, b + 4, b FROM hs WHERE b > 0 AND length(low) > b + 3),
kept AS (SELECT *, list_reduce({opened}, lambda k, o: {cut}, substr(c, s)) AS k, substr(c, host) AS tail FROM forms),
trimmed AS (SELECT *, regexp_replace(k, '{w.NO_HOST_END}', '') AS t, regexp_extract(tail, '{w.BRACKETED}', 1) AS br FROM kept),
ended AS (SELECT *, CASE WHEN contains(tail, '/') THEN k WHEN starts_with(tail, '[') THEN CASE WHEN br <> '' THEN substr(c, s, host - s) || br ELSE k END
  WHEN length(t) > host - s THEN t ELSE substr(k, 1, host - s + 1) END AS e FROM trimmed),
address AS (SELECT key, n, arg_min(CASE form WHEN 1 THEN e ELSE 'http://' || e END, form) AS uri FROM ended WHERE length(e) > after - s + 1 GROUP BY key, n)"""


def addresses_sql(key: str, source: str, text_sql: str) -> str:
    found = CANDIDATES.format(text_sql)
    return (
        f"WITH src AS ({source}), cand AS (SELECT {key} AS key, unnest({found}) AS c, generate_subscripts({found}, 1) - 1 AS n FROM src),{address_sql()} "
        f"SELECT key AS {key}, CAST(n AS INTEGER) AS n, uri FROM address"
    )


@query("web_addresses", addresses_sql("page_id", f"SELECT page_id, url || ' ' || html AS text FROM pages UNION ALL {literal_rows(ADDRESSES, 'page_id')}", "text"))
def web_addresses(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return structure.web_addresses(with_literals(rows, ADDRESSES), "page_id", F.col("text"))


WEB_LINKS = addresses_sql("page_id", "SELECT page_id, regexp_replace(url || ' ' || html, '[\"''<>]', ' ', 'g') AS text FROM pages", "text")


@query("web_links", WEB_LINKS)
def web_links(spark, sf_dir):
    return structure.web_links(table(spark, sf_dir, "pages"), "page_id", F.concat_ws(" ", "url", "html"))


@query("links_union", f"SELECT 'page' AS kind, page_id AS key, n, uri FROM ({WEB_LINKS}) UNION ALL SELECT 'document', doc_id, n, uri FROM ({MAIL_LINKS})")
def links_union(spark, sf_dir):
    web = web_links(spark, sf_dir).select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), "n", "uri")
    return web.unionByName(mail_links(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), "n", "uri"))


HOST = "(?i)^https?://([^/:?#]+)"


@query("link_hosts", f"SELECT lower(regexp_extract(uri, '{HOST}', 1)) AS host, count(*) AS links, count(DISTINCT page_id) AS pages FROM ({WEB_LINKS}) GROUP BY 1")
def link_hosts(spark, sf_dir):
    host = F.lower(F.regexp_extract("uri", HOST, 1)).alias("host")
    return web_links(spark, sf_dir).groupBy(host).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages"))


# --- needles of several words ------------------------------------------------------------------

PHRASES = ["of\nthe of  the OF THE ofthe of\u00a0the", "o\u00adf t\u00adhe end", "of, the"]


def phrase_sql(needle: str, source: str) -> str:
    pattern = search.phrase_pattern(needle).replace("'", "''")
    return (
        f"WITH d AS ({source}), l AS (SELECT *, lower(replace(replace(text, 'İ', 'i'), 'Σ', 'σ')) AS low FROM d), "
        f"p AS (SELECT doc_id, text, unnest(string_split_regex(low, '{pattern}')) AS piece, generate_subscripts(string_split_regex(low, '{pattern}'), 1) AS k, regexp_extract_all(low, '{pattern}') AS hits FROM l), "
        "s AS (SELECT *, length(piece) + sum(length(piece) + coalesce(length(hits[k]), 0)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(piece) - coalesce(length(hits[k]), 0) AS start FROM p) "
        'SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(hits[k]) AS BIGINT) AS "end", substr(text, CAST(start + 1 AS BIGINT), length(hits[k])) AS hit FROM s WHERE k <= len(hits)'
    )


@query("phrase_search", phrase_sql("of the", f"SELECT doc_id, text FROM documents UNION ALL {literal_rows(PHRASES)}"))
def phrase_search(spark, sf_dir):
    return search.phrase_hits(with_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), PHRASES), "of the")
