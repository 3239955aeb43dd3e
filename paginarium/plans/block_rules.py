"""Queries on blocks, slices, orders and look-ups of a document, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paginarium.functions import forms, geometry as g, text, wrapping as w
from paginarium.operators import blocks
from paginarium.plans.page_rules import BOX_SQL
from paginarium.plans.registry import CLASS, LABELS, PAGE_LINES, RULES, WHITE, literal_rows, query, table, with_literals
from paginarium.plans.text_rules import joined_sql

DOCUMENTS = ["Intro line that is wrap-\nped here\n- first item\n- second * item\n\n1. one\n2) two\nEnd of\nit.", "• a\n• b", "only", "", *RULES[7:]]


def stripped_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{w.TRAILING}', ''), '{w.LEADING}', '')"


def escaped_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([*_`\[\]\\])', '\\\1', 'g'), '(^|\n)([#>+\-]|\\\*)', '\1\\\2', 'g')"


BARE = escaped_sql(stripped_sql(r"regexp_replace(line, '^[-•·‣◦▪*–\x{E000}-\x{F8FF}]+', '')"))
LABELLED = " ".join(f"WHEN regexp_matches(line, '^{p}[{WHITE}]{n}[^{WHITE}]') THEN regexp_extract(line, '^({p})', 1)" for p, n in LABELS)
NUMBER = "translate(regexp_extract(label, '([0-9０-９〇零一二三四五六七八九十百]+)[^0-9０-９〇零一二三四五六七八九十百]*$', 1), '０１２３４５６７８９', '0123456789')"
ITEM = {"bullet": f"'- ' || {BARE}", "numbered": f"{NUMBER} || '. ' || " + escaped_sql(stripped_sql("substr(line, length(label) + 1)"))}


@query(
    "markdown_documents",
    f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL {literal_rows(DOCUMENTS)}), l AS (SELECT doc_id, {PAGE_LINES} AS ls FROM d),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), c AS (SELECT *, {CLASS} AS class, CASE {LABELLED} END AS label FROM e),
m AS (SELECT *, CASE WHEN lag(class) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM class THEN 1 ELSE 0 END AS new FROM c),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM m),
b AS (SELECT doc_id, block, class, list(line ORDER BY i) AS body, string_agg(CASE class WHEN 'bullet' THEN {ITEM['bullet']} WHEN 'numbered' THEN {ITEM['numbered']} END, chr(10) ORDER BY i) AS items FROM r GROUP BY doc_id, block, class),
t AS (SELECT doc_id, block, CASE class WHEN 'body' THEN {escaped_sql(stripped_sql("list_reduce(list_prepend('', body), lambda a, b: " + joined_sql('a', 'b') + ")"))} ELSE items END AS part FROM b)
SELECT d.doc_id, CAST(count(block) AS INTEGER) AS blocks, md5(coalesce(string_agg(part, chr(10) || chr(10) ORDER BY block), '')) AS markdown FROM d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""",
)
def markdown_documents(spark, sf_dir):
    docs = with_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), DOCUMENTS)
    return blocks.markdown(docs, "doc_id").select("doc_id", "blocks", F.md5(F.col("markdown").cast("binary")).alias("markdown"))


REPEATS = ["a\nb\na\nc\nd\ne\nf\na", "7\nbody\nmore\nPage 3 of 9", "x\nx\nx", "- 1 -"]


@query(
    "lines_without_repeats",
    f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL {literal_rows(REPEATS)}), l AS (SELECT doc_id, {PAGE_LINES} AS ls FROM d),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
p AS (SELECT *, {', '.join(f'lag(line, {k}) OVER o AS b{k}' for k in range(1, 6))} FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS kept, md5(string_agg(line, chr(10) ORDER BY i)) AS text FROM p WHERE {' AND '.join(f'line IS DISTINCT FROM b{k}' for k in range(1, 6))} GROUP BY doc_id""",
)
def lines_without_repeats(spark, sf_dir):
    docs = with_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), REPEATS)
    kept = docs.select("doc_id", blocks.without_repeats(text.lines(F.col("text"))).alias("kept")).where(F.size("kept") > 0)
    return kept.select("doc_id", F.size("kept").cast("long").alias("kept"), F.md5(F.array_join("kept", "\n").cast("binary")).alias("text"))


FOLIO = f"(len(list_filter(string_split_regex(line, '[{w.SPACES}]+'), lambda x: x <> '')) > 0 AND len(list_filter(list_filter(string_split_regex(line, '[{w.SPACES}]+'), lambda x: x <> ''), lambda x: NOT regexp_matches(x, '{w.FOLIO_WORD}'))) = 0)"


@query(
    "lines_without_margins",
    f"""WITH d AS (SELECT doc_id, doc_id || chr(10) || text || chr(10) || 'Page ' || doc_id AS text FROM documents UNION ALL {literal_rows(REPEATS)}), l AS (SELECT doc_id, {PAGE_LINES} AS ls FROM d),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM l), m AS (SELECT *, greatest(1, CAST(ceil(n * 0.12) AS INTEGER)) AS band FROM e)
SELECT doc_id, count(*) AS kept, md5(string_agg(line, chr(10) ORDER BY i)) AS text FROM m WHERE NOT ((i <= band OR i > n - band) AND {FOLIO}) GROUP BY doc_id""",
)
def lines_without_margins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\nPage "), F.col("doc_id").cast("string")).alias("text"))
    kept = with_literals(docs, REPEATS).select("doc_id", blocks.without_margins(text.lines(F.col("text"))).alias("kept")).where(F.size("kept") > 0)
    return kept.select("doc_id", F.size("kept").cast("long").alias("kept"), F.md5(F.array_join("kept", "\n").cast("binary")).alias("text"))


SOFT = ["ab­cd\r\nef", "­", ""]


@query(
    "text_slices",
    f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL {literal_rows(SOFT)}), s AS (SELECT *, abs(doc_id) % 40 AS a, abs(doc_id) % 40 + abs(doc_id) % 90 AS b FROM d WHERE text IS NOT NULL) "
    "SELECT doc_id, CASE WHEN a < b AND b <= length(text) THEN substr(text, a + 1, b - a) ELSE '' END AS slice, length(regexp_replace(substr(text, 1, b), '[\\x{AD}\\r]', '', 'g')) AS at FROM s",
)
def text_slices(spark, sf_dir):
    docs = with_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), SOFT).where("text IS NOT NULL")
    first = (F.abs("doc_id") % 40).cast("int")
    last = (F.abs("doc_id") % 40 + F.abs("doc_id") % 90).cast("int")
    return docs.select("doc_id", blocks.text_slice(F.col("text"), first, last).alias("slice"), blocks.text_index(F.col("text"), last).cast("long").alias("at"))


@query(
    "reading_order",
    f"WITH b AS (SELECT vec_id, label, {BOX_SQL} FROM embeddings) SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY y1 DESC, x0, vec_id) AS INTEGER) AS place FROM b",
)
def reading_order(spark, sf_dir):
    boxes = table(spark, sf_dir, "embeddings").select("vec_id", "label", g.normalised(g.as_box(F.slice("embedding", 1, 4))).alias("box"))
    return blocks.reading_order(boxes, "label", "vec_id").select("vec_id", "label", "place")


@query(
    "calculation_order",
    "WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey END AS listed FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY listed ASC NULLS LAST, l_linenumber) AS INTEGER) AS turn FROM f",
)
def calculation_order(spark, sf_dir):
    fields = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey")).alias("listed"))
    return blocks.calculation_order(fields, "l_orderkey", "listed", "l_linenumber").select("l_orderkey", "l_linenumber", "turn")


# Positions of the flags of form fields, from 1.
FIELD_FLAGS = {"read_only": 1, "required": 2, "no_export": 3, "multiline": 13, "password": 14, "no_toggle_off": 15, "radio": 16, "push_button": 17, "combo": 18, "editable": 19, "comb": 25}


@query("field_flags", "SELECT o_orderkey, " + ", ".join(f"((o_custkey * 40503 + o_orderkey) >> {p - 1}) & 1 = 1 AS {n}" for n, p in FIELD_FLAGS.items()) + " FROM orders")
def field_flags(spark, sf_dir):
    bits = F.col("o_custkey") * 40503 + F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[forms.flag(bits, p).alias(n) for n, p in FIELD_FLAGS.items()])


@query(
    "revision_table",
    "WITH r AS (SELECT l_orderkey // 100 AS revision, count(*) AS entries, count(DISTINCT l_partkey) AS keys, sum(l_linenumber) AS size FROM lineitem GROUP BY 1) "
    "SELECT revision, entries, keys, CAST(sum(size) OVER (ORDER BY revision) AS BIGINT) AS ends_at FROM r",
)
def revision_table(spark, sf_dir):
    """Revisions with their entries and where each ends. Counted first: the ordered sum runs over one row a revision."""
    from pyspark.sql import Window

    found = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 100).alias("revision")).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("l_partkey").alias("keys"), F.sum("l_linenumber").alias("size"))
    chunk = found.withColumn("chunk", F.floor(F.col("revision") / 4096))
    ends = Window.partitionBy("chunk").orderBy("revision")
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row for 4096 revisions
    sums = chunk.groupBy("chunk").agg(F.sum("size").alias("s")).select("chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    return chunk.withColumn("within", F.sum("size").over(ends)).join(sums, "chunk").select("revision", "entries", "keys", (F.col("before") + F.col("within")).alias("ends_at"))


@query(
    "destination_pages",
    "SELECT s_suppkey, coalesce(n.n_regionkey, r.r_regionkey, -1) AS page, n.n_nationkey IS NOT NULL AS by_tree FROM supplier LEFT JOIN nation n ON n.n_nationkey = s_nationkey AND n.n_nationkey % 3 > 0 LEFT JOIN region r ON r.r_regionkey = s_nationkey % 7",
)
def destination_pages(spark, sf_dir):
    """A destination by name: the tree first, the older table where the tree lacks it; -1 where both do."""
    tree = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("in_tree"))
    older = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("old_key"), F.col("r_regionkey").alias("in_table"))
    found = table(spark, sf_dir, "supplier").join(tree, "s_nationkey", "left").join(older, F.col("s_nationkey") % 7 == F.col("old_key"), "left")
    return found.select("s_suppkey", F.coalesce("in_tree", "in_table", F.lit(-1)).alias("page"), F.col("in_tree").isNotNull().alias("by_tree"))


# Tags that stand for others, and what they stand for in the end.
ROLES = {"click": "act", "act": "P", "view": "see", "see": "watch", "watch": "H1", "loop": "loop"}


@query(
    "mapped_roles",
    "SELECT event_id, CASE event_type " + "WHEN 'click' THEN 'P' WHEN 'view' THEN 'H1' ELSE event_type END AS role FROM events",
)
def mapped_roles(spark, sf_dir):
    """A tag by the role map, followed up to four times; a tag that the map lacks stands for itself."""
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.col("event_type"), lambda r, _: F.coalesce(F.try_element_at(roles, r), r))
    return table(spark, sf_dir, "events").select("event_id", role.alias("role"))
