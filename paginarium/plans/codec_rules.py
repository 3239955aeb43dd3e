"""Queries on text strings and names as bytes. Their SQL works character by character, or byte by byte, on code points."""

from __future__ import annotations

from pyspark.sql import functions as F

from paginarium.functions import codecs
from paginarium.plans.registry import literal_rows, query, table, with_literals

TEXTS = ["plain", "", "naïve “quotes” – € ﬁn ž", "Ωmega", "\U0001f3a8 palette", "soft\xadhyphen", "bell\x07 kept", "del\x7f", "˘ˇˆ˙˝˛˚˜ŁŒŠŸŽıłœšž", "(round) \\ back", "\xa0 wide space", "last line\n", "Ωlast\n"]
DOCS = f"docs AS (SELECT doc_id, text FROM documents UNION ALL {literal_rows(TEXTS)})"
# Code points with a byte of their own and the bytes they have.
OWN = "[728, 711, 710, 729, 733, 731, 730, 732, 8226, 8224, 8225, 8230, 8212, 8211, 402, 8260, 8249, 8250, 8722, 8240, 8222, 8220, 8221, 8216, 8217, 8218, 8482, 64257, 64258, 321, 338, 352, 376, 381, 305, 322, 339, 353, 382, 8364]"
OWN_BYTES = "list_concat(range(24, 32), range(128, 159), [160])"
POINTS = f"""{DOCS}, points AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ''), lambda c: ord(c)) END AS cps FROM docs),
bytes AS (SELECT doc_id, text, cps, list_transform(cps, lambda p: CASE WHEN p < 24 OR (p >= 32 AND p < 127) OR (p > 160 AND p < 256 AND p <> 173) THEN p ELSE ({OWN_BYTES})[list_position({OWN}, p)] END) AS own FROM points),
spelled AS (SELECT doc_id, text, CASE WHEN list_contains(list_transform(own, lambda b: b IS NULL), true) THEN 'FEFF' || list_aggregate(list_transform(cps, lambda p: CASE WHEN p < 65536 THEN printf('%04X', p) ELSE printf('%04X%04X', 55296 + ((p - 65536) // 1024), 56320 + ((p - 65536) % 1024)) END), 'string_agg', '')
  ELSE coalesce(list_aggregate(list_transform(own, lambda b: printf('%02X', b)), 'string_agg', ''), '') END AS digits FROM bytes)"""


def documents(spark, sf_dir):
    return with_literals(table(spark, sf_dir, "documents").select("doc_id", "text"), TEXTS)


@query("text_string_bytes", f"WITH {POINTS} SELECT doc_id, md5(digits) AS bytes, starts_with(digits, 'FEFF') AS wide, CAST(length(digits) // 2 AS BIGINT) AS size, md5('<' || digits || '>') AS hex, text AS back FROM spelled WHERE text IS NOT NULL")
def text_string_bytes(spark, sf_dir):
    """Every text as a text string's bytes, in which encoding, how many, and the text read back from them."""
    data = F.col("data")
    rows = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", codecs.text_bytes(F.col("text")).alias("data"))
    return rows.select("doc_id", F.md5(F.hex(data).cast("binary")).alias("bytes"), F.hex(data).startswith("FEFF").alias("wide"), F.length(data).cast("long").alias("size"), F.md5(codecs.hex_string(data).cast("binary")).alias("hex"), codecs.bytes_text(data).alias("back"))


#: Bytes in hexadecimal digits: each mark, halves of pairs alone, odd ends, language codes, broken UTF-8, bytes without a character.
STRINGS = [
    ("FEFF00480069", "Hi"), ("FFFE48006900", "Hi"), ("EFBBBF4869", "Hi"), ("FEFFD83CDFA8", "\U0001f3a8"), ("FEFFD83C0041", "�A"), ("FEFFDFA8D83C", "��"), ("FEFF004100", "A"), ("FFFE410042", "A"),
    ("FEFF001B0065006E001B0041", "A"), ("EFBBBF411B656E", "A"), ("EFBBBF41FF42", "A�B"), ("80A018", "•€˘"), ("41AD9F7F", "A¤¤¤"), ("", ""), ("FE", "þ"), ("FEFF", ""), ("FFFE3CD8A8DF", "\U0001f3a8"), ("FEFFD83CD83CDFA8", "�\U0001f3a8"),
]
READ_SQL = ", ".join(f"({-1 - k}, '{t}')" for k, (_, t) in enumerate(STRINGS))
BYTE = "(strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1"


@query(
    "text_string_reads",
    f"""WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: {BYTE}) AS bytes FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, list_transform(bytes, lambda b: CASE WHEN b IN (127, 159, 173) THEN '¤' ELSE chr(CAST(coalesce(({OWN})[list_position({OWN_BYTES}, b)], b) AS INTEGER)) END) AS cs FROM b)
SELECT doc_id, coalesce(list_aggregate(cs, 'string_agg', ''), '') AS text FROM c UNION ALL SELECT CAST(doc_id AS BIGINT), text FROM (VALUES {READ_SQL}) AS literal(doc_id, text)""",
)
def text_string_reads(spark, sf_dir):
    """The UTF-8 bytes of every text read as a text string without a mark, and literal strings with marks; bytes without a character show as ¤."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    literal = spark.createDataFrame([(-1 - k, d) for k, (d, _) in enumerate(STRINGS)], "doc_id long, digits string").select("doc_id", F.unhex("digits").alias("data"))
    return rows.union(literal).select("doc_id", F.replace(codecs.bytes_text(F.col("data")), F.lit("\x00"), F.lit("¤")).alias("text"))


#: Written names and their bytes in hexadecimal digits: whole escapes, too short ones, digits that are none.
NAMES = [("#41", "41"), ("#4", "2334"), ("#411", "4131"), ("A#", "4123"), ("#zz", "00"), ("#4g", "40"), ("##41", "0431"), ("#c3#a9", "C3A9"), ("", ""), ("#23#41", "2341"), ("a#2", "612332")]
NAMES_SQL = ", ".join(f"({-1 - k}, '{n}', '{d}')" for k, (n, d) in enumerate(NAMES))


@query(
    "name_spellings",
    f"""WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS bytes FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, bytes, list_transform(bytes, lambda h: CASE WHEN h >= '80' OR h IN ('00', '09', '0A', '0C', '0D', '20', '23', '25', '28', '29', '2F', '3C', '3E', '5B', '5D', '7B', '7D') THEN '#' || h ELSE chr(CAST({BYTE} AS INTEGER)) END) AS parts,
  list_transform(bytes, lambda h: CASE h WHEN '0A' THEN '\\n' WHEN '0D' THEN '\\r' WHEN '28' THEN '\\(' WHEN '29' THEN '\\)' WHEN '5C' THEN '\\\\' ELSE chr(CAST({BYTE} AS INTEGER)) END) AS marked FROM b)
SELECT doc_id, md5(coalesce(list_aggregate(parts, 'string_agg', ''), '')) AS spelled, md5('(' || coalesce(list_aggregate(marked, 'string_agg', ''), '') || ')') AS literal, md5(coalesce(list_aggregate(bytes, 'string_agg', ''), '')) AS back FROM s
UNION ALL SELECT CAST(doc_id AS BIGINT), name, NULL, digits FROM (VALUES {NAMES_SQL}) AS literal(doc_id, name, digits)""",
)
def name_spellings(spark, sf_dir):
    """Every text as a name and as a literal string, the name read back; literal names with their bytes."""
    digest = lambda c: F.md5(c.cast("binary"))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    each = rows.select("doc_id", codecs.name_spelled(F.col("data")).alias("spelled"), codecs.literal_string(F.col("data")).alias("literal"))
    each = each.select("doc_id", digest(F.col("spelled")).alias("spelled"), digest(F.col("literal")).alias("literal"), digest(F.hex(codecs.name_bytes(F.col("spelled")))).alias("back"))
    names = spark.createDataFrame([(-1 - k, n) for k, (n, _) in enumerate(NAMES)], "doc_id long, spelled string")
    return each.union(names.select("doc_id", "spelled", F.lit(None).cast("string"), F.hex(codecs.name_bytes(F.col("spelled")))))
