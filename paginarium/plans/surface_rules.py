"""Queries on sinks, JSON, file types and the functions that SQL can call."""

from __future__ import annotations

from pyspark.sql import functions as F

from paginarium.functions import sql
from paginarium.plans.registry import TURNS, query, table, turns
from paginarium.plans.text_rules import literal_rows, with_literals
from paginarium.sources import writers


@query("texts_with_form_feeds", f"WITH {TURNS} SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(12) ORDER BY page)) AS text, CAST(sum(length(coalesce(text, ''))) + count(*) - 1 AS BIGINT) AS size FROM turns GROUP BY conv_id")
def texts_with_form_feeds(spark, sf_dir):
    found = writers.with_form_feeds(turns(spark, sf_dir), "conv_id", "page", "text")
    return found.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text"), F.length("text").cast("long").alias("size"))


@query("rows_as_json", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"empty\":null}' AS json FROM nation")
def rows_as_json(spark, sf_dir):
    return writers.as_json(table(spark, sf_dir, "nation").withColumn("empty", F.lit(None).cast("string")), ["n_nationkey", "n_name", "empty"])


# Endings of file names and their media types.
TYPES = {"txt": "text/plain", "csv": "text/csv", "xml": "application/xml", "json": "application/json", "html": "text/html", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
NAMES = ["a.TXT", "b.tar.json", "noending", ".pdf", "x.unknown", "photo.JPeG"]


@query(
    "media_types",
    f"WITH n AS (SELECT page_id, url FROM pages UNION ALL {literal_rows(NAMES, 'page_id', 'url')}) SELECT page_id, "
    + "CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " ELSE 'application/octet-stream' END AS media FROM n",
)
def media_types(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    ending = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))
    rows = with_literals(table(spark, sf_dir, "pages").select("page_id", "url"), NAMES)
    return rows.select("page_id", F.coalesce(F.try_element_at(known, ending), F.lit("application/octet-stream")).alias("media"))


@query(
    "form_functions_in_sql",
    r"""SELECT p_partkey, coalesce(TRY_CAST(replace(replace(p_brand, 'Brand#', ''), ',', '.') AS DOUBLE), 0) AS number,
regexp_matches(CAST(p_size AS VARCHAR), '^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-][0-9]+)?$') AS is_number, array_to_string(regexp_extract_all(p_brand || '/' || p_size, '[0-9]+'), '|') AS numbers,
p_size BETWEEN 5 AND 30 AS in_range, substr(p_name, 1, 2) || '--' || substr(p_name, 5) AS merged, array_to_string(list_transform(string_split(replace(p_type, ' ', ', '), ','), lambda x: trim(x, ' ')), '|') AS fields,
CASE WHEN p_size < 50 THEN p_size + 2000 ELSE p_size + 1900 END AS year, floor(p_retailprice * 1e6 + 0.49) / 1e6 AS price FROM part""",
)
def form_functions_in_sql(spark, sf_dir):
    sql.register(spark)
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "af_make_number(replace(p_brand, 'Brand#', '')) AS number", "af_is_number(string(p_size)) AS is_number", "array_join(af_extract_nums(concat(p_brand, '/', p_size)), '|') AS numbers",
        "af_range_ok(p_size, 5, 30) AS in_range", "af_merge_change(p_name, '--', 2, 4) AS merged", "array_join(af_split_fields(replace(p_type, ' ', ', ')), '|') AS fields",
        "af_expand_year(p_size) AS year", "af_six_places(p_retailprice) AS price",
    )


@query("first_seen_texts", "SELECT md5(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text")
def first_seen_texts(spark, sf_dir):
    """The batch form of the stream's first-seen filter: every distinct text, with the smallest id that has it."""
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    return table(spark, sf_dir, "documents").groupBy(digest).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


@query(
    "regions_reached",
    "SELECT CAST(n_nationkey AS BIGINT) AS node, 2 AS steps FROM nation UNION ALL SELECT 1000 + r_regionkey, 1 FROM region UNION ALL SELECT 5000, 0",
)
def regions_reached(spark, sf_dir):
    """The tree of a root, its regions and their nations, walked from the root."""
    from paginarium.operators import lookup

    top = table(spark, sf_dir, "region").select(F.lit(5000).cast("long").alias("src"), (F.col("r_regionkey") + 1000).cast("long").alias("dst"))
    leaves = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1000).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    return lookup.reachable(top.unionByName(leaves), spark.range(5000, 5001).select(F.col("id").alias("node")))
