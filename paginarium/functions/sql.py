"""The form functions under names that SQL can call: temporary SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, body)
FUNCTIONS = {
    "af_make_number": ("text STRING", "DOUBLE", "coalesce(try_cast(replace(trim(text), ',', '.') AS DOUBLE), 0D)"),
    "af_is_number": ("text STRING", "BOOLEAN", r"text RLIKE '^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-][0-9]+)?$'"),
    "af_extract_nums": ("text STRING", "ARRAY<STRING>", "CASE WHEN size(regexp_extract_all(text, '([0-9]+)')) > 0 THEN CASE WHEN text RLIKE '^[.,]' THEN concat(array('0'), regexp_extract_all(text, '([0-9]+)')) ELSE regexp_extract_all(text, '([0-9]+)') END END"),
    "af_range_ok": ("value DOUBLE, low DOUBLE, high DOUBLE", "BOOLEAN", "(low IS NULL OR value >= low) AND (high IS NULL OR value <= high)"),
    "af_merge_change": ("value STRING, typed STRING, first INT, last INT", "STRING", "concat(CASE WHEN first >= 0 THEN substring(value, 1, first) ELSE value END, typed, substring(value, greatest(last, 0) + 1))"),
    "af_split_fields": ("names STRING", "ARRAY<STRING>", "transform(CASE WHEN element_at(split(names, ',', -1), -1) = '' THEN slice(split(names, ',', -1), 1, size(split(names, ',', -1)) - 1) ELSE split(names, ',', -1) END, x -> trim(BOTH ' ' FROM x))"),
    "af_expand_year": ("year INT", "INT", "CASE WHEN year BETWEEN 0 AND 49 THEN year + 2000 WHEN year BETWEEN 50 AND 99 THEN year + 1900 ELSE year END"),
    "af_six_places": ("x DOUBLE", "DOUBLE", "floor(x * 1e6 + 0.49D) / 1e6D"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        body = body.replace("\\", "\\\\")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
