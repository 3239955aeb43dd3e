"""Objects as typed JSON, there and back.

A name is {"name": "Type"}, a string {"string": "text"} or {"hex": "01ff"}, a reference
{"ref": [4, 0]}; numbers, truth values, null, arrays and objects are JSON's own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What no text has: controls but tab, line feed and carriage return, and the replacement character.
UNLIKE_TEXT = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FFFD}]"


def name_json(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("name")))


def reference_json(number: Column, generation: Column) -> Column:
    return F.to_json(F.struct(F.array(number, generation).alias("ref")))


def string_json(data: Column, text: Column) -> Column:
    """A string as its text, or as hexadecimal digits of its bytes where what it decodes to is no text."""
    return F.when(text.rlike(UNLIKE_TEXT), F.to_json(F.struct(F.lower(F.hex(data)).alias("hex")))).otherwise(F.to_json(F.struct(text.alias("string"))))


def dictionary_json(members: list[tuple[str, Column]]) -> Column:
    """An object of members that are JSON each; those that are null are left out."""
    spelled = [F.concat(F.lit(json.dumps(name) + ":"), value) for name, value in members]
    return F.concat(F.lit("{"), F.concat_ws(",", *spelled), F.lit("}"))


def classified(rows: DataFrame) -> DataFrame:
    """Open rows (no kind yet) get the kind of their value ``v``, null where it has parts, and what it holds as text."""
    v, shape, get = F.col("v"), F.col("shape"), lambda path: F.try_variant_get("v", path, "string")
    kind = F.when((shape == "OBJECT<ref: ARRAY<BIGINT>>") & get("$.ref[1]").isNotNull() & get("$.ref[2]").isNull(), F.lit("ref"))
    for name in ("name", "string", "hex"):
        kind = kind.when(shape == f"OBJECT<{name}: STRING>", F.lit(name))
    kind = (
        kind.when(shape == "OBJECT<>", F.lit("dict")).when((shape == "ARRAY<VOID>") & (F.to_json(v) == "[]"), F.lit("array")).when(shape == "VOID", F.lit("null")).when(shape == "BOOLEAN", F.lit("bool"))
        .when(shape == "BIGINT", F.lit("int")).when(shape.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit("real")).when(shape == "STRING", F.lit("text"))
    )
    now = F.col("now")
    value = F.when(now == "ref", F.concat_ws(" ", get("$.ref[0]"), get("$.ref[1]"))).when(now.isin("bool", "int", "real", "text"), get("$"))
    for name in ("name", "string", "hex"):
        value = value.when(now == name, get(f"$.{name}"))
    shaped = rows.select("key", "path", "v", "kind", "value", F.when(F.col("kind").isNull(), F.schema_of_variant("v")).alias("shape"))
    return shaped.select("key", "path", "v", "kind", "value", kind.alias("now")).select("key", "path", "v", F.coalesce("kind", now).alias("kind"), F.coalesce("value", value).alias("value"))


def leaves(rows: DataFrame, key: str, spelled: str, deepest: int = 8) -> DataFrame:
    """(key, path, kind, value) of every leaf of every row's object; arrays count from 0 in paths.

    Kinds are name, string, hex, ref, int, real, bool, null, text (a bare JSON string), and dict
    and array for empty ones. Rows grow in place level by level, so the table is read once. Text
    that is no JSON is one leaf of kind ``broken``; null gives no row. An object with more than
    ``deepest`` levels fails the job rather than lose what lies below.
    """
    v = F.col("v")
    out = rows.where(F.col(spelled).isNotNull()).select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(spelled).alias("v"), F.col(spelled).alias("json"))
    out = out.select("key", "path", "v", F.when(v.isNull(), F.lit("broken")).alias("kind"), F.when(v.isNull(), F.col("json")).alias("value"))
    for level in range(deepest + 1):
        out = classified(out)
        inner = F.col("kind").isNull()
        if level == deepest:
            return out.select("key", "path", F.when(inner, F.raise_error(F.lit(f"an object of more than {deepest} levels"))).otherwise(F.col("kind")).alias("kind"), "value")
        parts = rows.sparkSession.tvf.variant_explode_outer(F.when(F.col("kind").isNull(), F.col("v")).outer()).toDF("pos", "name", "part")
        step = F.when(F.col("name").isNotNull(), F.concat(F.lit("/"), "name")).when(F.col("pos").isNotNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.lit(""))
        out = out.lateralJoin(parts).select("key", F.concat("path", step).alias("path"), F.when(inner, F.col("part")).alias("v"), "kind", "value")
    return out
