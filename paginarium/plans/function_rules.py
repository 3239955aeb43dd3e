"""Queries on sampled functions, calculator programs, page images in two versions, and objects as typed JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from paginarium.functions import calculator
from paginarium.operators import objects, raster
from paginarium.plans.registry import query, table

# --- functions of a table of samples --------------------------------------------------

#: 3 x 4 points with two outputs each, a line of 5 points, a cube of 2 x 2 x 2 points.
PLANE = [7, 250, 30, 200, 90, 130, 15, 240, 60, 180, 120, 100, 40, 210, 100, 140, 170, 70, 90, 160, 150, 90, 255, 0]
LINE = [0, 4095, 1000, 3000, 2048]
CUBE = [0, 1, 3, 2, 1, 3, 0, 2]


def corner(values: str, cell: str, steps: list[tuple[str, str, int]], outputs: int, k: int) -> str:
    """The sum over a cell's corners, spelled out: steps are (place, part, most) of each axis."""
    terms = [("1.0", cell, 1)]
    for low, part, size in steps:
        terms = [(f"{w} * {side}", f"{at} + least({low} + {up}, {size - 1}) * {step}", step * size) for w, at, step in terms for up, side in ((0, f"(1 - {part})"), (1, part))]
    return " + ".join(f"{w} * {values}[CAST(({at}) * {outputs} + {k + 1} AS INTEGER)]" for w, at, _ in terms)


SAMPLED_SQL = f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 12 - 0.1 AS x, l_quantity AS y, l_tax * 10 AS z, {PLANE} AS p, {LINE} AS l, {CUBE} AS c FROM lineitem),
e AS (SELECT *, least(greatest(least(greatest(x, 0.0), 1.0) * 2, 0.0), 2.0) AS px, least(greatest((least(greatest(y, 10.0), 40.0) - 10) * 3.0 / 30, 0.0), 3.0) AS py,
 least(greatest(4 - least(greatest(x, 0.0), 1.0) * 5, 0.0), 4.0) AS lx, least(greatest(least(greatest(x, 0.0), 1.0), 0.0), 1.0) AS cx, least(greatest(least(greatest(y, 0.0), 50.0) / 50, 0.0), 1.0) AS cy, least(greatest(z, 0.0), 1.0) AS cz FROM x)
SELECT l_orderkey, l_linenumber, round(({corner('p', '0', [('floor(px)', '(px - floor(px))', 3), ('floor(py)', '(py - floor(py))', 4)], 2, 0)}) / 255, 9) AS plane_a,
 round(({corner('p', '0', [('floor(px)', '(px - floor(px))', 3), ('floor(py)', '(py - floor(py))', 4)], 2, 1)}) / 255 * 40 - 20, 9) AS plane_b,
 round(least(greatest(({corner('l', '0', [('floor(lx)', '(lx - floor(lx))', 5)], 1, 0)}) / 4095 * 1.5, 0.0), 1.0), 9) AS line,
 round(({corner('c', '0', [(f'floor({a})', f'({a} - floor({a}))', 2) for a in ('cx', 'cy', 'cz')], 1, 0)}) / 3, 9) AS cube FROM e"""


@query("sampled_functions", SAMPLED_SQL)
def sampled_functions(spark, sf_dir):
    """A plane of samples with two outputs, a line read backwards, a cube of packed samples, over the lines' amounts."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12 - 0.1).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_tax") * 10).alias("z"))
    rows = calculator.sampled(rows, [("x", 0, 1), ("y", 10, 40)], (3, 4), PLANE, 8, [("plane_a", 0, 1), ("plane_b", -20, 20)])
    rows = calculator.sampled(rows, [("x", 0, 1)], (5,), LINE, 12, [("line", 0, 1)], encode=[(4.0, -1.0)], decode=[(0.0, 1.5)])
    packed = calculator.packed_samples(bytes([0b00011110, 0b01110010]), 2, 8)
    rows = calculator.sampled(rows, [("x", 0, 1), ("y", 0, 50), ("z", 0, 1)], (2, 2, 2), packed, 2, [("cube", 0, 1)])
    return rows.select("l_orderkey", "l_linenumber", *(F.round(n, 9).alias(n) for n in ("plane_a", "plane_b", "line", "cube")))


# --- calculator programs --------------------------------------------------------------

INKS = "{ dup 0.84 mul exch 0.00 exch dup 0.44 mul exch 0.21 mul }"
CHOICES = "{ % the larger first, then one of three ways\n 2 copy lt { exch } if dup 0.04 gt { sub 2 exp } { dup 0 eq { pop pop 7 } { div } ifelse } ifelse }"
WHOLES = "{ cvi dup 7 mod exch dup 7 idiv 3 bitshift exch 5 and 3 1 roll add exch }"
DEPTHS = "{ dup 25 gt { 1 2 3 4 } if 3 index }"
CALCULATED_SQL = """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_discount AS FLOAT) AS d, CAST(l_tax AS FLOAT) AS t, CAST(l_quantity AS FLOAT) AS q, CAST(l_quantity AS INTEGER) AS i FROM lineitem),
y AS (SELECT *, CAST(0 AS FLOAT) AS zero, greatest(d, t) AS hi, least(d, t) AS lo FROM x)
SELECT l_orderkey, l_linenumber, d * '0.84'::FLOAT AS ink_c, zero AS ink_m, d * '0.44'::FLOAT AS ink_y, d * '0.21'::FLOAT AS ink_k,
  CAST(CASE WHEN lo > '0.04'::FLOAT THEN pow(CAST(hi - lo AS DOUBLE), 2) WHEN lo = 0 THEN 7 ELSE CAST(hi AS DOUBLE) / lo END AS FLOAT) AS choice,
  CAST(i % 7 + (i // 7) * 8 AS FLOAT) AS mixed, CAST(i & 5 AS FLOAT) AS bits, CASE WHEN q > 25 THEN CAST(1 AS FLOAT) END AS deep FROM y"""


@query("calculator_functions", CALCULATED_SQL)
def calculator_functions(spark, sf_dir):
    """Inks of a tint, a choice among three ways, whole numbers and bits, and a stack whose depth hangs on the row."""
    wide = (-1e30, 1e30)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    rows = calculator.calculated(rows, INKS, [("l_discount", 0, 1)], [(f"ink_{c}", 0, 1) for c in "cmyk"])
    rows = calculator.calculated(rows, CHOICES, [("l_discount", 0, 1), ("l_tax", 0, 1)], [("choice", *wide)])
    rows = calculator.calculated(rows, WHOLES, [("l_quantity", 0, 100)], [("mixed", *wide), ("bits", *wide)])
    rows = calculator.calculated(rows, DEPTHS, [("l_quantity", 0, 100)], [("below", *wide), ("deep", *wide)])
    return rows.drop("l_discount", "l_tax", "l_quantity", "below")


# --- page images in two versions ------------------------------------------------------

#: 40 vectors make an image of 40 rows of 64 samples; every third one is left as it is.
PIXELS = "CAST(least(greatest(floor(128 + 300 * CAST(embedding[x + 1] AS DOUBLE)), 0), 255) AS BIGINT)"
COMPARED_SQL = f"""WITH p AS (SELECT vec_id // 40 AS image, vec_id % 40 AS y, x, {PIXELS} AS a FROM embeddings, range(64) AS r(x)),
q AS (SELECT image, y, x, a, CASE WHEN image % 3 <> 0 AND (x * 7 + y * 5) % 31 = 0 THEN 255 - a ELSE a END AS b FROM p),
h AS (SELECT image, least(8, max(y) + 1) AS high, max(y) AS last FROM q GROUP BY image),
w AS (SELECT image, high, t.top, l.left_ FROM h, range(40) AS t(top), range(57) AS l(left_) WHERE top <= last + 1 - high),
s AS (SELECT w.image, top, left_, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS ab
      FROM w JOIN q ON q.image = w.image AND q.y >= top AND q.y < top + high AND q.x >= left_ AND q.x < left_ + 8 GROUP BY ALL),
m AS (SELECT image, avg((2 * ma * mb + 6.5025) * (2 * ab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) AS ssim FROM s GROUP BY image)
SELECT image, CAST(count(*) FILTER (a <> b) AS BIGINT) AS differing, max(abs(a - b)) AS largest, coalesce(min(x) FILTER (a <> b), -1) AS x0, coalesce(min(y) FILTER (a <> b), -1) AS y0,
  coalesce(max(x + 1) FILTER (a <> b), -1) AS x1, coalesce(max(y + 1) FILTER (a <> b), -1) AS y1, round(any_value(ssim), 8) AS ssim FROM q JOIN m USING (image) GROUP BY image"""


@query("page_images_compared", COMPARED_SQL)
def page_images_compared(spark, sf_dir):
    """Vectors as rows of gray images, against a version with some samples inverted; -1 where there is no box."""
    sample = lambda c: F.least(F.greatest(F.floor(128 + 300 * c.cast("double")), F.lit(0)), F.lit(255)).cast("int")
    left = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("image"), (F.col("vec_id") % 40).alias("y"), F.transform("embedding", sample).alias("samples"))
    turned = F.transform("samples", lambda s, x: F.when((F.col("image") % 3 != 0) & ((x * 7 + F.col("y") * 5) % 31 == 0), 255 - s).otherwise(s))
    found = raster.compared(left, left.withColumn("samples", turned))
    box = (F.coalesce(c, F.lit(-1)).alias(c) for c in ("x0", "y0", "x1", "y1"))
    return found.select("image", "differing", "largest", *box, F.round("ssim", 8).alias("ssim"))


# --- objects as typed JSON ------------------------------------------------------------

OBJECTS_SQL = """WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS odd FROM events)
SELECT event_id, '/Type' AS path, 'name' AS kind, event_type AS value FROM e
UNION ALL SELECT event_id, '/Parent', 'ref', user_id || ' 0' FROM e
UNION ALL SELECT event_id, '/Title', CASE WHEN odd THEN 'hex' ELSE 'string' END, CASE WHEN odd THEN lower(hex(encode(event_type || chr(1)))) ELSE event_type || '"' || chr(9) END FROM e
UNION ALL SELECT event_id, '/Props/k', 'int', CAST(k AS VARCHAR) FROM e WHERE k IS NOT NULL
UNION ALL SELECT event_id, '/Kids[' || i || ']', 'ref', (user_id + i) || ' 1' FROM e, range(3) AS r(i) WHERE i < event_id % 4
UNION ALL SELECT event_id, '/Kids', 'array', NULL FROM e WHERE event_id % 4 = 0
UNION ALL SELECT event_id, '/Half', 'real', '0.5' FROM e UNION ALL SELECT event_id, '/On', 'bool', CASE WHEN odd THEN 'true' ELSE 'false' END FROM e UNION ALL SELECT event_id, '/None', 'null', NULL FROM e"""


@query("typed_objects", OBJECTS_SQL)
def typed_objects(spark, sf_dir):
    """Events written as objects in typed JSON and read back leaf by leaf."""
    kind, odd = F.col("event_type"), F.col("event_id") % 3 == 0
    title = F.when(odd, F.concat(kind, F.lit("\x01"))).otherwise(F.concat(kind, F.lit('"\t')))
    kids = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("event_id") % 4), lambda i: objects.reference_json(F.col("user_id") + i, F.lit(1)))
    members = [
        ("Type", objects.name_json(kind)), ("Parent", objects.reference_json(F.col("user_id"), F.lit(0))), ("Title", objects.string_json(F.encode(title, "UTF-8"), title)), ("Props", F.col("props")),
        ("Kids", F.concat(F.lit("["), F.array_join(kids, ","), F.lit("]"))), ("Half", F.lit("0.5")), ("On", odd.cast("string")), ("None", F.lit("null")),
    ]
    return objects.leaves(table(spark, sf_dir, "events").select("event_id", objects.dictionary_json(members).alias("json")), "event_id", "json").withColumnRenamed("key", "event_id")
