"""Queries on boxes, matrices, colours, running headers and digests, with their SQL.

Components of ``embeddings`` stand for the numbers of arrays in a document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paginarium.functions import geometry as g
from paginarium.operators import structure
from paginarium.plans.registry import HEADED, KEY, PAGE_LINES, TURNS, headed, query, table

NINE = 9


def part(first: int, n: int):
    return F.slice("embedding", first + 1, n)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def flat(found, names, prefix):
    return [F.round(found[k], NINE).alias(f"{prefix}_{k}") for k in names]


E = "CAST(embedding[{}] AS DOUBLE)".format
BOX_SQL = f"least({E(1)}, {E(3)}) AS x0, least({E(2)}, {E(4)}) AS y0, greatest({E(1)}, {E(3)}) AS x1, greatest({E(2)}, {E(4)}) AS y1"
MATRIX_SQL = ", ".join(f"{E(k + 5)} AS {n}" for k, n in enumerate("abcdef"))
CORNERS = [(x, y) for y in ("y0", "y1") for x in ("x0", "x1")]
XS, YS = (", ".join(f"m{p} * {x} + m{q} * {y} + m{r}" for x, y in CORNERS) for p, q, r in (("a", "c", "e"), ("b", "d", "f")))


@query(
    "boxes_under_matrices",
    f"WITH b AS (SELECT vec_id, label, {BOX_SQL}, {', '.join(f'{E(k + 5)} AS m{n}' for k, n in enumerate('abcdef'))} FROM embeddings) "
    f"SELECT vec_id, round(x0, {NINE}) AS box_x0, round(y0, {NINE}) AS box_y0, round(x1, {NINE}) AS box_x1, round(y1, {NINE}) AS box_y1, "
    f"round(least({XS}), {NINE}) AS to_x0, round(least({YS}), {NINE}) AS to_y0, round(greatest({XS}), {NINE}) AS to_x1, round(greatest({YS}), {NINE}) AS to_y1, "
    f"round(CASE WHEN atan2(mc, ma) < 0 THEN atan2(mc, ma) + 6.283185307179586 ELSE atan2(mc, ma) END, {NINE}) AS angle FROM b",
)
def boxes_under_matrices(spark, sf_dir):
    each = vectors(spark, sf_dir).select("vec_id", g.normalised(g.as_box(part(0, 4))).alias("box"), g.as_matrix(part(4, 6)).alias("m"))
    each = each.withColumn("to", g.transformed(F.col("m"), F.col("box")))
    return each.select("vec_id", *flat(F.col("box"), g.BOX, "box"), *flat(F.col("to"), g.BOX, "to"), F.round(g.angle(F.col("m")), NINE).alias("angle"))


@query(
    "box_unions",
    f"WITH b AS (SELECT label, vec_id, {BOX_SQL} FROM embeddings) SELECT label, count(*) AS boxes, round(min(x0), {NINE}) AS all_x0, round(min(y0), {NINE}) AS all_y0, round(max(x1), {NINE}) AS all_x1, round(max(y1), {NINE}) AS all_y1, "
    f"round(sum((greatest(x1, 0.1) - least(x0, 0.0)) * (greatest(y1, 0.1) - least(y0, 0.0))), 6) AS area FROM b GROUP BY label",
)
def box_unions(spark, sf_dir):
    each = vectors(spark, sf_dir).select("label", g.normalised(g.as_box(part(0, 4))).alias("box"))
    corner = g.struct_of(g.BOX, [F.lit(v) for v in (0.0, 0.0, 0.1, 0.1)])
    each = each.withColumn("wide", g.union(F.col("box"), corner))
    area = (F.col("wide.x1") - F.col("wide.x0")) * (F.col("wide.y1") - F.col("wide.y0"))
    found = each.groupBy("label").agg(F.count(F.lit(1)).alias("boxes"), g.union_of(F.col("box")).alias("box"), F.round(F.sum(area), 6).alias("area"))
    return found.select("label", "boxes", *flat(F.col("box"), g.BOX, "all"), "area")


DET = "(a * d - b * c)"
INVERSE = [f"d / {DET}", f"-b / {DET}", f"-c / {DET}", f"a / {DET}", f"(c * f - d * e) / {DET}", f"(b * e - a * f) / {DET}"]
TURNS_SQL = (("1", "0", "0", "1", "-x0", "-y0"), ("0", "-1", "1", "0", "-y0", "x1"), ("-1", "0", "0", "-1", "x1", "y1"), ("0", "1", "-1", "0", "y1", "-x0"))


def turned_sql(k: int) -> str:
    return "CASE vec_id % 4 " + " ".join(f"WHEN {q} THEN {t[k]}" for q, t in enumerate(TURNS_SQL)) + " END"


@query(
    "matrix_inverses",
    f"WITH m AS (SELECT vec_id, {BOX_SQL}, " + ", ".join(f"CASE WHEN vec_id % 7 = 0 THEN {1.0 if n in 'ad' else 0.0} ELSE CASE WHEN vec_id % 5 = 0 AND '{n}' IN ('c', 'd') THEN 0 ELSE {E(k + 5)} END END AS {n}" for k, n in enumerate("abcdef"))
    + " FROM embeddings) SELECT vec_id, " + ", ".join(f"CASE WHEN {DET} = 0 THEN 0 ELSE round({x} * {DET}, {NINE}) + 0.0 END AS inv_{n}" for x, n in zip(INVERSE, "abcdef"))
    + ", " + ", ".join(f"round(CAST({turned_sql(k)} AS DOUBLE), {NINE}) + 0.0 AS show_{n}" for k, n in enumerate("abcdef")) + " FROM m",
)
def matrix_inverses(spark, sf_dir):
    plain = F.transform(part(4, 6), lambda x, k: F.when((F.col("vec_id") % 5 == 0) & k.isin(2, 3), 0.0).otherwise(x.cast("double")))
    values = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<double>")).otherwise(plain)  # not six numbers: the identity
    each = vectors(spark, sf_dir).select("vec_id", g.normalised(g.as_box(part(0, 4))).alias("box"), g.as_matrix(values).alias("m"))
    each = each.select("vec_id", "box", "m", g.inverse_or_zero(F.col("m")).alias("inverse"), g.display_matrix(F.col("vec_id"), F.col("box")).alias("show"))
    det = F.col("m.a") * F.col("m.d") - F.col("m.b") * F.col("m.c")
    return each.select("vec_id", *[(F.round(F.col(f"inverse.{n}") * det, NINE) + 0.0).alias(f"inv_{n}") for n in g.MATRIX], *[(F.round(F.col(f"show.{n}"), NINE) + 0.0).alias(f"show_{n}") for n in g.MATRIX])  # no negative zeros


@query(
    "quad_boxes",
    "SELECT vec_id, q, " + ", ".join(f"CASE WHEN q < 8 THEN round(CAST(embedding[q * 8 + {k + 1}] AS DOUBLE), {NINE}) ELSE 0 END AS {n}" for k, n in zip((4, 5, 2, 3), g.BOX))
    + " FROM embeddings, (VALUES (0), (3), (8)) AS quads(q)",
)
def quad_boxes(spark, sf_dir):
    each = [vectors(spark, sf_dir).select("vec_id", F.lit(q).alias("q"), g.quad_box(F.col("embedding"), q).alias("box")) for q in (0, 3, 8)]
    found = each[0].unionByName(each[1]).unionByName(each[2])
    return found.select("vec_id", "q", *[F.round(F.col(f"box.{n}"), NINE).alias(n) for n in g.BOX])


# --- colours ----------------------------------------------------------------------------------

SIX = 6
GAMMA, CALIBRATION, D65 = (2.2, 2.2, 2.2), (0.4124, 0.2126, 0.0193, 0.3576, 0.7152, 0.1192, 0.1805, 0.0722, 0.9505), (0.9505, 1.0, 1.089)


def rgb_sql(x: str, y: str, z: str, white, prefix: str) -> str:
    out = []
    for name, row in zip(g.COLOUR, g.from_xyz(white)):
        light = f"greatest(least({row[0]!r} * ({x}) + {row[1]!r} * ({y}) + {row[2]!r} * ({z}), 1.0), 0.0)"
        out.append(f"round(CASE WHEN {light} <= 0.0031308 THEN {light} * 12.92 ELSE pow({light}, 1 / 2.4) * 1.055 - 0.055 END, {SIX}) AS {prefix}_{name}")
    return ", ".join(out)


def back_sql(v: str) -> str:
    return f"CASE WHEN {v} < 0.2069 THEN ({v} - 0.1379) * 0.12842 ELSE ({v}) * ({v}) * ({v}) END"


M_SQL = "((light + 16) / 116)"
LINEAR = [" + ".join(f"{CALIBRATION[k + 3 * j]!r} * pow({c}, 2.2)" for j, c in enumerate("pqs")) for k in range(3)]


@query(
    "colours_to_rgb",
    f"WITH c AS (SELECT vec_id, abs({E(1)}) * 2 AS p, abs({E(2)}) * 2 AS q, abs({E(3)}) * 2 AS s, abs({E(4)}) * 200 AS light, {E(5)} * 200 AS ca, {E(6)} * 200 AS cb FROM embeddings) "
    f"SELECT vec_id, round(greatest(least(p, 1.0), 0.0), {SIX}) AS gray_r, {rgb_sql(*LINEAR, D65, 'cal')}, "
    f"{rgb_sql('(' + back_sql(f'({M_SQL} + ca / 500)') + ') * 0.957', back_sql(M_SQL), '(' + back_sql(f'({M_SQL} - cb / 200)') + ') * 1.0889', g.WHITE, 'lab')} FROM c",
)
def colours_to_rgb(spark, sf_dir):
    at = lambda k, scale: g.number_at(F.col("embedding"), k) * scale
    each = vectors(spark, sf_dir).select("vec_id", *[F.abs(at(k, 2)).alias(c) for k, c in enumerate("pqs")], F.abs(at(3, 200)).alias("light"), at(4, 200).alias("ca"), at(5, 200).alias("cb"))
    cal, lab = g.calibrated_rgb(F.col("p"), F.col("q"), F.col("s"), GAMMA, CALIBRATION, D65), g.lab_to_rgb(F.col("light"), F.col("ca"), F.col("cb"))
    found = each.select("vec_id", g.gray_to_rgb(F.col("p")).alias("gray"), cal.alias("cal"), lab.alias("lab"))
    return found.select("vec_id", F.round("gray.r", SIX).alias("gray_r"), *[F.round(f"{s}.{n}", SIX).alias(f"{s}_{n}") for s in ("cal", "lab") for n in g.COLOUR])


# --- running headers, revisions, digests ---------------------------------------------------------

BAND_SQL = "greatest(1, CAST(ceil(len(ls) * 0.12) AS INTEGER))"


@query(
    "without_running_headers",
    f"""WITH {TURNS}, h AS ({HEADED}), l AS (SELECT conv_id, page, {PAGE_LINES} AS ls FROM h),
e AS (SELECT conv_id, page, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n, {BAND_SQL} AS band FROM l),
k AS (SELECT conv_id, page, i, line, {KEY} AS key, CASE WHEN i <= band THEN 'top' WHEN i > n - band THEN 'bottom' END AS place FROM e),
t AS (SELECT conv_id, count(DISTINCT page) AS total FROM turns GROUP BY conv_id),
r AS (SELECT k.conv_id, place, key FROM k JOIN t USING (conv_id) WHERE place IS NOT NULL GROUP BY k.conv_id, place, key, total HAVING count(DISTINCT page) >= 3 AND count(DISTINCT page) * 2 > total)
SELECT k.conv_id, k.page, count(*) AS kept, md5(string_agg(line, chr(10) ORDER BY i)) AS text FROM k LEFT JOIN r ON r.conv_id = k.conv_id AND r.place = k.place AND r.key = k.key WHERE r.key IS NULL GROUP BY k.conv_id, k.page""",
)
def without_running_headers(spark, sf_dir):
    found = structure.without_running(headed(spark, sf_dir), "conv_id", "page")
    return found.select("conv_id", "page", F.size("lines").cast("long").alias("kept"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("text"))


@query(
    "revision_view",
    "SELECT l_partkey AS key, max(l_orderkey) AS revision, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS value, count(*) AS versions FROM lineitem WHERE l_orderkey <= 900 GROUP BY l_partkey",
)
def revision_view(spark, sf_dir):
    """Each key as of revision 900: its newest entry among those up to it."""
    return structure.as_of_revision(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber", "l_quantity"), "key", "l_orderkey", "l_linenumber", "l_quantity", 900)


@query("ciphered_texts", "SELECT doc_id, md5(text) AS text, sha1(text) AS sha1, (octet_length(encode(text)) // 16 + 1) * 16 + 16 AS sealed_bytes, true AS differs FROM documents")
def ciphered_texts(spark, sf_dir):
    """AES in CBC mode and back: what comes out is digested, so both directions run."""
    key = F.unhex(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 32))
    start = F.unhex(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 32))
    sealed = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", key.alias("key"), F.aes_encrypt(F.col("text"), key, F.lit("CBC"), F.lit("PKCS"), start).alias("sealed"))
    opened = F.aes_decrypt("sealed", "key", F.lit("CBC"), F.lit("PKCS"))
    return sealed.select("doc_id", F.md5(opened).alias("text"), F.sha1(opened).alias("sha1"), F.octet_length("sealed").cast("long").alias("sealed_bytes"), (F.col("sealed") != F.col("text").cast("binary")).alias("differs"))
