"""Two versions of page images compared: samples that differ, the box around them, structural similarity.

An image is a table of its rows: (image, y, samples), gray samples of 0 to 255 as an array.
Rows are dealt in bands; a band also gets the rows above it that its windows reach into, so
no task has to hold an image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the measure: window side, stabilisers of means and variances.
SIDE = 8
STEADY_MEAN = (0.01 * 255.0) ** 2
STEADY_VARIANCE = (0.03 * 255.0) ** 2
WHITE = 255
#: Rows of a band.
BAND = 256


def luma(red, green, blue, alpha):
    """The gray value of a colour over white."""
    over = [c * (alpha / F.lit(255.0)) + 255.0 * (1 - alpha / F.lit(255.0)) for c in (red, green, blue)]
    return 0.299 * over[0] + 0.587 * over[1] + 0.114 * over[2]


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """(image, y, a, b): rows of both versions side by side, null where a version has none."""
    a, b = left.select("image", "y", F.col("samples").alias("a")), right.select("image", "y", F.col("samples").alias("b"))
    return a.join(b, ["image", "y"], "full")


def differences(rows: DataFrame) -> DataFrame:
    """(image, differing, largest, x0, y0, x1, y1): samples beyond a version's edge count as white; no box where nothing differs."""
    gap = F.transform(
        F.sequence(F.lit(0), F.greatest(F.coalesce(F.size("a"), F.lit(0)), F.coalesce(F.size("b"), F.lit(0)), F.lit(1)) - 1),
        lambda x: F.abs(F.coalesce(F.get("a", x), F.lit(WHITE)) - F.coalesce(F.get("b", x), F.lit(WHITE))),
    )
    at = rows.select("image", F.col("y").cast("long").alias("y"), gap.alias("gap")).select(
        "image", "y", F.array_max("gap").alias("largest"), F.size(F.filter("gap", lambda g: g > 0)).cast("long").alias("n"),
        (F.array_position(F.transform("gap", lambda g: g > 0), F.lit(True)) - 1).alias("x0"),
        (F.size("gap") + 1 - F.array_position(F.reverse(F.transform("gap", lambda g: g > 0)), F.lit(True))).alias("x1"),
    )
    some = F.col("n") > 0
    return at.groupBy("image").agg(
        F.sum("n").alias("differing"), F.max("largest").cast("long").alias("largest"),
        F.min(F.when(some, F.col("x0"))).alias("x0"), F.min(F.when(some, F.col("y"))).alias("y0"), F.max(F.when(some, F.col("x1"))).alias("x1"), F.max(F.when(some, F.col("y") + 1)).alias("y1"),
    )


def similarity(rows: DataFrame) -> DataFrame:
    """(image, ssim): the mean over all whole windows of 8 x 8 samples; a smaller image is one window.

    Versions of one size only: null where any row lacks a counterpart or differs in length, or
    where rows of an image differ in length. Equal images have exactly 1.
    """
    width = F.size("a")
    shape = rows.groupBy("image").agg(
        F.max(F.col("a").isNull() | F.col("b").isNull() | (F.size("a") != F.size("b"))).alias("apart"), F.max(F.coalesce(F.col("a") != F.col("b"), F.lit(True))).alias("changed"),
        F.max(width).alias("w"), F.min(width).alias("least"), (F.max("y") - F.min("y") + 1).cast("int").alias("h"), F.count(F.lit(1)).alias("n"), F.min("y").alias("first"),
    )
    shape = shape.withColumn("even", ~F.col("apart") & (F.col("w") == F.col("least")) & (F.col("h") == F.col("n")) & (F.col("w") > 0))
    todo = rows.join(shape.where("even AND changed").select("image", "w", "h", "first"), "image")
    # Sums over each row's windows, exact while samples are whole numbers.
    across = F.least(F.col("w"), F.lit(SIDE))
    def run(of):
        return lambda x: F.aggregate(F.sequence(F.lit(1), across), F.lit(0.0), lambda s, k: s + of(x + k - 1))

    a, b = (lambda k: F.get("a", k)), (lambda k: F.get("b", k))
    runs = {"a": run(a), "b": run(b), "aa": run(lambda k: a(k) * a(k)), "bb": run(lambda k: b(k) * b(k)), "ab": run(lambda k: a(k) * b(k))}
    sums = F.transform(F.sequence(F.lit(0), F.col("w") - across), lambda x: F.named_struct(F.lit("x"), x, *(part for n, f in runs.items() for part in (F.lit(n), f(x)))))
    # A row serves its own band, and the next one where that one's windows begin in it.
    row = (F.col("y") - F.col("first")).cast("int")
    bands = F.array_distinct(F.array(F.floor(row / BAND), F.floor((row + SIDE - 1) / BAND)))
    each = todo.select("image", "w", "h", row.alias("y"), F.explode(bands).alias("band"), sums.alias("sums")).select("image", "w", "h", "y", "band", F.inline("sums"))
    down = Window.partitionBy("image", "band", "x").orderBy("y").rowsBetween(1 - SIDE, 0)
    high = F.least(F.col("h"), F.lit(SIDE))
    total = [F.sum(c).over(down).alias(c) for c in ("a", "b", "aa", "bb", "ab")]
    windows = each.select("image", "w", "h", "y", "band", F.count(F.lit(1)).over(down).alias("tall"), *total)
    windows = windows.where((F.col("tall") == high) & (F.floor(F.col("y") / BAND) == F.col("band")))
    n = (across * high).cast("double")
    spread, mean_a, mean_b = F.greatest(n - 1, F.lit(1.0)), F.col("a") / n, F.col("b") / n
    var_a, var_b, both = (F.col("aa") - F.col("a") * mean_a) / spread, (F.col("bb") - F.col("b") * mean_b) / spread, (F.col("ab") - F.col("a") * mean_b) / spread
    score = (2 * mean_a * mean_b + STEADY_MEAN) * (2 * both + STEADY_VARIANCE) / ((mean_a * mean_a + mean_b * mean_b + STEADY_MEAN) * (var_a + var_b + STEADY_VARIANCE))
    scores = windows.select("image", "band", score.alias("s")).groupBy("image").agg(F.avg("s").alias("s"))
    return shape.join(scores, "image", "left").select("image", F.when(F.col("even"), F.when(F.col("changed"), F.col("s")).otherwise(F.lit(1.0))).alias("ssim"))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """(image, differing, largest, x0, y0, x1, y1, ssim) of two versions of each image; nulls in ``image`` or ``y`` take no part."""
    known = "image IS NOT NULL AND y IS NOT NULL AND samples IS NOT NULL"
    rows = paired(left.where(known), right.where(known))
    return differences(rows).join(similarity(rows), "image")
