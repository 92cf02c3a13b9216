"""Operators over labelled images: pixels(frame, y, x, label, dc, ac), label 0 being background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def relabel(pixels: DataFrame) -> DataFrame:
    """Labels 1..k without gaps in each frame, in the old order; background stays 0.

    The map has a row per label and frame and is joined back; pixels aren't sorted, and the background, often most of a frame, isn't joined."""
    cells = pixels.filter("label <> 0")
    names = cells.select("frame", "label").distinct()
    names = names.withColumn("new", F.dense_rank().over(Window.partitionBy("frame").orderBy("label")))
    x = cells.join(names, ["frame", "label"])
    x = x.withColumn("label", F.col("new").cast(pixels.schema["label"].dataType)).select(pixels.columns)
    return x.union(pixels.filter("label IS NULL OR label = 0").withColumn("label", F.lit(0).cast(pixels.schema["label"].dataType)).select(pixels.columns))


def at_pixel(frame: int, y: int, x: int) -> Column:
    return (F.col("frame") == frame) & (F.col("y") == y) & (F.col("x") == x)


def pick(pixels: DataFrame, frame: int, y: int, x: int) -> DataFrame:
    """The label at a pixel; no row outside the image."""
    return pixels.filter(at_pixel(frame, y, x)).select("label")


def change(pixels: DataFrame, frame: int, y: int, x: int, to: int) -> DataFrame:
    """All pixels of the label at (y, x) of a frame become `to` (0 deletes them), then relabel()."""
    old = F.broadcast(pick(pixels, frame, y, x).filter("label <> 0").select(F.lit(frame).alias("frame"), F.col("label").alias("old")))  # one row
    x_ = pixels.join(old, "frame", "left")
    return relabel(x_.withColumn("label", F.when(F.col("label") == F.col("old"), F.lit(to).cast(pixels.schema["label"].dataType)).otherwise(F.col("label"))).select(pixels.columns))


def paint(pixels: DataFrame, strokes: DataFrame) -> DataFrame:
    """strokes(frame, y, x, brush) set the label of the pixels they cover."""
    x = pixels.join(strokes, ["frame", "y", "x"], "left")
    return x.withColumn("label", F.coalesce(F.col("brush").cast(pixels.schema["label"].dataType), "label")).select(pixels.columns)


def square(spark, frame: int, y: int, x: int, radius: int, brush: int) -> DataFrame:
    """Strokes of a square brush around (y, x)."""
    side = 2 * radius + 1
    return spark.range(side * side).select(F.lit(frame).alias("frame"), (F.expr(f"id div {side}") + (y - radius)).alias("y"), (F.expr(f"id % {side}") + (x - radius)).alias("x"), F.lit(brush).alias("brush"))


def count_labels(pixels: DataFrame) -> DataFrame:
    """frame, n_labels: distinct labels with background, so the next free one."""
    return pixels.groupBy("frame").agg(F.countDistinct("label").alias("n_labels"))


def _places() -> list[Column]:
    return [F.avg("y").alias("com_y"), F.avg("x").alias("com_x"), F.count("*").alias("area")]


def _sums(a: str, b: str) -> Column:
    """n, the rows with both of two whole numbers, and moment, n * n times their population covariance. Products are summed by their upper and lower 32 bits, as the whole sum may pass 64."""
    a, b = f"CAST({a} AS BIGINT)", f"CAST({b} AS BIGINT)"
    n = f"CAST(count({a} * {b}) AS DECIMAL(20, 0))"
    products = f"(CAST(sum(shiftright({a} * {b}, 32)) AS DECIMAL(38, 0)) * {2**32} + sum({a} * {b} & {2**32 - 1}))"
    totals = [f"CAST(sum(CASE WHEN {other} IS NOT NULL THEN {c} END) AS DECIMAL(38, 0))" for c, other in ((a, b), (b, a))]
    return F.expr(f"named_struct('n', {n}, 'moment', {n} * {products} - {totals[0]} * {totals[1]})")


def _covariance(s: str) -> Column:
    """The covariance of _sums() to nine digits, halves away from zero."""
    twice = f"({2 * 10**9} * {s}.moment + CASE WHEN {s}.moment < 0 THEN -{s}.n * {s}.n ELSE {s}.n * {s}.n END)"
    by = f"(2 * {s}.n * {s}.n)"
    return F.expr(f"CAST(({twice} - {twice} % {by}) / {by} AS DOUBLE) / 1e9D")


def _moments(pixels: DataFrame, *also: Column) -> DataFrame:
    """frame, label, also, vy, vx, vxy of the labels, moments to nine digits.

    They are worked out in whole numbers: in doubles, one that ends in 5 at the tenth digit (of 32 pixels, say) falls to either side by the order in which rows come. Places between pixels stay doubles."""
    cells = pixels.filter("label <> 0").groupBy("frame", "label")
    if not all(isinstance(pixels.schema[c].dataType, IntegralType) for c in ("y", "x")):
        return cells.agg(*also, *[F.round(c, 9).alias(n) for n, c in (("vy", F.var_pop("y")), ("vx", F.var_pop("x")), ("vxy", F.covar_pop("y", "x")))])
    x = cells.agg(*also, *[_sums(a, b).alias(n) for n, a, b in (("vy", "y", "y"), ("vx", "x", "x"), ("vxy", "y", "x"))])
    return x.select([_covariance(c).alias(c) if c in ("vy", "vx", "vxy") else c for c in x.columns])


def _axes() -> list[Column]:
    """major, minor, angle of the ellipse with _moments()."""
    mid, gap = (F.col("vy") + F.col("vx")) / 2, F.sqrt(F.pow((F.col("vy") - F.col("vx")) / 2, 2.0) + F.pow("vxy", 2.0))
    return [(4 * F.sqrt(mid + gap)).alias("major"), (4 * F.sqrt(F.greatest(mid - gap, F.lit(0.0)))).alias("minor"), (0.5 * F.degrees(F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")))).alias("angle")]


def shape_stats(pixels: DataFrame) -> DataFrame:
    """frame, label, com_y, com_x, area."""
    return pixels.filter("label <> 0").groupBy("frame", "label").agg(*_places())


def moment_ellipse(pixels: DataFrame) -> DataFrame:
    """frame, label, major, minor, angle of the ellipse with the region's second moments (not a contour fit)."""
    return _moments(pixels).select("frame", "label", *_axes())


def tracked_shapes(pixels: DataFrame) -> DataFrame:
    """shape_stats() with angle (0 to 180) and ar of the moment ellipse, rounded to five digits so that a line's minor axis is 0; ar is 0 for such cells. Pixels are grouped once."""
    stats = ["frame", "label", "com_y", "com_x", "area"]
    e = _moments(pixels, *_places()).select(*stats, *_axes())
    e = e.select(*stats, *[F.round(c, 5).alias(c) for c in ("angle", "major", "minor")])
    turned = F.when(F.col("angle") < 0, F.col("angle") + 180).otherwise(F.col("angle"))
    return e.select(*stats, turned.alias("angle"), F.when(F.col("minor") == 0, 0.0).otherwise(F.col("major") / F.col("minor")).alias("ar"))


def intensity_stats(pixels: DataFrame, value: str) -> DataFrame:
    """frame, label, mean, low, high of a value over each label."""
    return pixels.filter("label <> 0").groupBy("frame", "label").agg(F.avg(value).alias(f"{value}_mean"), F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max"))


def background(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame").agg(F.avg(F.when(F.col("label") == 0, F.col("ac"))).alias("background"))


def bins(pixels: DataFrame, value: str = "ac") -> DataFrame:
    """Labelled pixels with bin: the value from the label's minimum to its maximum in 0..255; labels of one value have no row."""
    ends = pixels.filter("label <> 0").groupBy("frame", "label").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("hi > lo")
    x = pixels.join(ends, ["frame", "label"])
    return x.withColumn("bin", F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).cast("int")).drop("lo", "hi")


def otsu(binned: DataFrame) -> DataFrame:
    """frame, label, threshold: the first bin that maximises the variance between the classes up to and above it.

    Works on histograms of 256 bins a label, so the windows are small whatever the label's size."""
    hist = binned.groupBy("frame", "label", "bin").agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy("frame", "label")
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    x = hist.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("bin")).over(up))
    x = x.withColumn("w1", F.sum("n").over(w) - F.col("w0")).withColumn("s1", F.sum(F.col("n") * F.col("bin")).over(w) - F.col("s0"))
    between = F.col("w0") * F.col("w1") * F.pow(F.col("s0") / F.col("w0") - F.col("s1") / F.col("w1"), 2.0)
    x = x.filter("w1 > 0").withColumn("between", F.round(between, 6))
    return x.groupBy("frame", "label").agg(F.min_by("bin", F.struct(-F.col("between"), "bin")).alias("threshold"))


def ratio(a: str, b: str) -> Column:
    """(a - b) / (a + b), 0 where that has no value."""
    total = F.col(a) + F.col(b)
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull() & (total != 0), (F.col(a) - F.col(b)) / total).otherwise(0.0)


def interior_features(pixels: DataFrame, interior: DataFrame | None = None) -> DataFrame:
    """Per frame and label: interior area and mean, background and contour mean, contrasts, AC/DC ratio and solidity.

    interior(frame, label, y, x) are the interior pixels; without it, they are those at or over the label's Otsu threshold."""
    if interior is None:
        b = bins(pixels)
        inside = b.join(otsu(b), ["frame", "label"]).withColumn("inside", F.col("bin") >= F.col("threshold"))
        x = pixels.filter("label <> 0").join(inside.select("frame", "label", "y", "x", "inside"), ["frame", "label", "y", "x"], "left")
    else:
        x = pixels.filter("label <> 0").join(interior.select("frame", "label", "y", "x", F.lit(True).alias("inside")), ["frame", "label", "y", "x"], "left")
    x = x.withColumn("inside", F.coalesce("inside", F.lit(False)))
    g = x.groupBy("frame", "label").agg(
        F.count("*").alias("area"),
        F.avg("dc").alias("dc_mean"),
        F.count(F.when(F.col("inside"), 1)).alias("interior_area"),
        F.avg(F.when(F.col("inside"), F.col("ac"))).alias("interior_mean"),
        F.coalesce(F.avg(F.when(~F.col("inside"), F.col("ac"))), F.lit(0.0)).alias("contour_mean"),
    )
    g = g.join(background(pixels), "frame")
    return g.select(
        "frame",
        "label",
        "interior_area",
        F.coalesce("interior_mean", F.lit(0.0)).alias("interior_mean"),
        "contour_mean",
        ratio("interior_mean", "background").alias("back_contrast"),
        ratio("interior_mean", "contour_mean").alias("contour_contrast"),
        F.when(F.col("interior_mean").isNotNull() & (F.col("dc_mean") != 0), F.col("interior_mean") / F.col("dc_mean")).otherwise(0.0).alias("ac_dc_ratio"),
        (F.col("interior_area") / F.col("area")).alias("solidity"),
    )
