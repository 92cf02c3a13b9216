"""The whole measurement of cells: every feature per frame and label, and the series of every track."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import geometry, labels, series, tracking
from pulsegrid.sources.saved import written

POINTS = "array<struct<x:int,y:int>>"

#: The features of a cell in a frame, in the order of exports.
FEATURES = (
    "area angle major minor dc_mean dc_min dc_max ac_mean ac_min ac_max interior_area interior_mean contour_mean back_contrast contour_contrast ac_dc_ratio solidity"
).split()


def shapes(pixels: DataFrame) -> DataFrame:
    """frame, label, angle, major, minor of the measuring ellipse, ar of the tracking one; interior_area, interior_mean (null without an interior), contour_mean; total, interior: the closed contour of the cell and those
    of its interior parts. One grouping of the pixels gives all."""

    def points(c: np.ndarray, y0: int, x0: int) -> list[tuple[int, int]]:
        return [(x + x0, y + y0) for x, y in [*c.tolist(), *c[:1].tolist()]]

    def f(x: dict[str, np.ndarray]) -> tuple:
        ys, xs = x["y"], x["x"]
        mask, y0, x0 = geometry.grid(ys, xs)
        values = np.zeros(mask.shape)
        values[ys - y0, xs - x0] = x["ac"]
        contour = geometry.trace(mask)
        found, inner = geometry.interior_of(mask, values)
        inside, rest = values[found & mask], values[mask & ~found]
        (_, major, minor), measured = geometry.ellipses_of(contour, len(ys))
        return (
            *measured,
            major / minor if minor else 0.0,
            len(inside),
            float(inside.mean()) if len(inside) else None,
            float(rest.mean()) if len(rest) else 0.0,
            points(contour, y0, x0),
            [points(c, y0, x0) for c in inner],
        )

    return geometry.by_cell(pixels, ["ac"], f"angle double, major double, minor double, ar double, interior_area long, interior_mean double, contour_mean double, total {POINTS}, interior array<{POINTS}>", f)


def features(pixels: DataFrame, with_outlines: bool = False, shaped: DataFrame | None = None) -> DataFrame:
    """frame, label, com_y, com_x and FEATURES of every cell; shaped is shapes(pixels), if there is one. Pixels are grouped twice by cell (what Spark aggregates, what needs the shape); the joined tables have a row per cell each."""
    keys = ["frame", "label"]
    sums = [F.avg("y").alias("com_y"), F.avg("x").alias("com_x"), F.count("*").alias("area")]
    sums += [f(v).alias(f"{v}_{n}") for v in ("dc", "ac") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    out = pixels.filter("label <> 0").groupBy(*[F.col(k).cast("long").alias(k) for k in keys]).agg(*sums)
    out = out.join((shapes(pixels) if shaped is None else shaped).drop("ar"), keys, "left").join(labels.background(pixels).select(F.col("frame").cast("long").alias("frame"), "background"), "frame")
    mean = F.col("interior_mean")
    out = out.withColumns(
        {
            "back_contrast": labels.ratio("interior_mean", "background"),
            "contour_contrast": labels.ratio("interior_mean", "contour_mean"),
            "ac_dc_ratio": F.when(mean.isNotNull() & (F.col("dc_mean") != 0), mean / F.col("dc_mean")).otherwise(0.0),
            "solidity": F.col("interior_area") / F.col("area"),
        }
    ).withColumn("interior_mean", F.coalesce(mean, F.lit(0.0)))
    return out.select(*keys, "com_y", "com_x", *FEATURES, *(["total", "interior"] if with_outlines else []))


def measure(pixels: DataFrame, measurements: DataFrame) -> DataFrame:
    """The series of all tracks: masks are linked with ellipse angles and aspect ratios in the scores, and joined with features and
    measurements(frame, abstime). Sorted by track and frame."""
    places = labels.shape_stats(pixels).select(F.col("frame").cast("long").alias("frame"), F.col("label").cast("long").alias("label"), "com_y", "com_x", "area")
    shaped = written(shapes(pixels).drop("total", "interior"), "shapes")  # worked out once, for links and features
    cells = written(places.join(shaped.select("frame", "label", "angle", "ar"), ["frame", "label"]), "cells")
    walk = tracking.lineages(cells, tracking.network(pixels, cells, common=written(tracking.overlaps(pixels), "overlaps"))).drop("path")
    times = series.relative_times(measurements).select(F.col("frame").cast("long").alias("frame"), "time")
    return series.with_features(walk, features(pixels, shaped=shaped)).join(times, "frame", "left").orderBy("track", "frame")
