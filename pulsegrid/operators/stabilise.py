"""Image stabilisation by translations between successive frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coarse_shift(fixed: np.ndarray, moving: np.ndarray, least: float = 0.2) -> tuple[int, int]:
    """Whole (dx, dy) as for ecc_shift, of any size: the shift at which what overlaps correlates most, of all that leave at least a share `least` of the image; none where no shift does better than none.

    The correlations of all shifts, each over its own overlap, come from Fourier transforms of the padded images, of their squares and of where they are."""
    h, w = fixed.shape
    size = (2 * h, 2 * w)
    a, b, here = fixed - np.mean(fixed, dtype=float), moving - np.mean(moving, dtype=float), np.ones((h, w))
    fa, faa, fb, fbb, f1 = (np.fft.rfft2(x, size) for x in (a, a * a, b, b * b, here))
    meet = lambda p, q: np.fft.irfft2(q * np.conj(p), size)
    n = np.maximum(np.round(meet(f1, f1)), 1.0)
    sa, sb = meet(fa, f1), meet(f1, fb)
    va, vb = meet(faa, f1) - sa * sa / n, meet(f1, fbb) - sb * sb / n
    some = 1e-6 * n / (h * w)  # of an image's whole contrast
    fine = (n >= least * h * w) & (va > some * (a * a).sum()) & (vb > some * (b * b).sum())
    likeness = np.where(fine, (meet(fa, fb) - sa * sb / n) / np.sqrt(np.where(fine, va * vb, 1.0)), -1.0)
    dy, dx = np.unravel_index(int(likeness.argmax()), size)
    if likeness[dy, dx] <= likeness[0, 0] + 1e-9:
        return 0, 0
    return tuple(int(v) - (m if v > m // 2 else 0) for v, m in ((dx, size[1]), (dy, size[0])))


def ecc_shift(fixed: np.ndarray, moving: np.ndarray, steps: int = 100, eps: float = 1e-6, start: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
    """(dx, dy) with moving(x + dx, y + dy) like fixed(x, y): Gauss-Newton on the correlation of the two images' deviations from their means, from a start within some pixels of it."""
    fixed, moving = fixed.astype(float), moving.astype(float)
    h, w = fixed.shape
    gy, gx = np.gradient(moving)
    yy, xx = np.mgrid[:h, :w].astype(float)
    dx, dy = map(float, start)

    def look(image: np.ndarray, ok: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        y, x = np.clip(y, 0, h - 1.000001), np.clip(x, 0, w - 1.000001)
        i, j = y.astype(int), x.astype(int)
        i2, j2 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
        u, v = y - i, x - j
        return ((1 - u) * ((1 - v) * image[i, j] + v * image[i, j2]) + u * ((1 - v) * image[i2, j] + v * image[i2, j2]))[ok]

    for _ in range(steps):
        y, x = yy + dy, xx + dx
        ok = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
        if ok.sum() < 4:
            break
        a, b = fixed[ok] - fixed[ok].mean(), look(moving, ok, y, x)
        b = b - b.mean()
        g = np.stack([look(gx, ok, y, x), look(gy, ok, y, x)], axis=1)
        g = g - g.mean(axis=0)
        normal = g.T @ g
        if np.linalg.cond(normal) > 1e12 or not (b @ b):
            break
        inverse = np.linalg.inv(normal)
        gb, ga = g.T @ b, g.T @ a
        down = a @ b - ga @ inverse @ gb
        gain = (b @ b - gb @ inverse @ gb) / down if down > 0 else 1.0
        step = inverse @ (gain * ga - gb)
        dx, dy = dx + float(step[0]), dy + float(step[1])
        if np.abs(step).max() < eps:
            break
    return dx, dy


def shifts(images: DataFrame, value: str = "dc") -> DataFrame:
    """frame, dx, dy of every frame but the first against the one before, of up to most of an image: a start by the correlations of all whole shifts, then Gauss-Newton. A group is a pair of frames."""
    later = images.select("frame", "y", "x", value, F.lit(1).alias("second"))
    earlier = images.select((F.col("frame") + 1).alias("frame"), "y", "x", value, F.lit(0).alias("second"))

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        pair = [x[x["second"] == k] for k in (0, 1)]
        if not len(pair[0]) or not len(pair[1]):
            return pd.DataFrame({"frame": [], "dx": [], "dy": []})
        h, w = int(x["y"].max()) + 1, int(x["x"].max()) + 1
        both = []
        for p in pair:
            image = np.full((h, w), float(p[value].mean()))
            image[p["y"], p["x"]] = p[value]
            both.append(image)
        dx, dy = ecc_shift(*both, start=coarse_shift(*both))
        return pd.DataFrame({"frame": [int(key[0])], "dx": [dx], "dy": [dy]})

    return earlier.unionByName(later).groupBy("frame").applyInPandas(run, "frame long, dx double, dy double")


def back_to_first(warps: DataFrame) -> DataFrame:
    """frame, dx, dy that take each frame onto the first: translations add up, and their sum is undone. A row per frame."""
    w = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return warps.select("frame", (-F.sum("dx").over(w)).alias("dx"), (-F.sum("dy").over(w)).alias("dy"))


def pads(back: DataFrame, height: int, width: int) -> DataFrame:
    """top, bottom, left, right: what the moved frames' corners exceed the first frame by, in whole pixels toward zero."""
    low = lambda c: F.floor(F.greatest(F.lit(0.0), -F.min(c))).cast("long")
    high = lambda c, n: F.greatest(F.lit(0), F.floor(F.greatest(F.lit(0.0), F.max(c) + n)) - n).cast("long")
    return back.agg(low("dy").alias("top"), high("dy", height).alias("bottom"), low("dx").alias("left"), high("dx", width).alias("right"))


def warp(images: DataFrame, back: DataFrame, height: int, width: int, fill: str | None = "dc") -> DataFrame:
    """images(frame, y, x, label, dc, ac) moved to the nearest pixel on a canvas that holds all frames.

    The first frame's empty pixels have its mean of `fill` (0 without), the others' 0."""
    kinds = {c: images.schema[c].dataType for c in images.columns}
    p = F.broadcast(pads(back, height, width))  # one row
    b = back.select("frame", "dx", "dy")
    start = images.agg(F.min("frame").alias("start"))
    moved = images.join(b, "frame", "left").crossJoin(p)
    round_ = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) + 0.5)
    moved = moved.withColumn("y", (F.col("y") + round_(F.col("dy")) + F.col("top")).cast("long")).withColumn("x", (F.col("x") + round_(F.col("dx")) + F.col("left")).cast("long")).drop("dx", "dy", *["top", "bottom", "left", "right"])
    canvas = images.select("frame").distinct().crossJoin(p)
    canvas = canvas.select("frame", F.explode(F.sequence(F.lit(0), height + F.col("top") + F.col("bottom") - 1)).alias("y"), "left", "right")
    canvas = canvas.select("frame", "y", F.explode(F.sequence(F.lit(0), width + F.col("left") + F.col("right") - 1)).alias("x"))
    x = canvas.join(moved, ["frame", "y", "x"], "left").crossJoin(F.broadcast(start))
    if fill:
        mean = images.join(F.broadcast(start), F.col("frame") == F.col("start")).agg(F.avg(fill).alias("mean"))
        x = x.crossJoin(F.broadcast(mean))
    rest = []
    for c in images.columns:
        if c not in ("frame", "y", "x"):
            empty = F.when(F.col("frame") == F.col("start"), F.col("mean")).otherwise(0.0) if c == fill else F.lit(0)
            rest.append(F.coalesce(F.col(c), empty).cast(kinds[c]).alias(c))
    return x.select("frame", "y", "x", *rest)
