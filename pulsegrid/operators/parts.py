"""Connected parts of images, by tiles: a tile's parts are found in its task, parts that touch over the tiles' borders are joined as components of a graph.

A part goes by its first pixel in row order, so numbers in that order come without looking at pixels again. Neighbours are the eight around a pixel. Pixels that aren't in the table are off;
rows of one pixel must be one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.components import components
from pulsegrid.sources.saved import written


PIECE = 500_000  # pixels of a task


def pieces(spark: SparkSession, pixels: int) -> int:
    """How many partitions to deal so many pixels to. Images compress well, so sizes in bytes, which adaptive execution goes by, would put them all into a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + pixels // PIECE)


def of_tile(tile: int) -> Column:
    """_tile: one number for a pixel's tile, so that rows that are dealt and sorted by it are short."""
    ty, tx = [F.floor(F.col(c) / tile).cast("long") for c in "yx"]
    return (ty * (1 << 32) + tx).alias("_tile")


def run_labels(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected parts of a mask, in row order of their first pixels: runs of each row are joined with those that they touch in the next."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    edges = padded[:, 1:] - padded[:, :-1]
    row, start = np.nonzero(edges == 1)
    stop = np.nonzero(edges == -1)[1]
    wide = w + 2
    low = np.searchsorted(row * wide + stop, (row + 1) * wide + start, "left")
    high = np.searchsorted(row * wide + start, (row + 1) * wide + stop, "right")
    up = list(range(len(row)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        for j in range(a, b):
            p, q = top(i), top(j)
            up[max(p, q)] = min(p, q)
    tops = np.array([top(i) for i in range(len(row))], np.int64)
    number = np.cumsum(tops == np.arange(len(row)))  # a part's top is its first run
    out = np.zeros(h * w, np.int64)
    out[mask.ravel()] = np.repeat(number[tops], stop - start)
    return out.reshape(h, w)


def labelled(pixels: DataFrame, on: str, keys: tuple[str, ...] = ("frame",), label: str = "label", tile: int = 512, n: int | None = None, dealt: bool = False) -> DataFrame:
    """pixels(keys…, y, x, on, …) with a label: 0 where `on` is false, and from 1 for the connected parts of each image, in row order of their first pixels.

    They are dealt to n tasks, pieces() of their number unless given; no more than a tile's pixels share a key. dealt: they have the column of of_tile(tile) and are partitioned by it and the keys already, so that they aren't moved again."""
    keys = [*keys]
    kinds = T.StructType([*[f for f in pixels.schema.fields if f.name != "_tile"], T.StructField("_first", T.LongType()), T.StructField("_edge", T.BooleanType())])
    columns = [f.name for f in kinds]

    def local(x: pd.DataFrame) -> pd.DataFrame:
        ty, tx = (int(x[k].iat[0]) // tile for k in "yx")
        y, c = x["y"].to_numpy() - ty * tile, x["x"].to_numpy() - tx * tile
        mask = np.zeros((tile, tile), bool)
        mask[y, c] = x[on]
        found = run_labels(mask)
        at = np.flatnonzero(mask)
        first = np.zeros(int(found.max(initial=0)) + 1, np.int64)
        first[found.ravel()[at[::-1]]] = at[::-1]  # the last to be set is the first in row order
        top, left = np.divmod(first, tile)
        name = (top + ty * tile) * (1 << 32) + left + tx * tile
        mine = found[y, c]
        rim = (y == 0) | (c == 0) | (y == tile - 1) | (c == tile - 1)
        return x.assign(_first=pd.Series(name[mine], index=x.index).astype("Int64").mask(mine == 0), _edge=rim & (mine > 0))[columns]

    n = n or pieces(pixels.sparkSession, pixels.count())
    x = pixels if dealt else pixels.select("*", of_tile(tile)).repartition(n, *keys, "_tile")
    x = written(x.groupBy(*keys, "_tile").applyInPandas(local, kinds), "tiles")
    rim = x.filter("_edge").select(*keys, "y", "x", "_first")
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])  # half of the neighbours, since the other half meets from the other side
    out = rim.select(*keys, F.col("_first").alias("a"), "y", "x", F.explode(steps).alias("s")).select(*keys, "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    node = lambda c: F.struct(*keys, F.col(c).alias("first"))
    touching = out.join(rim.withColumnRenamed("_first", "b"), [*keys, "y", "x"]).filter("a <> b").select(node("a").alias("a"), node("b").alias("b"))
    joined = components(touching).select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.first").alias("_first"), F.col("root.first").alias("_root"))
    # A row per part of a tile.
    names = x.filter("_first IS NOT NULL").select(*keys, "_first").distinct().join(joined, [*keys, "_first"], "left").withColumn("_root", F.coalesce("_root", "_first"))
    heads = names.select(*keys, "_root").distinct().withColumn("_number", F.row_number().over(Window.partitionBy(*keys).orderBy("_root")).cast("long"))
    numbers = names.join(heads, [*keys, "_root"]).select(*keys, "_first", "_number")
    own = [c for c in pixels.columns if c not in (label, "_tile")]
    off, lit = x.filter("_first IS NULL").select(*own, F.lit(0).cast("long").alias(label)), x.filter("_first IS NOT NULL").repartition(n, *keys, "_first").join(numbers, [*keys, "_first"]).select(*own, F.col("_number").alias(label))
    return off.unionByName(lit)
