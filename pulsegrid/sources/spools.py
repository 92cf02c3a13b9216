"""Folders of spooled camera data: which of them are whole, and their frames through a decoder that the caller gives.

A spool is a folder with one .ini file (lines key = value), one .sifx file and data files. A day's spools go together if all are whole and of one size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources import folders, images
from pulsegrid.sources.saved import written

#: The settings that tell an image's size.
HEIGHT, WIDTH = "AOIHeight", "AOIWidth"

#: decoder(file, content, settings) -> frames' numbers and images of one data file.
Decoder = Callable[[str, bytes, dict[str, str]], list[tuple[int, np.ndarray]]]


def checked(files: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys…, spool, n_ini, n_sifx, h, w, reason of files(keys…, spool, file) and sizes(keys…, spool, h, w): reason is null for spools that can be loaded, or 'files', 'no size' or 'sizes'
    (the keys' spools differ). A spool without files isn't there; without sizes, it has none."""
    keys = [*keys]
    ends = lambda e: F.count(F.when(F.endswith("file", F.lit(e)), 1))
    counts = files.groupBy(*keys, "spool").agg(ends(".ini").alias("n_ini"), ends(".sifx").alias("n_sifx"))
    x = counts.join(sizes.groupBy(*keys, "spool").agg(F.max("h").alias("h"), F.max("w").alias("w")), [*keys, "spool"], "left")
    bad = (F.col("n_ini") != 1) | (F.col("n_sifx") != 1)
    good = ~bad & F.col("h").isNotNull() & F.col("w").isNotNull()
    size = F.when(good, F.struct("h", "w"))
    every = x.groupBy(*keys).agg(F.min(size).alias("_a"), F.max(size).alias("_b"))
    x = x.join(every, keys) if keys else x.crossJoin(F.broadcast(every))  # one row
    reason = F.when(bad, "files").when(~good, "no size").when(F.col("_a") != F.col("_b"), "sizes")
    return x.select(*keys, "spool", "n_ini", "n_sifx", "h", "w", reason.alias("reason"))


def settings(spark: SparkSession, folder: str) -> DataFrame:
    """spool, settings: the lines key = value of each spool's .ini files, as a map; of a key that comes twice the greater value."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ini").text(folder).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("spool"), F.split("value", "=", 2).alias("kv"))
    pairs = lines.filter(F.size("kv") == 2).select(F.url_decode(F.replace("spool", F.lit("+"), F.lit("%2B"))).alias("spool"), F.trim(F.col("kv")[0]).alias("k"), F.trim(F.rtrim(F.col("kv")[1], F.lit("\r"))).alias("v")).groupBy("spool", "k").agg(F.max("v").alias("v"))
    return pairs.groupBy("spool").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("settings"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """checked() spools of a folder, with their settings."""
    files = images.listing(spark, folder).select(F.col("folder").alias("spool"), "file")
    found = written(settings(spark, folder), "spool-settings")
    number = lambda k: F.col("settings")[k].try_cast("int")
    return checked(files, found.select("spool", number(HEIGHT).alias("h"), number(WIDTH).alias("w"))).join(found, "spool", "left")


def chosen(spools: DataFrame, start: int = 0, stride: int = 1, holds: str = "") -> DataFrame:
    """place and the columns of scan()ned spools, by name: those that hold a string, every stride-th from start. An error if one can't be loaded or none is left."""
    spools = written(spools, "spools")
    refused = spools.filter("reason IS NOT NULL").orderBy("spool").limit(5).collect()
    if refused:
        raise ValueError("spools can't be loaded: " + ", ".join(f"{r.spool} ({r.reason})" for r in refused))
    x = folders.in_order(spools.filter(F.contains("spool", F.lit(holds))), "place", "spool")
    x = written(x.filter((F.col("place") >= start) & ((F.col("place") - start) % stride == 0)), "spools-chosen")
    if x.isEmpty():
        raise ValueError(f"no spool that holds {holds!r} is left from number {start}")
    return x


def decode(spark: SparkSession, folder: str, spools: DataFrame, decoder: Decoder, data: str = "*.dat") -> DataFrame:
    """meas_id, t, y, x, v of the data files of chosen() spools; a data file is a task's, with its spool's settings."""
    files = images.listing(spark, folder, data).join(F.broadcast(spools.select(F.col("spool").alias("folder"), "settings")) if spools.count() <= images.SENT_FILES else spools.select(F.col("spool").alias("folder"), "settings"), "folder")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for spool, file, raw, known in x[["folder", "file", "content", "settings"]].itertuples(index=False, name=None):
                for t, image in decoder(file, bytes(raw), dict(known or {})):
                    y, c = np.indices(image.shape)
                    yield pd.DataFrame({"meas_id": spool, "t": int(t), "y": y.ravel(), "x": c.ravel(), "v": image.ravel().astype(float)})

    return files.select("folder", "file", "content", "settings").mapInPandas(run, "meas_id string, t long, y long, x long, v double")


