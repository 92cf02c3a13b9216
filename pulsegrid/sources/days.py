"""A day's folder of measurements, from the names of its folders to the mean and amplitude of every pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import names
from pulsegrid.operators import signal
from pulsegrid.sources import folders, images
from pulsegrid.sources.saved import written


def chosen(spark: SparkSession, folder: str, minutes: Column | None = None, start: int = 0, stride: int = 1, holds: str = "", tenths: bool = False) -> DataFrame:
    """name, minutes, place, fps of a day's measurements, as folders.day_folders() selects them; an error if none is left from `start`. With `tenths`, what follows v in a rate counts as tenths."""
    found = images.listing(spark, folder).select(F.col("folder").alias("name")).distinct()
    x = folders.day_folders(found, names.minutes_day_folder(F.col("name")) if minutes is None else minutes, start, stride, holds)
    x = written(x.withColumn("fps", (names.fps_tenths if tenths else names.fps)(F.col("name"))), "day")
    if x.isEmpty():
        raise ValueError(f"no measurement of {folder} that holds {holds!r} is left from number {start}")
    return x


def stacks(spark: SparkSession, folder: str, day: DataFrame, decoders: dict[str, images.Decoder] | None = None) -> DataFrame:
    """meas_id, fps, y, x, signal of a day's measurements; an error if the images of one differ in size."""
    files = images.scan(spark, folder, day.select(F.col("name").alias("folder")))
    lanes = signal.to_lanes(images.decode(files, decoders), ["meas_id", "y", "x"])
    rates = day.select(F.col("name").alias("meas_id"), "fps")
    lanes = written(lanes.join(F.broadcast(rates) if rates.count() <= signal.SENT_LIMITS else rates, "meas_id").select("meas_id", "fps", "y", "x", "signal"), "stacks")
    n = F.size("signal")
    uneven = lanes.groupBy("meas_id").agg(F.min(n).alias("least"), F.max(n).alias("most")).filter("least < most").orderBy("meas_id").limit(5).collect()
    if uneven:
        raise ValueError(f"images of different sizes in {', '.join(r.meas_id for r in uneven)}")
    return lanes


def extract(spark: SparkSession, folder: str, how: signal.Analysis, fractions: tuple[float, float] = (0.0, 1.0), decoders: dict[str, images.Decoder] | None = None, **which) -> tuple[DataFrame, DataFrame]:
    """The measurements that chosen() selects (name, minutes, place, fps), and meas_id, fps, y, x, signal, first, last, dc, ac of all their pixels, in one plan. Limits start from shares of each one's length."""
    day = chosen(spark, folder, **which)
    return day, signal.extract(stacks(spark, folder, day, decoders), how.changed(fps="fps"), keys=["meas_id"], fractions=fractions)
