"""Measurements from folder names, settings files and saved sessions, and the measurement table that they fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import names
from pulsegrid.sources.saved import written


def day_folders(folders: DataFrame, minutes: Column, start: int = 0, stride: int = 1, holds: str = "") -> DataFrame:
    """folders(name) of a day's measurements: those with `_` and `x` or `X` in the name, by time; then those that hold a string, every stride-th from start."""
    x = folders.filter(F.contains("name", F.lit("_")) & F.contains(F.lower("name"), F.lit("x"))).withColumn("minutes", minutes)
    first = x.agg(F.min("minutes").alias("_first"))  # one row
    x = x.crossJoin(F.broadcast(first)).withColumn("minutes", F.col("minutes") - F.col("_first")).drop("_first")
    if holds:
        x = x.filter(F.contains("name", F.lit(holds)))
    x = in_order(x, "place", "minutes", "name")
    return x.filter((F.col("place") >= start) & ((F.col("place") - start) % stride == 0))


def in_order(x: DataFrame, name: str, *order: str) -> DataFrame:
    """x with its rows' numbers from 0 in this order. Rows are range-partitioned and written, then numbered within partitions; a row per partition is summed in one task."""
    parts = written(x.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"))
    ranked = parts.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return ranked.join(before, "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def ini_shapes(spark: SparkSession, path: str) -> DataFrame:
    """path, h, w from the settings files' lines AOIHeight= and AOIWidth=."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split("value", "=").alias("kv"))
    key, value = F.trim(F.element_at("kv", 1)), F.try_element_at("kv", F.lit(2)).try_cast("int")
    return lines.groupBy("path").agg(F.max(F.when(key == "AOIHeight", value)).alias("h"), F.max(F.when(key == "AOIWidth", value)).alias("w"))


def cycle_fps(cycle_time: Column) -> Column:
    return 1.0 / cycle_time


def spool_name(created: Column) -> Column:
    return F.concat(F.lit("Spool_"), F.date_format(created, "yyyy_MM_dd_hhmmss a"))


def session_times(lines: DataFrame) -> DataFrame:
    """frame, time: the sorted distinct times of all `times` lines of lines(value) of a session's CSV."""
    x = lines.filter(F.startswith("value", F.lit("times"))).select(F.explode(F.split("value", ",")).alias("p")).select(F.col("p").try_cast("double").alias("time")).filter("time IS NOT NULL").distinct()
    return in_order(x, "frame", "time")


def measurements(named: DataFrame, legacy: bool = False) -> DataFrame:
    """named(name, seq) with hour, minute, abstime and frame, in order of time and arrival."""
    m = names.minutes_legacy(F.col("name")) if legacy else names.minutes_12h(F.col("name"))
    x = named.withColumn("abstime", m).withColumn("hour", F.floor(F.col("abstime") / 60).cast("int"))
    x = x.withColumn("minute", F.floor(F.col("abstime") % 60).cast("int"))
    return numbered(x)


def numbered(x: DataFrame) -> DataFrame:
    """frame from 0 in order of abstime, ties by seq. A row per measurement."""
    return in_order(x.drop("frame"), "frame", "abstime", "seq")


def add(old: DataFrame, new: DataFrame) -> DataFrame:
    return numbered(old.unionByName(new, allowMissingColumns=True))


def drop_frame(x: DataFrame, frame: int) -> DataFrame:
    """Without a frame, the later ones numbered one less; works on every table that has a frame column."""
    return x.filter(F.col("frame") != frame).withColumn("frame", F.when(F.col("frame") > frame, F.col("frame") - 1).otherwise(F.col("frame")))


def save_version(x: DataFrame, folder: str, version: int) -> None:
    """A checkpoint of an edited table; load_version() returns to it."""
    x.write.mode("overwrite").parquet(f"{folder}/version={version}")


def load_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}")
