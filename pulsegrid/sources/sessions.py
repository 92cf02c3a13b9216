"""Saved sessions as desktop tools read them: a folder with multipage TIFFs of masks and images, and a CSV of the series.

Files are written in parts by many tasks, each part's bytes being what stands at its place in the file, and the parts are then copied behind each other. TIFF files of 4 GB and more are
big ones. They are read by runs of rows, whatever their size (see tiff.py). Paths or URIs must be ones that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators import series as S
from pulsegrid.sources import folders, tiff
from pulsegrid.sources.saved import scratch, written

#: The files of a session, with the column that each holds and its type on disk.
STACKS = {"segmentation.tif": ("label", "<i4"), "ACs.tif": ("ac", "<f8"), "DCs.tif": ("dc", "<f8")}
SERIES = "cell_data.csv"
LINE_END = "\r\n"


def write_parts(rows: DataFrame, order: list[str], path: str, encode: Callable[[pd.DataFrame], Iterator[bytes]], head: bytes = b"") -> None:
    """rows(part, …) as one file: the head, then the parts by number, each with its rows in this order as encode() gives their bytes.

    All rows of a part are in one partition. A task writes a part under a name of its own and renames it when it is whole, so that one that is run again does no harm."""
    folder = f"{path}.parts-{uuid.uuid4().hex}"

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, name = tiff.where(folder)
        at.create_dir(name, recursive=True)
        now, out, own, done = None, None, "", []

        def close() -> None:
            if out is not None:
                out.close()
                at.move(own, f"{name}/{now:010d}")

        for x in frames:
            for part, some in x.groupby("part", sort=True):
                if part != now:
                    close()
                    now, own = part, f"{name}/{part:010d}-{uuid.uuid4().hex}"
                    out = at.open_output_stream(own)
                    done.append(part)
                for piece in encode(some):
                    out.write(piece)
        close()
        yield pd.DataFrame({"part": done}, dtype="int64")

    spark = rows.sparkSession
    parts = sorted(r.part for r in rows.sortWithinPartitions("part", *order).mapInPandas(write, "part long").collect())  # a number per part

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (at, name), (to, target) = tiff.where(folder), tiff.where(path)
        n = len(head)
        with to.open_output_stream(target) as out:
            out.write(head)
            for part in parts:
                with at.open_input_stream(f"{name}/{part:010d}") as f:
                    while piece := f.read(1 << 24):
                        out.write(piece)
                        n += len(piece)
        if at.get_file_info(name).type.name == "Directory":
            at.delete_dir(name)
        yield pd.DataFrame({"bytes": [n for x in frames for _ in range(len(x))]})

    spark.range(1).repartition(1).mapInPandas(copy, "bytes long").collect()  # bytes as they are, by one task


def write_pages(pages: DataFrame, shape: tuple[int, int], dtype: str, path: str, together: int = 1 << 28, big: bool | None = None, numbers: DataFrame | None = None) -> None:
    """pages(frame, page) as a multipage TIFF in order of frames, a page being the bytes of an image; a part holds about `together` bytes. big: what kind of file, if it isn't left to the size.

    numbers(frame, number) are the pages' frames with their places in the file, if they are known; else all pages are made once more to find them."""
    if numbers is None:
        numbers = written(folders.in_order(pages.select("frame").distinct(), "number", "frame"), "page-numbers")
    n = numbers.count()
    if big is None:
        big = len(tiff.head(False)) + n * tiff.page_size(shape, dtype, False) >= 1 << 32
    per = max(1, together // tiff.page_size(shape, dtype, big))

    def encode(x: pd.DataFrame) -> Iterator[bytes]:
        for number, raw in zip(x["number"], x["page"], strict=True):
            yield tiff.page_bytes(raw, shape, dtype, int(number), int(number) == n - 1, big)

    numbers = numbers.select("frame", "number")
    rows = pages.join(F.broadcast(numbers) if n <= 1_000_000 else numbers, "frame").withColumn("part", F.floor(F.col("number") / per).cast("long"))
    write_parts(rows.repartition(max(1, -(-n // per)), "part"), ["number"], path, encode, tiff.head(big))


def page_frames(pixels: DataFrame) -> DataFrame:
    """frame, number, bottom, right: the frames of pixels in order, each with its last row and column. The pixels are read once."""
    found = pixels.groupBy(F.col("frame").cast("long").alias("frame")).agg(F.max("y").alias("bottom"), F.max("x").alias("right"))
    # Written before they are put in order, since range partitioning works out its input twice.
    return written(folders.in_order(written(found, "frames"), "number", "frame"), "page-numbers")


def write_stack(pixels: DataFrame, value: str, dtype: str, path: str, frames: DataFrame | None = None) -> None:
    """pixels(frame, y, x, value) as a page per frame; pixels that aren't there are 0. frames: page_frames(pixels), if several stacks are made of them."""

    with scratch(pixels.sparkSession):
        frames = page_frames(pixels) if frames is None else frames
        height, width = frames.agg(F.max("bottom"), F.max("right")).first()
        shape = (int(height or 0) + 1, int(width or 0) + 1)

        def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
            image = np.zeros(shape, dtype)
            image[x["y"], x["x"]] = x[value]
            return pd.DataFrame({"frame": [int(key[0])], "page": [image.tobytes()]})

        write_pages(pixels.select("frame", "y", "x", value).groupBy("frame").applyInPandas(pack, "frame long, page binary"), shape, dtype, path, numbers=frames)


def write_stacks(pixels: DataFrame, folder: str) -> None:
    """The stacks of a session, from pixels that are worked out once."""
    with scratch(pixels.sparkSession):
        pixels = written(pixels.select("frame", "y", "x", *[column for column, _ in STACKS.values()]), "pixels")
        frames = page_frames(pixels)
        for file, (column, dtype) in STACKS.items():
            write_stack(pixels, column, dtype, f"{folder}/{file}", frames)


def write_series(series: DataFrame, features: list[str], path: str) -> None:
    """Each track's block: its name, its times, a line per feature, an empty line; tracks in order. Times are the column time, or else frame numbers. Cells with commas or quotes are quoted."""
    timed = series if "times" in series.columns else series.withColumn("times", F.col("time") if "time" in series.columns else F.col("frame").cast("double"))
    rows = S.export_rows(timed, ["times", *[f for f in features if f not in ("time", "times")]]).select("track", "row", "line")
    name = F.when(F.col("line").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace("line", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("line"))
    rows = rows.withColumn("line", F.when(F.col("row") == 0, name).otherwise(F.col("line")))

    def encode(x: pd.DataFrame) -> Iterator[bytes]:
        yield "".join(f"{line}{LINE_END}" for line in x["line"]).encode()

    with scratch(series.sparkSession):
        kept = written(rows, "series-lines")
        write_parts(kept.repartitionByRange("track").withColumn("part", F.spark_partition_id().cast("long")), ["track", "row"], path, encode)


def make_folder(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def write_session(pixels: DataFrame, series: DataFrame, features: list[str], folder: str) -> None:
    make_folder(pixels.sparkSession, folder)
    write_stacks(pixels, folder)
    write_series(series, features, f"{folder}/{SERIES}")


def read_stack(spark: SparkSession, path: str, value: str, kind: str = "double") -> DataFrame:
    """frame, y, x, value of a multipage TIFF."""
    return tiff.read_stacks(spark, {value: (path, kind)})


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """frame, y, x, label, ac, dc of a session's three stacks, read side by side."""
    return tiff.read_stacks(spark, {column: (f"{folder}/{file}", "long" if dtype == "<i4" else "double") for file, (column, dtype) in STACKS.items()})


def read_series(spark: SparkSession, folder: str) -> DataFrame:
    """track, feature, place, value: the CSV's series, a row per number. A line that comes first or after an empty one names a track. Lines may end in either way, cells may be quoted.

    Lines are looked at within blocks of the file; only a row per block passes through one task."""
    block = F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(f"{folder}/{SERIES}").select(block, F.monotonically_increasing_id().alias("at"), F.rtrim("value", F.lit("\r")).alias("line"))
    within = Window.partitionBy("block").orderBy("at")
    # Of each block: its last line, and the last track named in it; a name is known as one by the line before it, at a block's start by the block before.
    lines = lines.withColumn("before", F.lag("line").over(within))
    ends = lines.groupBy("block").agg(F.max_by("line", "at").alias("end"), F.max_by(F.when(F.col("before") == "", F.col("line")), F.when((F.col("before") == "") & (F.col("line") != ""), F.col("at"))).alias("name"), F.min_by("line", "at").alias("first"))
    blocks = Window.orderBy("block")  # over a row per block
    ends = ends.withColumn("ended", F.lag("end", 1, "").over(blocks))
    ends = ends.withColumn("name", F.coalesce("name", F.when((F.col("ended") == "") & (F.col("first") != ""), F.col("first"))))
    ends = ends.withColumn("so_far", F.last("name", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))).select("block", "ended", "so_far")
    x = lines.join(ends, "block").withColumn("before", F.coalesce("before", "ended"))
    x = x.withColumn("track", F.coalesce(F.last(F.when((F.col("before") == "") & (F.col("line") != ""), F.col("line")), ignorenulls=True).over(within), "so_far"))
    plain = lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    cells = F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    values = x.filter((F.col("before") != "") & (F.col("line") != "")).select(plain(F.col("track")).alias("track"), cells.alias("cells"))
    rows = values.select("track", plain(F.element_at("cells", 1)).alias("feature"), F.posexplode(F.slice("cells", F.lit(2), F.size("cells") - 1)).alias("place", "value"))
    return rows.select("track", "feature", F.col("place").cast("long").alias("place"), plain(F.col("value")).try_cast("double").alias("value"))


def read_session(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pixels, the series and the measurements (frame, time) of a session; frames take the distinct times of the series in order."""
    times = folders.session_times(spark.read.text(f"{folder}/{SERIES}"))
    return read_pixels(spark, folder), read_series(spark, folder), times
