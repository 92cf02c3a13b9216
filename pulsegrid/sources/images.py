"""Image folders as tables: files by Spark's binaryFile source, decoded in their partitions.

Built-in decoders: PNG (grey, 8 or 16 bits, not interlaced) and TIFF (grey, several pages, as in tiff.py). Other formats
need a decoder given by the caller."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import names
from pulsegrid.sources import tiff
from pulsegrid.sources.saved import written

#: Formats in the order that breaks ties.
FORMATS = ("png", "tif", "jpg")

Decoder = Callable[[bytes], list[np.ndarray]]


def read_png(raw: bytes) -> list[np.ndarray]:
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if colour != 0 or depth not in (8, 16) or interlaced:
        raise ValueError("only grey PNG of 8 or 16 bits without interlacing can be read")
    step = depth // 8
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.int64), np.zeros(width * step, np.int64)
    for y, row in enumerate(rows.astype(np.int64)):
        how, line = int(row[0]), row[1:].copy()
        if how == 1:
            line = np.add.accumulate(line.reshape(-1, step), axis=0).ravel() % 256
        elif how == 2:
            line = (line + above) % 256
        elif how:
            left, corner, up = [0] * step, [0] * step, above.tolist()
            plain = line.tolist()
            for x, v in enumerate(plain):
                a, b, c = left[x % step], up[x], corner[x % step]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    ends = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = (a, b, c)[ends.index(min(ends))]
                plain[x] = left[x % step] = (v + guess) % 256
                corner[x % step] = b
            line = np.array(plain, np.int64)
        out[y] = above = line
    flat = out.astype(np.uint8)
    return [flat if step == 1 else flat.reshape(height, -1).view(">u2").astype(np.uint16)]


def read_tiff(raw: bytes) -> list[np.ndarray]:
    file = io.BytesIO(raw)
    return [tiff.rows_of(file, p, 0, p.height) for p in list(tiff.pages(file))]


def write_tiff(pages: list[np.ndarray]) -> bytes:
    """A multipage TIFF of one strip per page, in which pages may differ."""
    out = bytearray(tiff.head(False))
    for k, p in enumerate(pages):
        start, dtype = len(out), p.dtype.newbyteorder("<")
        raw = np.ascontiguousarray(p, dtype).tobytes()
        out += tiff.page_bytes(raw, p.shape, dtype.str, 0, False, False)
        size = len(out) - start
        shift = start - len(tiff.head(False))
        entry = start + 2 + 5 * 12 + 8  # where the strip lies, and then where the next page does
        struct.pack_into("<I", out, entry, struct.unpack_from("<I", out, entry)[0] + shift)
        struct.pack_into("<I", out, start + 2 + 10 * 12, 0 if k == len(pages) - 1 else start + size)
    return bytes(out)


def majority_format(files: DataFrame) -> DataFrame:
    """files(folder, file) of each folder's most frequent format, of equal ones the first of FORMATS."""
    place = F.array_position(F.array(*map(F.lit, FORMATS)), names.extension(F.col("file")))
    x = files.withColumn("format", names.extension(F.col("file"))).withColumn("place", place).filter("place > 0")
    best = x.groupBy("folder", "format", "place").agg(F.count("*").alias("n")).groupBy("folder").agg(F.min_by("format", F.struct(-F.col("n"), "place")).alias("format"))
    return x.drop("place").join(best, ["folder", "format"]).select("folder", "file", "format")


#: Files up to which a listing (some 100 bytes each) is sent to all tasks, so that contents aren't shuffled.
SENT_FILES = 1_000_000


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, folder, file of all files below a folder. Contents aren't read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    piece = F.split("path", "/")
    return x.select("path", F.element_at(piece, -2).alias("folder"), F.element_at(piece, -1).alias("file"), *(["content"] if glob != "*" else [])).filter("file <> '.DS_Store'")


def scan(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """path, folder, file, frame, format, content of a folder's images in its majority format; frames by number, then name. only(folder): the folders to take.

    What is taken is decided on the listing; then the contents of these formats are read and joined with it."""
    files = listing(spark, folder)
    if only is not None:
        files = files.join(only.select("folder"), "folder", "left_semi")
    w = Window.partitionBy("folder").orderBy(F.coalesce(names.frame_number(F.col("file")), F.lit(0)), "file")
    kept = files.select("path", "folder", "file").join(majority_format(files.select("folder", "file")), ["folder", "file"])
    kept = written(kept.withColumn("frame", F.row_number().over(w) - 1), "listing")
    formats = sorted(r.format for r in kept.select("format").distinct().collect())  # of FORMATS
    contents = listing(spark, folder, f"*.{{{','.join(formats or FORMATS)}}}").select("path", "content")
    return contents.join(F.broadcast(kept) if kept.count() <= SENT_FILES else kept, "path").select("path", "folder", "file", "frame", "format", "content")


def decode(files: DataFrame, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """meas_id, t, page, y, x, v of scanned files, t being the file's frame; a file's pages follow each other."""
    known = {"png": read_png, "tif": read_tiff} | (decoders or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for folder, frame, kind, raw in x[["folder", "frame", "format", "content"]].itertuples(index=False, name=None):
                for k, page in enumerate(known[kind](raw)):
                    y, c = np.indices(page.shape)
                    yield pd.DataFrame({"meas_id": folder, "t": int(frame), "page": k, "y": y.ravel(), "x": c.ravel(), "v": page.ravel().astype(float)})

    return files.select("folder", "frame", "format", "content").mapInPandas(run, "meas_id string, t long, page int, y long, x long, v double")


def write_stack(pixels: DataFrame, value: str, folder: str) -> None:
    """A TIFF per frame in a folder that all executors share, in Spark's own part files: one row per frame with its bytes."""

    def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(x["y"].max()) + 1, int(x["x"].max()) + 1), np.float32)
        image[x["y"], x["x"]] = x[value]
        return pd.DataFrame({"frame": [int(key[0])], "tiff": [write_tiff([image])]})

    pixels.select("frame", "y", "x", value).groupBy("frame").applyInPandas(pack, "frame long, tiff binary").write.mode("overwrite").parquet(folder)


def shape_check(shapes: DataFrame, key: str) -> DataFrame:
    """key, n_shapes, uniform of shapes(key, h, w)."""
    return shapes.groupBy(key).agg(F.countDistinct("h", "w").alias("n_shapes")).withColumn("uniform", F.col("n_shapes") == 1)
