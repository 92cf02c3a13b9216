"""Multipage TIFF, classic and big, by pages and runs of rows, so that no file has to fit in memory.

Grey pages of one sample, of 8 to 64 bits, whole or floating, in strips that are plain, LZW, deflate or PackBits, with differences along the rows or without.
A Spark data source reads page directories when it is planned, and hands runs of rows to tasks; several files of equal pages are read side by side, as columns."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The format's tags, number types and ways of compression.
WIDTH, HEIGHT, BITS, COMPRESSION, ORDER, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILES, FORMAT = 256, 257, 258, 259, 266, 273, 277, 278, 279, 317, 322, 339
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = "uif"


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    dtype: str
    compression: int
    predictor: int
    rows: int  # in a strip
    offsets: tuple[int, ...]
    counts: tuple[int, ...]


def pages(file: BinaryIO) -> Iterator[Page]:
    """The pages of an open file, from their directories alone."""

    def at(place: int, n: int) -> bytes:
        file.seek(place)
        raw = file.read(n)
        if len(raw) < n:
            raise ValueError("the TIFF file ends early")
        return raw

    head = at(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    number, count, entry = (order + "Q", order + "Q", 20) if big else (order + "I", order + "H", 12)
    wide = struct.calcsize(number)
    place = struct.unpack(number, at(8, 8))[0] if big else struct.unpack(number, head[4:8])[0]
    seen = set()
    while place:
        if place in seen:
            raise ValueError("the TIFF file's pages run in a circle")
        seen.add(place)
        n = struct.unpack(count, at(place, struct.calcsize(count)))[0]
        start = place + struct.calcsize(count)
        raw, tags = at(start, n * entry + wide), {}
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, k * entry)
            length = struct.unpack_from(number, raw, k * entry + 4)[0]
            if kind in TYPES:
                form = f"{order}{length}{TYPES[kind]}"
                size = struct.calcsize(form)
                field = k * entry + 4 + wide
                tags[tag] = struct.unpack_from(form, raw, field) if size <= wide else struct.unpack(form, at(struct.unpack_from(number, raw, field)[0], size))
        if tags.get(SAMPLES, (1,))[0] != 1 or TILES in tags or OFFSETS not in tags or tags.get(ORDER, (1,))[0] != 1:
            raise ValueError("only TIFF pages of one sample in strips can be read")
        bits, form = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
        compression = tags.get(COMPRESSION, (NONE,))[0]
        if bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS):
            raise ValueError(f"a TIFF page of {bits} bits, sample format {form} and compression {compression} can't be read")
        height = tags[HEIGHT][0]
        yield Page(tags[WIDTH][0], height, f"{order}{KINDS[form - 1]}{bits // 8}", compression, tags.get(PREDICTOR, (1,))[0], min(tags.get(ROWS, (height,))[0], height), tags[OFFSETS], tags[COUNTS])
        place = struct.unpack_from(number, raw, n * entry)[0]


def unlzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 starts a new table, 257 ends; codes grow one entry early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, before = first.copy(), [], b""
    held, bits, width = 0, 0, 9
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = first.copy(), b"", 9
            continue
        if code < len(table):
            piece = table[code]
        elif before:
            piece = before + before[:1]
        else:
            raise ValueError("a broken LZW strip")
        out.append(piece)
        if before:
            table.append(before + piece[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        before = piece
    return b"".join(out)


def unpackbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def strip(page: Page, raw: bytes, rows: int) -> np.ndarray:
    """[rows, width] of a strip's bytes."""
    kind = np.dtype(page.dtype)
    size = rows * page.width * kind.itemsize
    data = {NONE: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}[page.compression](raw)
    if len(data) < size:
        raise ValueError("a TIFF strip is too short")
    if page.predictor == 3:  # differences of bytes, most significant ones of a row first
        planes = np.add.accumulate(np.frombuffer(data, np.uint8, size).reshape(rows, -1), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, kind.itemsize, page.width).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, page.width)
    out = np.frombuffer(data, kind, rows * page.width).reshape(rows, page.width)
    if page.predictor == 2:
        whole = out.astype(kind.newbyteorder("=")).view(f"u{kind.itemsize}")
        out = np.add.accumulate(whole, axis=1, dtype=whole.dtype).view(kind.newbyteorder("="))
    return out


def rows_of(file: BinaryIO, page: Page, first: int, last: int) -> np.ndarray:
    """Rows first to last - 1 of a page; of plain strips only their bytes are read."""
    parts, line = [], page.width * np.dtype(page.dtype).itemsize
    for k in range(first // page.rows, -(-last // page.rows)):
        top = k * page.rows
        rows = min(page.rows, page.height - top)
        a, b = max(first - top, 0), min(last - top, rows)
        if page.compression == NONE and page.predictor == 1:
            file.seek(page.offsets[k] + a * line)
            parts.append(strip(page, file.read((b - a) * line), b - a))
        else:
            file.seek(page.offsets[k])
            parts.append(strip(page, file.read(page.counts[k]), rows)[a:b])
    return np.concatenate(parts) if parts else np.zeros((0, page.width), page.dtype)


def head(big: bool) -> bytes:
    """Of a file whose first page's directory follows at once."""
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)


def page_size(shape: tuple[int, int], dtype: str, big: bool) -> int:
    """Bytes of a page with its directory."""
    data = shape[0] * shape[1] * np.dtype(dtype).itemsize
    return (8 + 10 * 20 + 8 if big else 2 + 10 * 12 + 4) + data + data % 2


def page_bytes(raw: bytes, shape: tuple[int, int], dtype: str, number: int, last: bool, big: bool) -> bytes:
    """A page's directory and its one plain strip. All pages are of one size, so a page's number tells where it lies."""
    kind, size = np.dtype(dtype), page_size(shape, dtype, big)
    data = shape[0] * shape[1] * kind.itemsize
    start = len(head(big)) + number * size
    tags = ((WIDTH, shape[1]), (HEIGHT, shape[0]), (BITS, kind.itemsize * 8), (COMPRESSION, NONE), (262, 1), (OFFSETS, start + size - data - data % 2), (SAMPLES, 1), (ROWS, shape[0]), (COUNTS, data), (FORMAT, KINDS.index(kind.kind) + 1))
    following = 0 if last else start + size
    if big:
        directory = struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, 16, 1, v) for t, v in tags) + struct.pack("<Q", following)
    else:
        directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + struct.pack("<I", following)
    return directory + raw + b"\0" * (data % 2)


def where(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and name of a path or URI."""
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path.removeprefix('file:')}")


@dataclass
class Run:
    """Some rows of a page, in each of the files."""

    frame: int
    first: int
    last: int
    parts: list[Page]

    def pixels(self) -> int:
        return (self.last - self.first) * self.parts[0].width


@dataclass
class Runs(InputPartition):
    """What a task reads, a run after the other."""

    runs: list[Run]


class _Reader(DataSourceReader):
    def __init__(self, files: dict[str, list[str]], together: int, tasks: int):
        self.files, self.together, self.tasks = files, together, tasks

    def partitions(self) -> list[Runs]:
        stacks = []
        for path, _ in self.files.values():
            at, name = where(path)
            with at.open_input_file(name) as f:
                stacks.append(list(pages(f)))
        if len({tuple((p.height, p.width) for p in s) for s in stacks}) > 1:
            raise ValueError(f"the pages of {[p for p, _ in self.files.values()]} differ in number or size")
        runs = []
        for frame, parts in enumerate(zip(*stacks, strict=True)):
            page = parts[0]
            step = max(1, self.together // max(1, page.width))
            # Where rows come in compressed strips, a run holds whole ones, lest a strip is decoded twice.
            strips = max((p.rows for p in parts if p.compression != NONE), default=1)
            step = -(-step // strips) * strips
            runs += [Run(frame, a, min(page.height, a + step), list(parts)) for a in range(0, page.height, step)]
        # Small pages share a task, as far as that leaves work for all of them.
        most = min(self.together, -(-sum(r.pixels() for r in runs) // self.tasks))
        out, held = [Runs([])], 0
        for run in runs:
            if out[-1].runs and held + run.pixels() > most:
                out.append(Runs([]))
                held = 0
            out[-1].runs.append(run)
            held += run.pixels()
        return out

    def read(self, partition: Runs) -> Iterator[pa.RecordBatch]:
        if not partition.runs:
            return
        opened = []
        for path, _ in self.files.values():
            at, name = where(path)
            opened.append(at.open_input_file(name))
        try:
            for run in partition.runs:
                yield from self._rows(opened, run)
        finally:
            for f in opened:
                f.close()

    def _rows(self, opened: list, run: Run) -> Iterator[pa.RecordBatch]:
        width = run.parts[0].width
        values = [rows_of(f, page, run.first, run.last) for f, page in zip(opened, run.parts, strict=True)]
        y, x = np.repeat(np.arange(run.first, run.last), width), np.tile(np.arange(width), run.last - run.first)
        columns = [np.full(len(y), run.frame, np.int64), y.astype(np.int64), x.astype(np.int64)]
        columns += [v.ravel().astype("int64" if kind == "long" else "float64") for v, (_, kind) in zip(values, self.files.values(), strict=True)]
        names = ["frame", "y", "x", *self.files]
        for a in range(0, len(y), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in columns], names)


class Stacks(DataSource):
    """frame, y, x and a column for each of the files in the option `files`, a JSON object of names to [path, long or double]. A task reads about `together` pixels, or less if there would be fewer than `tasks`."""

    @classmethod
    def name(cls) -> str:
        return "pulsegrid_stacks"

    def _files(self) -> dict[str, list[str]]:
        return json.loads(self.options["files"])

    def schema(self) -> str:
        return "frame long, y long, x long, " + ", ".join(f"{c} {kind}" for c, (_, kind) in self._files().items())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._files(), int(self.options.get("together", 1 << 21)), int(self.options.get("tasks", 1)))


def read_stacks(spark: SparkSession, files: dict[str, tuple[str, str]], together: int = 1 << 21) -> DataFrame:
    """frame, y, x and a column for each of files: name -> (path, "long" or "double"). The files have equal numbers of pages, of equal sizes."""
    spark.dataSource.register(Stacks)
    return spark.read.format(Stacks.name()).option("files", json.dumps(files)).option("together", together).option("tasks", spark.sparkContext.defaultParallelism).load()
