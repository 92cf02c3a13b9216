"""TIFF pages in all the ways that they are stored, stacks by runs of rows, files in parts, and CSVs as other tools write them."""

import csv
import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import images, sessions, tiff


def lzw(data: bytes) -> bytes:
    """A plain encoder: codes grow one entry early, the table is cleared when full."""
    bits, table, width, word = [], {bytes([i]): i for i in range(256)}, 9, b""
    put = lambda code, w: bits.append(format(code, f"0{w}b"))
    put(256, 9)
    for k in range(len(data)):
        byte = data[k : k + 1]
        if word + byte in table:
            word += byte
            continue
        put(table[word], width)
        table[word + byte] = len(table) + 2
        if len(table) + 2 == 4094:
            put(256, 12)
            table, width = {bytes([i]): i for i in range(256)}, 9
        elif len(table) + 2 >= (1 << width):
            width += 1
        word = byte
    if word:
        put(table[word], width)
        if len(table) + 3 >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    whole = "".join(bits)
    whole += "0" * (-len(whole) % 8)
    return int(whole, 2).to_bytes(len(whole) // 8, "big")


def packbits(data: bytes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        out += bytes([257 - run]) + data[at : at + 1] if run > 1 else b"\0" + data[at : at + 1]
        at += run
    return out


def stored(pages, order="<", how=1, predictor=1, rows=3, big=False) -> bytes:
    """A file of strips of some rows each, directories after their data."""
    number, count, size = (order + "Q", order + "Q", 8) if big else (order + "I", order + "H", 4)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for p in pages:
        offsets, counts = [], []
        for top in range(0, p.shape[0], rows):
            x = p[top : top + rows]
            if predictor == 2:
                whole = x.view(f"u{x.dtype.itemsize}")
                x = np.concatenate([whole[:, :1], np.diff(whole, axis=1)], axis=1)
            if predictor == 3:
                planes = x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(*x.shape, -1).transpose(0, 2, 1).reshape(len(x), -1)
                raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).tobytes()
            else:
                raw = x.astype(x.dtype.newbyteorder(order)).tobytes()
            raw = {1: bytes, 5: lzw, 8: zlib.compress, 32946: zlib.compress, 32773: packbits}[how](raw)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        lists = []
        for values in (offsets, counts):
            if len(values) > 1:
                lists.append(len(out))
                out += b"".join(struct.pack(number, v) for v in values)
            else:
                lists.append(values[0])
        struct.pack_into(number, out, link, len(out))
        kind = 16 if big else 4
        tags = [(256, 1, p.shape[1]), (257, 1, p.shape[0]), (258, 1, p.dtype.itemsize * 8), (259, 1, how), (262, 1, 1), (273, len(offsets), lists[0]), (277, 1, 1), (278, 1, rows), (279, len(counts), lists[1]), (317, 1, predictor), (339, 1, "uif".index(p.dtype.kind) + 1)]
        out += struct.pack(count, len(tags))
        for tag, n, v in tags:
            out += struct.pack(order + "HH", tag, kind) + struct.pack(number, n) + struct.pack(number, v)
        link = len(out)
        out += bytes(size)
    return bytes(out)


WAYS = [("<", 1, 1), (">", 1, 1), ("<", 5, 1), ("<", 5, 2), (">", 5, 2), ("<", 8, 2), ("<", 32946, 1), ("<", 32773, 1), ("<", 8, 3), (">", 5, 3)]


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("order, how, predictor", WAYS)
def test_pages_however_stored(order, how, predictor, big):
    rng = np.random.default_rng(1)
    for dtype in ("u1", "u2", "i4", "f4", "f8"):
        if (predictor == 2 and dtype[0] == "f") or (predictor == 3 and dtype[0] != "f"):
            continue
        some = [(rng.normal(0, 40, (11, 37)).cumsum(axis=1) if dtype[0] == "f" else rng.integers(0, 200, (11, 37)) // 40).astype(dtype) for _ in range(2)]
        raw = stored(some, order, how, predictor, 4, big)
        for got in (images.read_tiff(raw), [tiff.rows_of(f := io.BytesIO(raw), p, 0, 11) for p in tiff.pages(io.BytesIO(raw))]):
            assert all((a == b).all() for a, b in zip(got, some, strict=True))
        pages = list(tiff.pages(io.BytesIO(raw)))
        assert (tiff.rows_of(io.BytesIO(raw), pages[1], 3, 9) == some[1][3:9]).all()


def test_long_lzw_strips():
    rng = np.random.default_rng(2)
    for data in (bytes(300_000), rng.integers(0, 256, 40_000).astype(np.uint8).tobytes(), b"abc" * 30_000, b"x", b""):
        assert tiff.unlzw(lzw(data)) == data


def test_what_cannot_be_read():
    page = np.zeros((4, 4), np.uint8)
    for raw in (b"", b"nothing of the kind", stored([page])[:60]):
        with pytest.raises((ValueError, struct.error)):
            images.read_tiff(raw)
    broken = bytearray(stored([page, page]))
    struct.pack_into("<I", broken, len(broken) - 4, struct.unpack_from("<I", broken, 4)[0])
    with pytest.raises(ValueError, match="circle"):
        images.read_tiff(bytes(broken))


def test_stacks_by_runs_of_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    masks, values = [rng.integers(0, 9, (13, 10)).astype("i4") for _ in range(3)], [rng.normal(size=(13, 10)) for _ in range(3)]
    (tmp_path / "m.tif").write_bytes(stored(masks, how=5, predictor=2, rows=4))
    (tmp_path / "v.tif").write_bytes(stored(values, ">", rows=13, big=True))
    df = tiff.read_stacks(spark, {"label": (str(tmp_path / "m.tif"), "long"), "dc": (str(tmp_path / "v.tif"), "double")}, together=50)
    assert df.rdd.getNumPartitions() == 3 * 2  # runs of five rows are rounded up to whole strips of four
    got = {(r.frame, r.y, r.x): (r.label, r.dc) for r in df.collect()}
    assert got == {(f, y, x): (int(masks[f][y, x]), float(values[f][y, x])) for f in range(3) for y in range(13) for x in range(10)}
    (tmp_path / "s.tif").write_bytes(stored(values[:2]))
    with pytest.raises(Exception, match="differ"):
        tiff.read_stacks(spark, {"a": (str(tmp_path / "s.tif"), "double"), "b": (str(tmp_path / "v.tif"), "double")}).count()


@pytest.mark.parametrize("big", [False, True])
def test_file_in_parts(spark, tmp_path, big):
    rng = np.random.default_rng(4)
    stack = rng.integers(0, 99, (9, 5, 7)).astype("<i4")
    pages = spark.createDataFrame([(10 * f, stack[f].tobytes()) for f in (4, 0, 8, 3, 1, 7, 2, 6, 5)], "frame long, page binary").repartition(3)
    path = str(tmp_path / "out.tif")
    sessions.write_pages(pages, (5, 7), "<i4", path, together=500, big=big)
    assert (np.array(images.read_tiff((tmp_path / "out.tif").read_bytes())) == stack).all()
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["out.tif"]
    assert {(r.frame, r.y, r.x): r.v for r in sessions.read_stack(spark, path, "v", "long").collect()}[8, 4, 6] == stack[8, 4, 6]


def test_offsets_beyond_4_gb():
    """Directories of a large file point where its pages lie."""
    shape, n = (2048, 2048), 200
    size = tiff.page_size(shape, "<f8", True)
    at = len(tiff.head(True)) + 150 * size
    raw = tiff.page_bytes(b"", shape, "<f8", 150, False, True)[: size - shape[0] * shape[1] * 8]
    assert at > 1 << 32 and struct.unpack("<Q", raw[-8:])[0] == at + size and n > 150

    class Window(io.RawIOBase):  # only the directory is there
        def seek(self, place, *_):
            self.place = place

        def read(self, k=-1):
            data = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if self.place < 16 else raw[:-8] + bytes(8)
            start = self.place if self.place < 16 else self.place - at
            return data[start : start + k]

    page = next(tiff.pages(Window()))
    assert page.offsets == (at + len(raw),) and page.counts == (shape[0] * shape[1] * 8,)


def test_csv_of_other_tools(spark, tmp_path):
    with open(tmp_path / "cell_data.csv", "w", newline="") as f:
        w = csv.writer(f)
        for k in range(40):
            w.writerow([f"Cell_{k}" if k % 9 else f'odd, "{k}"'])
            w.writerow(["times", *[10.0 * t for t in range(3)]])
            w.writerow(["Mean, AC", *[k + t / 4 for t in range(3)]])
            w.writerow([])
    assert b"\r\n" in (tmp_path / "cell_data.csv").read_bytes()
    want = sorted((f"Cell_{k}" if k % 9 else f'odd, "{k}"', n, t, v) for k in range(40) for t in range(3) for n, v in (("times", 10.0 * t), ("Mean, AC", k + t / 4)))
    for size in ("128m", "100b", "57b"):  # also in blocks that cut through tracks
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            assert sorted(map(tuple, sessions.read_series(spark, str(tmp_path)).collect())) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    unix = (tmp_path / "cell_data.csv").read_bytes().replace(b"\r\n", b"\n")
    (tmp_path / "cell_data.csv").write_bytes(unix)
    assert sorted(map(tuple, sessions.read_series(spark, str(tmp_path)).collect())) == want


def test_csv_lines_and_times(spark, tmp_path):
    series = spark.createDataFrame([(n, f, float(f + k)) for k, n in enumerate(("Cell_1", 'a,"b"', "Cell_0")) for f in range(2)], "track string, frame long, area double")
    sessions.write_series(series, ["area"], str(tmp_path / "cell_data.csv"))
    with open(tmp_path / "cell_data.csv", newline="") as f:
        text = f.read()
    assert text.split("\r\n")[:4] == ["Cell_0", "times,0.000000,1.000000", "area,2.000000,3.000000", ""] and "\n" not in text.replace("\r\n", "")
    assert [x[0] for x in csv.reader(text.split("\r\n")) if x and x[0] not in ("times", "area")] == ["Cell_0", "Cell_1", 'a,"b"']
    timed = series.withColumn("time", F.col("frame") * 7.5)
    sessions.write_series(timed, ["area"], str(tmp_path / "cell_data.csv"))
    assert {(r.place, r.value) for r in sessions.read_series(spark, str(tmp_path)).filter("feature = 'times'").collect()} == {(0, 0.0), (1, 7.5)}


def test_small_pages_share_tasks(spark, tmp_path):
    rng = np.random.default_rng(6)
    values = [rng.normal(size=(5, 7)) for _ in range(40)]
    values[3][2, 2] = np.nan
    (tmp_path / "v.tif").write_bytes(stored(values))
    files = {"dc": (str(tmp_path / "v.tif"), "double")}
    for together, tasks in ((1 << 21, spark.sparkContext.defaultParallelism), (80, 20), (35, 40), (14, 40 * 3)):
        df = tiff.read_stacks(spark, files, together=together)
        assert df.rdd.getNumPartitions() == tasks
        got = {(r.frame, r.y, r.x): repr(r.dc) for r in df.collect()}
        assert got == {(f, y, x): repr(float(values[f][y, x])) for f in range(40) for y in range(5) for x in range(7)}
