import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import names
from pulsegrid.operators import labels, signal
from pulsegrid.sources import folders, images
from pulsegrid.streaming import arrivals

NAMES = [("a_x1_16v7fps_10600 PM", 16.7, 786.0, 786.0), ("a_x1_22fps_114500 AM", 22.0, 705.0, 705.0), ("b_x_5v25fps_23000 PM", 5.25, 870.0, 870.0), ("c_x_9fps_113000 PM", 9.0, 690.0, 1410.0), ("c_x_9fps_120500 AM", 9.0, 725.0, 5.0)]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n, *_ in NAMES], "name string")
    n = F.col("name")
    got = {r.name: tuple(r)[1:] for r in df.select("name", names.fps(n), names.minutes_legacy(n), names.minutes_12h(n)).collect()}
    assert got == {k: v for k, *v in [(a, *b) for a, *b in NAMES]} or got == {a: tuple(b) for a, *b in NAMES}
    assert df.select(names.fps_tenths(n).alias("f")).filter("f = 7.5").count() == 1


def test_measurement_table(spark):
    df = spark.createDataFrame([(k, n) for k, (n, *_) in enumerate(NAMES)], "seq long, name string")
    m = folders.measurements(df)
    assert [r.seq for r in m.orderBy("frame").collect()] == [4, 1, 0, 2, 3]
    assert [(r.frame, r.seq) for r in folders.drop_frame(m, 1).orderBy("frame").collect()] == [(0, 4), (1, 0), (2, 2), (3, 3)]
    more = folders.add(m, folders.measurements(spark.createDataFrame([(9, "z_x_1fps_10700 PM")], "seq long, name string")))
    assert [r.seq for r in more.orderBy("frame").collect()] == [4, 1, 0, 9, 2, 3]


def test_versions(spark, tmp_path):
    a = spark.range(3).withColumn("label", F.lit(1))
    folders.save_version(a, str(tmp_path / "v"), 0)
    folders.save_version(a.limit(1), str(tmp_path / "v"), 1)
    assert folders.load_version(spark, str(tmp_path / "v"), 0).count() == 3 and folders.load_version(spark, str(tmp_path / "v"), 1).count() == 1


def png(image: np.ndarray, how: int) -> bytes:
    step = image.dtype.itemsize
    raw = image.astype(image.dtype.newbyteorder(">")).tobytes()
    width = image.shape[1] * step
    lines, above = b"", bytes(width)
    for y in range(image.shape[0]):
        line = raw[y * width : (y + 1) * width]
        out = bytearray([how])
        for x in range(width):
            a, b, c = (line[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((line[x] - (0, a, b, (a + b) // 2, paeth)[how]) % 256)
        lines, above = lines + bytes(out), line
    part = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8 * step, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_image_files():
    rng = np.random.default_rng(0)
    for kind in (np.uint8, np.uint16):
        image = rng.integers(0, np.iinfo(kind).max, (5, 7)).astype(kind)
        for how in range(5):
            assert (images.read_png(png(image, how))[0] == image).all()
    pages = [rng.integers(0, 9, (3, 4)).astype(t) for t in (np.uint8, np.uint16, np.int32, np.float32)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(images.read_tiff(images.write_tiff(pages)), pages, strict=True))


def test_folder_to_lanes(spark, tmp_path):
    rng = np.random.default_rng(1)
    stack = rng.integers(0, 255, (6, 3, 4)).astype(np.uint8)
    folder = tmp_path / "run_x_10fps_10600 PM"
    folder.mkdir()
    for k in (5, 2, 0, 1, 4, 3):
        (folder / f"img{k:04d}.png").write_bytes(png(stack[k], k % 5))
    (folder / "img9999.tif").write_bytes(images.write_tiff([stack[0]]))
    (folder / ".DS_Store").write_bytes(b"x")
    files = images.scan(spark, str(tmp_path))
    assert [r.file for r in files.orderBy("frame").collect()] == [f"img{k:04d}.png" for k in range(6)]
    got = signal.to_lanes(images.decode(files), ["meas_id", "y", "x"]).collect()
    assert len(got) == 12 and all(r.signal == stack[:, r.y, r.x].tolist() for r in got)


def test_tiff_sink(spark, tmp_path):
    px = spark.createDataFrame([(f, y, x, float(f + y * x)) for f in range(2) for y in range(3) for x in range(2)], "frame long, y long, x long, dc double")
    images.write_stack(px, "dc", str(tmp_path / "out"))
    back = {r.frame: images.read_tiff(bytes(r.tiff))[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back[1].tolist() == [[1, 1], [1, 2], [1, 3]]


def test_settings_files(spark, tmp_path):
    for k, h in enumerate((512, 512, 400)):
        d = tmp_path / f"s{k}"
        d.mkdir()
        (d / "a.ini").write_text(f"[data]\nAOIHeight = {h}\nAOIWidth=640\nother\n")
    shapes = folders.ini_shapes(spark, f"{tmp_path}/*/*.ini")
    assert sorted((r.h, r.w) for r in shapes.collect()) == [(400, 640), (512, 640), (512, 640)]
    r = images.shape_check(shapes.withColumn("day", F.lit(1)), "day").first()
    assert (r.n_shapes, r.uniform) == (2, False)


def test_session_times(spark):
    lines = spark.createDataFrame([("Cell_0",), ("times,0.0,10.5,3",), ("area,1,2,3",), ("times,10.5,20",), ("",)], "value string")
    assert [tuple(r) for r in folders.session_times(lines).select("frame", "time").orderBy("frame").collect()] == [(0, 0.0), (1, 3.0), (2, 10.5), (3, 20.0)]


def test_brush_and_picks(spark):
    p = spark.createDataFrame([(0, y, x, int(x > 4)) for y in range(8) for x in range(8)], "frame long, y long, x long, label long")
    painted = labels.paint(p, labels.square(spark, 0, 1, 0, 1, 5))
    assert painted.filter("label = 5").count() == 6
    assert labels.pick(painted, 0, 0, 0).first().label == 5 and labels.pick(painted, 0, 50, 0).count() == 0
    assert labels.count_labels(painted).first().n_labels == 3
    assert labels.change(painted, 0, 0, 7, 0).filter("label > 0").select("label").distinct().count() == 1


def test_stream_of_lanes(spark, tmp_path):
    schema = "meas_id string, at timestamp, y int, x int, signal array<double>"
    rows = [(f"m{k % 2}", f"2024-01-01 00:{k:02d}:00", 0, k, [float(k), 1.0, 2.0, 3.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "meas_id string, at string, y int, x int, signal array<double>").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = arrivals.activity(arrivals.extracted(arrivals.lane_stream(spark, str(tmp_path / "in"), schema), signal.Analysis()))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.table("activity").agg(F.sum("pixels")).first()[0] == 30
        assert spark.table("activity").count() == 12
    finally:
        q.stop()


def test_written_tables_are_cleared(spark):
    from pathlib import Path

    from pulsegrid.sources import saved

    saved.clear(spark)
    t = saved.written(spark.range(5), "five")
    files = [Path(f.removeprefix("file://")) for f in t.inputFiles()]
    assert t.count() == 5 and all(f.exists() for f in files)
    saved.clear(spark)
    assert not any(f.exists() for f in files)


def test_a_day_from_names_to_amplitudes(spark, tmp_path):
    from pulsegrid.sources import days

    rng, stacks = np.random.default_rng(5), {}
    for name, n in {"a_x1_10fps_10600 PM": 64, "b_X2_12v5fps_114500 AM": 80, "c_x1_20fps_20000 PM": 90, "d_x1_9fps_30000 PM": 20, "no mark_10fps_10000 AM": 5}.items():
        stacks[name] = (100 + 50 * np.sin(np.arange(n)[:, None, None] / 3) + rng.integers(0, 30, (n, 2, 3))).astype(np.uint8)
        (tmp_path / name).mkdir()
        if name[0] == "c":  # several pages a file
            for k in range(3):
                (tmp_path / name / f"s{2 - k}.tif").write_bytes(images.write_tiff(list(stacks[name][30 * (2 - k) : 30 * (3 - k)])))
        else:
            for k, image in enumerate(stacks[name]):
                (tmp_path / name / f"i{k:04d}.png").write_bytes(png(image, k % 5))
    (tmp_path / "a_x1_10fps_10600 PM" / "i0000.tif").write_bytes(b"refused")
    how = signal.Analysis(frequency=1.0)
    day, got = days.extract(spark, str(tmp_path), how, fractions=(0.1, 0.9))
    assert [(r.name[0], r.fps) for r in day.orderBy("place").collect()] == [("b", 12.5), ("a", 10.0), ("c", 20.0), ("d", 9.0)]
    rows = {(r.meas_id, r.y, r.x): r for r in got.collect()}
    assert len(rows) == 4 * 6
    for r in day.collect():
        s = stacks[r.name]
        n = len(s)
        alone = spark.createDataFrame([(y, x, s[:, y, x].astype(float).tolist()) for y in range(2) for x in range(3)], "y int, x int, signal array<double>")
        for one in signal.extract(alone, how.changed(fps=r.fps), int(0.1 * n), int(0.9 * n - 1)).collect():
            mine = rows[r.name, one.y, one.x]
            assert (mine["first"], mine["last"]) == (one["first"], one["last"]) and np.allclose((mine.dc, mine.ac), (one.dc, one.ac))
    few, _ = days.extract(spark, str(tmp_path), how, start=1, stride=2, holds="x1")
    assert [r.name[0] for r in few.collect()] == ["c"]
    for bad in ({"start": 9}, {"holds": "zz"}):
        with pytest.raises(ValueError, match="left"):
            days.extract(spark, str(tmp_path), how, **bad)
    (tmp_path / "a_x1_10fps_10600 PM" / "i9999.png").write_bytes(png(np.zeros((3, 3), np.uint8), 0))
    with pytest.raises(ValueError, match="different sizes in a_x1"):
        days.extract(spark, str(tmp_path), how)
