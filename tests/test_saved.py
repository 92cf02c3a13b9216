"""Saved tables, sessions, the entry without a library that the text operators need, and plans that compute a lane once."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from pulsegrid.functions import lanes
from pulsegrid.operators import signal
from pulsegrid.sources import saved, sessions

ROOT = Path(__file__).resolve().parent.parent


class Session:
    def __init__(self, **conf):
        self.conf = {"spark." + k.replace("_", "."): v for k, v in conf.items()}


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        saved.shared_dir(Session(master="yarn"))
    assert saved.shared_dir(Session(master="yarn", checkpoint_dir="hdfs:///x")) == "hdfs:///x"
    assert saved.shared_dir(Session(master="local[2]"))


def test_scratch_deletes_what_isnt_kept(spark):
    root = Path(saved.shared_dir(spark))
    there = lambda name: len(list(root.glob(f"pulsegrid-{name}-*")))
    with saved.scratch(spark):
        with saved.scratch(spark) as keep:
            saved.written(spark.range(3), "gone")
            kept = keep(saved.written(spark.range(5), "stays"))
        assert (there("gone"), there("stays"), kept.count()) == (0, 1, 5)
    assert there("stays") == 0
    one = saved.written(spark.range(2), "single")
    saved.drop(one)
    assert there("single") == 0


def test_session_round_trip(spark, tmp_path):
    pixels = spark.createDataFrame([(f, y, x, (y * x) % 3, y + x / 8, 100.0 * f + y) for f in range(3) for y in range(4) for x in range(5) if (y, x) != (3, 4) or f == 0], "frame long, y long, x long, label long, ac double, dc double")
    series = spark.createDataFrame([(f"Cell_{t}", f, 10.0 * f, float(t + f)) for t in range(12) for f in range(3)], "track string, frame long, times double, area double")
    sessions.write_session(pixels, series, ["times", "area"], str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} >= {"segmentation.tif", "ACs.tif", "DCs.tif", "cell_data.csv"}
    back, values, times = sessions.read_session(spark, str(tmp_path))
    want = {(r.frame, r.y, r.x): (r.label, r.ac, r.dc) for r in pixels.collect()}
    got = {(r.frame, r.y, r.x): (r.label, r.ac, r.dc) for r in back.collect()}
    assert len(got) == 60 and all(got[k] == want.get(k, (0, 0.0, 0.0)) for k in got)
    assert sorted((r.track, r.feature, r.place, r.value) for r in values.collect()) == sorted((f"Cell_{t}", n, f, v) for t in range(12) for f in range(3) for n, v in (("times", 10.0 * f), ("area", float(t + f))))
    assert sorted((r.frame, r.time) for r in times.collect()) == [(0, 0.0), (1, 10.0), (2, 20.0)]


def test_entry_survives_a_missing_library(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('no xxhash')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ac_dc_image' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"})


def test_lanes_are_computed_once(spark):
    stack = spark.createDataFrame([(1, [0.5, 1.0, 2.0, 1.5])], "k int, signal array<float>").withColumn("signal", F.col("signal").cast("array<double>"))
    for lane in (lanes.resample(F.col("signal"), 16.7, 17.0), lanes.centred(F.col("signal"))):
        plan = signal.to_frames(stack.select("k", lane.alias("signal")))._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Filter" in line and "lambda" in line for line in plan.split("\n")) and plan.count("transform(") <= 2


def test_mean_signal_of_whole_lanes(spark):
    stack = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 6.0])], "k int, signal array<double>")
    flat = lambda x: sorted((r.t, r.m) for r in x.collect())
    assert flat(signal.mean_signal(stack)) == [(0, 2.0), (1, 4.0), (2, 3.0)]


def test_stacks_from_pixels_worked_out_once(spark, tmp_path):
    """Three files are made of each pixel, which is worked out once; frames may have gaps, rows may come twice, values may be null."""
    rows = [(f, y, x, 1 + y % 2, float(f + x), None if x == 2 else 0.5 * y) for f in (7, 0, 3) for y in range(4) for x in range(3) if (f, y) != (3, 1)]
    seen = spark.sparkContext.accumulator(0)

    def passed(frames):
        for x in frames:
            seen.add(len(x))
            yield x

    kinds = "frame long, y long, x long, label long, ac double, dc double"
    pixels = spark.createDataFrame([*rows, *rows[:5]], kinds).mapInPandas(passed, kinds)
    sessions.make_folder(spark, str(tmp_path))
    sessions.write_stacks(pixels, str(tmp_path))
    assert seen.value == len(rows) + 5
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == sorted(sessions.STACKS)
    got = {(r.frame, r.y, r.x): (r.label, r.ac, None if r.dc != r.dc else r.dc) for r in sessions.read_pixels(spark, str(tmp_path)).collect()}
    there = {([0, 3, 7].index(f), y, x): rest for f, y, x, *rest in rows}
    assert got == {(f, y, x): tuple(there.get((f, y, x), (0, 0.0, 0.0))) for f in range(3) for y in range(4) for x in range(3)}


def test_stack_frames_are_found_without_making_pages(spark, tmp_path):
    pixels = spark.createDataFrame([(5, 1, 2, 1.0), (5, 0, 4, 2.0), (2, 3, 0, 3.0)], "frame int, y long, x long, dc double")
    assert sorted(map(tuple, sessions.page_frames(pixels).select("frame", "number", "bottom", "right").collect())) == [(2, 0, 3, 0), (5, 1, 1, 4)]
    assert sessions.page_frames(pixels.limit(0)).count() == 0
    sessions.write_stack(pixels.limit(0), "dc", "<f8", str(tmp_path / "none.tif"))
    assert (tmp_path / "none.tif").read_bytes() == b"II*\0\x08\0\0\0"
    with pytest.raises(PythonException):  # a page without a frame has no place
        sessions.write_stack(pixels.unionByName(spark.createDataFrame([(None, 1, 2, 1.0)], pixels.schema)), "dc", "<f8", str(tmp_path / "null.tif"))
