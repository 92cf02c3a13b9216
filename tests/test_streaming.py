"""Lanes that arrive in pieces, filtered on from the state of the piece before."""

import numpy as np
import pytest

from pulsegrid.functions import filters, lanes
from pulsegrid.streaming import arrivals

SECTIONS = filters.band_pass_sections(4, 0.5, 4.0, 16.7)
SCHEMA = "meas_id string, y int, x long, piece long, signal array<double>, anew boolean"


@pytest.fixture
def store(spark):
    for k, v in arrivals.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in arrivals.STORE:
        spark.conf.unset(k)


def run(spark, tmp_path, **how):
    """Reads what is there, continuing from the checkpoint, and gives all rows so far."""
    stream = arrivals.filtered(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), SECTIONS, **how)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_pieces_give_what_whole_lanes_give(spark, tmp_path, store):
    rng = np.random.default_rng(1)
    whole = {(m, y, x): rng.normal(size=90) for m in "ab" for y in range(2) for x in range(3)}
    cuts = [(0, 25), (25, 26), (26, 60), (60, 90)]
    piece = lambda k, keep=lambda key: True: [(*key, k, v[slice(*cuts[k])].tolist(), False) for key, v in whole.items() if keep(key)]
    arrive(spark, tmp_path, piece(0) + piece(1))
    run(spark, tmp_path)
    arrive(spark, tmp_path, piece(2, lambda key: key[0] == "a"))  # the query was stopped in between
    arrive(spark, tmp_path, piece(2, lambda key: key[0] == "b") + piece(1, lambda key: key == ("a", 0, 0)))  # one comes again
    arrive(spark, tmp_path, piece(3))
    rows = run(spark, tmp_path)
    assert [(r.meas_id, r.y, r.x, r.piece, r.signal) for r in rows if r.late] == [("a", 0, 0, 1, None)]
    flat = spark.createDataFrame([(*k, v.tolist()) for k, v in whole.items()], "meas_id string, y int, x long, signal array<double>")
    want = {(r.meas_id, r.y, r.x): r.s for r in flat.select("meas_id", "y", "x", lanes.sos_filter(SECTIONS)("signal").alias("s")).collect()}
    for key in whole:
        parts = sorted((r.piece, r.signal) for r in rows if not r.late and (r.meas_id, r.y, r.x) == key)
        assert [k for k, _ in parts] == [0, 1, 2, 3] and np.allclose([v for _, s in parts for v in s], want[key], atol=1e-12)


def test_filters_start_anew(spark, tmp_path, store):
    v = np.sin(np.arange(40)).tolist()
    arrive(spark, tmp_path, [("a", 0, 0, 0, v, False), ("a", 0, 0, 5, v, True), ("a", 0, 1, 0, v, None), ("a", 0, 1, 1, [], False), ("a", 0, 1, 2, None, False), ("a", 0, 1, 3, v, False)])
    got = {(r.x, r.piece): r.signal for r in run(spark, tmp_path, reset="anew")}
    assert np.allclose(got[0, 5], got[0, 0]) and not np.allclose(got[1, 3], got[1, 0]) and got[1, 1] == got[1, 2] == []


def test_pieces_of_a_table(spark, store):
    """The same on a table, without a stream."""
    v = np.cos(np.arange(30)).tolist()
    rows = spark.createDataFrame([("a", 0, 0, k, v[10 * k : 10 * k + 10], False) for k in (2, 0, 1)], SCHEMA)
    got = sorted((r.piece, r.signal) for r in arrivals.filtered(rows, SECTIONS).collect())
    want = spark.createDataFrame([(v,)], "signal array<double>").select(lanes.sos_filter(SECTIONS)("signal").alias("s")).first().s
    assert np.allclose([x for _, s in got for x in s], want)
