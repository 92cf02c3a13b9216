import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import filters, lanes
from pulsegrid.operators import signal

FPS = 16.7


def stack(spark, signals):
    return spark.createDataFrame([(0, k, [float(v) for v in s]) for k, s in enumerate(signals)], "y int, x int, signal array<double>")


def test_constant_and_sine(spark):
    n = 400
    t = np.arange(n)
    rows = signal.process(stack(spark, [np.full(n, 3.0), 2 + 1.5 * np.sin(2 * np.pi * t / 20)]), signal.Analysis(fps=20.0)).orderBy("x").collect()
    assert rows[0].dc == pytest.approx(3) and rows[0].ac == pytest.approx(0, abs=1e-9)
    assert rows[1].dc == pytest.approx(2) and rows[1].ac == pytest.approx(1.5, rel=0.01)


def test_last_sample_is_left_out_of_the_sum(spark):
    x = np.array([0.5, -1.0, 2.0, 7.0])
    got = stack(spark, [x]).select(lanes.ac(F.col("signal"), 1.0, FPS).alias("a")).first().a
    w = 2 * math.pi / FPS
    assert got == pytest.approx(2 / 4 * abs(sum(v * np.exp(-1j * w * k) for k, v in enumerate(x[:-1]))))


def test_band_edges():
    s = filters.band_pass_sections(4, 0.1, 6.0, FPS)
    at = lambda f: abs(filters.response(s, np.exp(2j * math.pi * f / FPS)))
    assert s.shape == (4, 6)
    assert at(0.1) == pytest.approx(2**-0.5, rel=1e-6) and at(6.0) == pytest.approx(2**-0.5, rel=1e-6)
    assert at(1.0) == pytest.approx(1, abs=1e-3) and at(0.005) < 1e-4


def test_filter_is_its_response(spark):
    s = filters.band_pass_sections(4, 0.5, 4.0, FPS)
    n = 2048
    got = np.array(stack(spark, [np.eye(1, n)[0], np.eye(1, 7)[0]]).select(lanes.sos_filter(s)("signal").alias("y")).collect()[0].y)
    spectrum = np.fft.rfft(got)
    want = [filters.response(s, np.exp(2j * math.pi * k / n)) for k in range(n // 2 + 1)]
    assert np.allclose(spectrum, want, atol=1e-6)


def test_band_is_clamped_or_refused():
    assert filters.clamp_band(3, 20, 1.0, 10.0) == (1.0, 4.995)
    with pytest.raises(ValueError):
        filters.clamp_band(0, 6, 1, FPS)
    with pytest.raises(ValueError):
        filters.band_pass_sections(4, 1, 9, 16.7)


def mean_of(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "t int, m double")


def test_limits_avoid_a_step(spark):
    m = np.sin(np.arange(300) / 3) * 0.1
    m[100:] += 30
    r = signal.clean_limits(mean_of(spark, m), 0, 299, 1.0, FPS).first()
    assert (r["first"], r["last"]) == (100, 298)
    assert r.periods == math.floor(199 / FPS)


def test_last_of_equal_gaps_wins(spark):
    m = np.zeros(31)
    m[10], m[20] = 0, 0
    m[11:] += 100
    m[21:] -= 100
    r = signal.clean_limits(mean_of(spark, m), 0, 30, 1.0, FPS, sigmas=1.5).first()
    assert (r["first"], r["last"]) == (21, 29)


def test_whole_periods(spark):
    r = signal.clean_limits(mean_of(spark, np.zeros(400)), 0, 399, 1.0, FPS)
    assert tuple(r.first()) == (0, 399, 23)
    assert tuple(signal.trim_to_periods(r, 400, 1.0, FPS).first()) == (0, 384)
    few = spark.createDataFrame([(3, 10, 0)], "first long, last long, periods long")
    assert tuple(signal.trim_to_periods(few, 400, 1.0, FPS).first()) == (3, 399)
    bad = spark.createDataFrame([(399, 399, 0)], "first long, last long, periods long")
    assert tuple(signal.trim_to_periods(bad, 400, 1.0, FPS).first()) == (0, 399)


def test_given_limits(spark):
    x = signal.extract(stack(spark, [np.arange(100)]), signal.Analysis(fps=10.0), 5, 94, periods=2).first()
    assert (x["first"], x["last"]) == (5, 25) and x.dc == pytest.approx(15)


def test_resampling_keeps_straight_lines(spark):
    got = np.array(stack(spark, [np.arange(50)]).select(lanes.resample(F.col("signal"), 10.0, 25.0).alias("s")).first().s)
    assert len(got) == 123 and got[0] == 0 and got[-1] == 49
    inner = got[5:-5]
    assert np.allclose(np.diff(inner), np.diff(inner)[0])


def test_long_and_wide_agree(spark):
    s = stack(spark, [[1, 2, 3], [4, 5, 6]])
    back = signal.to_lanes(signal.to_frames(s), ["y", "x"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.collect()))


def test_spectrum_as_fft(spark):
    m = np.random.default_rng(0).normal(size=64)
    got = [r.amp for r in signal.spectrum(mean_of(spark, m), 64, FPS).orderBy("k").collect()]
    assert np.allclose(got, 2 / 64 * np.abs(np.fft.rfft(m))[:32])


def test_random_stack(spark):
    s = signal.random_stack(spark, 20, 3, 4)
    v = [x for r in s.collect() for x in r.signal]
    assert len(v) == 240 and 0 <= min(v) and max(v) < 1 and abs(np.mean(v) - 0.5) < 0.1
    assert s.collect() == signal.random_stack(spark, 20, 3, 4).collect()


def test_typed_frequencies():
    assert signal.frequency_limits("-1", "99", 8.0) == (0.0, 8.0) and signal.frequency_limits("x", "2", 8.0) == (0.1, 6.0)


def test_points_and_views(spark):
    s = stack(spark, [[1, 2, 3], [4, 5, 6]])
    assert signal.read_point(s, 2, 0, 1).first().v == 6
    assert signal.read_point(s, 3, 0, 1).count() == 0 and signal.read_point(s, -1, 0, 1).count() == 0 and signal.read_point(s, 0, 9, 9).count() == 0
    assert signal.view(s, 1, 2).count() == 4


def measured(spark, seed=4):
    """Three measurements of unequal lengths and rates, with steps in their signals, and one that is a single frame."""
    rng, rows = np.random.default_rng(seed), []
    for m, (n, fps) in {"a": (120, 10.0), "b": (90, 12.5), "c": (150, 20.0), "d": (1, 9.0)}.items():
        for k in range(7):
            v = rng.normal(0, 0.3, n) + np.sin(2 * math.pi * np.arange(n) / fps)
            if m != "a":
                v[n // 3 :] += 40
            rows.append((m, fps, 0, k, v.tolist()))
    return spark.createDataFrame(rows, "meas_id string, fps double, y int, x int, signal array<double>")


@pytest.mark.parametrize("more", [{}, {"interpolate": True, "band_pass": True, "high": 3.0}, {"interpolate": True, "ceiling_axis": True}])
def test_measurements_together_as_one_at_a_time(spark, more):
    stacks = measured(spark).filter("meas_id <> 'd'")
    how = signal.Analysis(fps="fps", **more)
    together = {(r.meas_id, r.x): r for r in signal.time_axis(signal.extract(stacks, how, keys=["meas_id"], fractions=(0.1, 0.9)), how).collect()}
    assert len(together) == 21
    for m, fps, n in (("a", 10.0, 120), ("b", 12.5, 90), ("c", 20.0, 150)):
        one = how.changed(fps=fps)
        alone = signal.time_axis(signal.extract(stacks.filter(F.col("meas_id") == m).drop("meas_id", "fps"), one, int(0.1 * n), int(0.9 * n - 1)), one).collect()
        assert len(alone) == 7
        for r in alone:
            t = together[m, r.x]
            assert (t["first"], t["last"]) == (r["first"], r["last"]) and (t.dc, t.ac) == pytest.approx((r.dc, r.ac))
            assert np.allclose(t.signal, r.signal) and np.allclose(t.times, r.times)


def test_limits_of_each_measurement(spark):
    found = {r.meas_id: tuple(r)[1:] for r in signal.limits(measured(spark), signal.Analysis(fps="fps"), keys=["meas_id"]).collect()}
    assert found["a"] == (120, 0, 110) and found["d"] == (1, 0, 0)
    assert found["c"][0] == 150 and 50 <= found["c"][1] and (found["c"][2] - found["c"][1]) % 20 == 0
    given = {r.meas_id: tuple(r)[1:] for r in signal.limits(measured(spark), signal.Analysis(fps="fps"), 5, 60, periods=2, keys=["meas_id"]).collect()}
    assert given["a"] == (120, 5, 25) and given["b"] == (90, 5, 30)


def test_mean_is_one_scan_of_any_length(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(3)), [None if rng.random() < 0.1 else float(x) for x in rng.normal(size=int(n))]) for n in rng.integers(0, 400, 60)] + [(1, None), (2, [])]
    stack = spark.createDataFrame(rows, "k int, signal array<double>").repartition(5)
    want = {}
    for k, v in rows:
        for t, x in enumerate(v or []):
            if x is not None:
                want.setdefault((k, t), []).append(x)
    got = {(r.k, r.t): r.m for r in signal.mean_signal(stack, keys=["k"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(np.mean(v)) for k, v in want.items())
    every = {r.t: r.m for r in signal.mean_signal(stack).collect()}
    assert every == pytest.approx({t: np.mean([x for (_, u), v in want.items() if u == t for x in v]) for t in {t for _, t in want}})
    plan = signal.mean_signal(stack)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    assert signal.mean_signal(stack.limit(0)).count() == 0


def test_filter_from_a_state(spark):
    s = filters.band_pass_sections(4, 0.5, 4.0, FPS)
    rng = np.random.default_rng(8)
    lanes_ = [rng.normal(size=n).tolist() for n in (50, 31, 9)]
    whole = stack(spark, lanes_).select("x", lanes.sos_filter(s)("signal").alias("y"))
    run = lanes.sos_filter_from(s)
    first = stack(spark, [v[:7] for v in lanes_]).select("x", run("signal", F.lit(None).cast("array<double>")).alias("a"))
    rest = stack(spark, [v[7:] for v in lanes_]).join(first, "x").select("x", "a", run("signal", F.col("a.state")).alias("b"))
    want = {r.x: r.y for r in whole.collect()}
    for r in rest.collect():
        assert np.allclose(r.a.signal + r.b.signal, want[r.x], atol=1e-12) and len(r.b.state) == 8
