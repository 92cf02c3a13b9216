"""The queries over the test tables, with the SQL that gives the same rows.

Doubles are rounded on both sides, since the two engines add in different orders; adding 0.0 makes a negative zero a plain one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import lanes as L
from pulsegrid.functions import names
from pulsegrid.operators import geometry, labels, measure, series, signal, stabilise, tracking
from pulsegrid.sources import folders, images, journal, sessions, spools, tables
from pulsegrid.sources.saved import shared_dir, written
from pulsegrid.sources.tables import BOXES_SQL, LANES_SQL, PIXELS_SQL, SAMPLES_SQL, SHAPES_SQL, lanes, pixels, samples, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

F0, FPS, N = 1.0, 16.7, 64
PI = repr(math.pi)


def query(name: str, sql: str = "") -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def nudge(digits: int) -> float:
    """Added to means of whole cents before rounding: else a mean that ends in 5 would fall to either side by its last bit."""
    return 0.123 * 10.0**-digits


def whole(*names_: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names_]


# ---- lanes

GOERTZEL = f"sqrt(pow(sum(CASE WHEN t < n - 1 THEN (v - dc) * cos(2 * {PI} * {F0} / {FPS} * t) ELSE 0 END), 2) + pow(sum(CASE WHEN t < n - 1 THEN (v - dc) * sin(2 * {PI} * {F0} / {FPS} * t) ELSE 0 END), 2)) * 2 / max(n)"


@query("ac_dc_image", f"WITH {LANES_SQL}, m AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS dc FROM lane) SELECT vec_id, round(max(dc), 6) + 0.0 AS dc, round({GOERTZEL}, 6) + 0.0 AS ac FROM m GROUP BY vec_id")
def ac_dc_image(spark, d):
    return signal.process(lanes(spark, d), signal.Analysis()).select("vec_id", r("dc").alias("dc"), r("ac").alias("ac"))


BIN = f"(2 * {PI} * round({F0} * n / {FPS}) / n * t)"


@query("power_at_bin", f"WITH {LANES_SQL} SELECT vec_id, round(sqrt(pow(sum(CASE WHEN t < n - 1 THEN v * cos{BIN} ELSE 0 END), 2) + pow(sum(CASE WHEN t < n - 1 THEN v * sin{BIN} ELSE 0 END), 2)) * 2 / max(n), 6) + 0.0 AS power FROM lane GROUP BY vec_id")
def power_at_bin(spark, d):
    return lanes(spark, d).select("vec_id", r(L.power_at_bin(F.col("signal"), F0, FPS)).alias("power"))


@query("detrend_lane", f"WITH {LANES_SQL} SELECT vec_id, t, round(v - avg(v) OVER (PARTITION BY vec_id), 6) + 0.0 AS v FROM lane")
def detrend_lane(spark, d):
    x = lanes(spark, d).select("vec_id", L.centred(F.col("signal")).alias("signal"))
    return signal.to_frames(x).select("vec_id", *whole("t"), r("v").alias("v"))


@query("time_axis", f"WITH {LANES_SQL} SELECT vec_id, t, round(t / {FPS}, 6) AS time FROM lane")
def time_axis(spark, d):
    x = lanes(spark, d).select("vec_id", F.posexplode(L.times(F.col("signal"), FPS)).alias("t", "time"))
    return x.select("vec_id", *whole("t"), r("time").alias("time"))


@query("time_axis_interpolated", "WITH c AS (SELECT vec_id, CAST(floor((len(embedding) - 1) * (16.0 / 16.2) + 1e-9) AS INTEGER) + 1 AS cnt FROM embeddings) SELECT vec_id, cnt AS n, round((cnt - 1) / 17.0, 6) AS last_time FROM c")
def time_axis_interpolated(spark, d):
    how = signal.Analysis(fps=16.2, interpolate=True, ceiling_axis=True)
    x = signal.time_axis(signal.process(lanes(spark, d), how), how)
    return x.select("vec_id", F.size("times").alias("n"), r(F.array_max("times")).alias("last_time"))


@query("reanalysed", f"WITH {LANES_SQL}, m AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS dc FROM lane) SELECT vec_id, round(max(dc), 6) + 0.0 AS dc, round({GOERTZEL.replace(f'{PI} * {F0} / {FPS}', f'{PI} * 2.5 / 20.0')}, 6) + 0.0 AS ac FROM m GROUP BY vec_id")
def reanalysed(spark, d):
    """The same stack with another frequency and rate."""
    how = signal.Analysis().changed(frequency=2.5, fps=20.0)
    return signal.process(lanes(spark, d), how).select("vec_id", r("dc").alias("dc"), r("ac").alias("ac"))


@query("lane_slice", f"WITH {LANES_SQL} SELECT vec_id, t - 5 AS t, round(v, 6) + 0.0 AS v FROM lane WHERE t BETWEEN 5 AND 40")
def lane_slice(spark, d):
    x = lanes(spark, d).select("vec_id", L.cut(F.col("signal"), 5, 40).alias("signal"))
    return signal.to_frames(x).select("vec_id", *whole("t"), r("v").alias("v"))


@query("lane_round_trip", f"WITH {LANES_SQL} SELECT vec_id, count(*) AS n, round(sum(v * (t + 1)), 6) + 0.0 AS weighted FROM lane GROUP BY vec_id")
def lane_round_trip(spark, d):
    x = signal.to_frames(signal.to_lanes(signal.to_frames(lanes(spark, d)), ["vec_id", "y", "x", "label"]))
    return x.groupBy("vec_id").agg(F.count("*").alias("n"), r(F.sum(F.col("v") * (F.col("t") + 1))).alias("weighted"))


MEAN = "mean AS (SELECT t, avg(v) AS m FROM lane GROUP BY t)"


@query("spatial_mean_signal", f"WITH {LANES_SQL}, {MEAN} SELECT t, round(m, 6) + 0.0 AS m FROM mean")
def spatial_mean_signal(spark, d):
    return signal.mean_signal(lanes(spark, d)).select(*whole("t"), r("m").alias("m"))


@query("roi_mean_signal", f"WITH {LANES_SQL} SELECT t, round(avg(v), 6) + 0.0 AS m FROM lane WHERE y BETWEEN 2 AND 9 AND x BETWEEN 3 AND 17 GROUP BY t")
def roi_mean_signal(spark, d):
    return signal.mean_signal(lanes(spark, d), signal.in_region((2, 9), (3, 17))).select(*whole("t"), r("m").alias("m"))


STEPS = "st AS (SELECT t, lead(m) OVER (ORDER BY t) - m AS d, stddev_pop(m) OVER () AS sd FROM mean), steps AS (SELECT t, d, abs(d) > 2 * sd AS outlier FROM st WHERE d IS NOT NULL)"


@query("signal_diff_outliers", f"WITH {LANES_SQL}, {MEAN}, {STEPS} SELECT t, round(d, 6) + 0.0 AS d, outlier FROM steps")
def signal_diff_outliers(spark, d):
    return signal.steps(signal.mean_signal(lanes(spark, d))).select(*whole("t"), r("d").alias("d"), "outlier")


LIMITS = f"""o AS (SELECT CAST(t AS BIGINT) AS pt FROM steps WHERE outlier), e AS (SELECT pt FROM o UNION ALL SELECT 0 UNION ALL SELECT {N - 1}),
g AS (SELECT pt AS hi, lag(pt) OVER (ORDER BY pt) AS lo, row_number() OVER (ORDER BY pt) AS k FROM e),
b AS (SELECT lo, hi FROM g WHERE lo IS NOT NULL ORDER BY hi - lo DESC, k DESC LIMIT 1),
l AS (SELECT CASE WHEN (SELECT count(*) FROM o) = 0 THEN 0 ELSE lo + 1 END AS first, CASE WHEN (SELECT count(*) FROM o) = 0 THEN least({N - 1}, (SELECT max(t) FROM mean)) ELSE hi - 1 END AS last FROM b),
limits AS (SELECT CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CAST(floor((last - first + 1) * ({F0} / {FPS})) AS BIGINT) AS periods FROM l)"""


@query("clean_limits", f"WITH {LANES_SQL}, {MEAN}, {STEPS}, {LIMITS} SELECT first, last, periods FROM limits")
def clean_limits(spark, d):
    return signal.clean_limits(signal.mean_signal(lanes(spark, d)), 0, N - 1, F0, FPS)


TRIM = f"""p AS (SELECT first, last, periods, coalesce((SELECT max(k) FROM range(0, 200) q(k) WHERE k <= periods AND floor(k / {F0} * {FPS} + 0.5) + first <= last), 0) AS p FROM limits),
raw AS (SELECT first, CAST(least({N - 1}, CASE WHEN periods < 1 THEN greatest(last, {N - 1}) ELSE first + least(floor(p / {F0} * {FPS} + 0.5), {N - 1} - first) END) AS BIGINT) AS last FROM p),
trimmed AS (SELECT CASE WHEN first >= last THEN 0 ELSE first END AS first, CASE WHEN first >= last THEN {N - 1} ELSE last END AS last FROM raw)"""


@query("period_trim", f"WITH {LANES_SQL}, {MEAN}, {STEPS}, {LIMITS}, {TRIM} SELECT first, last FROM trimmed")
def period_trim(spark, d):
    return signal.trim_to_periods(signal.clean_limits(signal.mean_signal(lanes(spark, d)), 0, N - 1, F0, FPS), N, F0, FPS)


RESAMPLED = f"""c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS s, len(embedding) AS n, CAST(floor((len(embedding) - 1) * (17.0 / {FPS}) + 1e-9) AS INTEGER) + 1 AS cnt FROM embeddings),
i AS (SELECT vec_id, s, n, cnt, unnest(range(cnt)) AS t FROM c),
k AS (SELECT *, t * ((n - 1) / greatest(cnt - 1, 1)::DOUBLE) AS pos FROM i),
u AS (SELECT *, CAST(floor(pos) AS INTEGER) AS k, pos - floor(pos) AS u FROM k),
q AS (SELECT vec_id, t, cnt, u, s[least(greatest(k - 1, 0), n - 1) + 1] AS a, s[least(k, n - 1) + 1] AS b, s[least(k + 1, n - 1) + 1] AS c, s[least(k + 2, n - 1) + 1] AS d FROM u),
fine AS (SELECT vec_id, t, cnt, (2 * pow(u, 3) - 3 * u * u + 1) * b + (pow(u, 3) - 2 * u * u + u) * (c - a) / 2 + (3 * u * u - 2 * pow(u, 3)) * c + (pow(u, 3) - u * u) * (d - b) / 2 AS v FROM q)"""


@query("resample_cubic", f"WITH {RESAMPLED} SELECT vec_id, t, round(v, 6) + 0.0 AS v FROM fine")
def resample_cubic(spark, d):
    x = lanes(spark, d).select("vec_id", L.resample(F.col("signal"), FPS, 17.0).alias("signal"))
    return signal.to_frames(x).select("vec_id", *whole("t"), r("v").alias("v"))


@query("spectrum_one_sided", f"WITH {LANES_SQL}, {MEAN}, k AS (SELECT unnest(range({N // 2})) AS k) SELECT k, round(k * {FPS} / {N}, 8) AS freq, round(sqrt(pow(sum(m * cos(2 * {PI} / {N} * k * t)), 2) + pow(sum(m * sin(2 * {PI} / {N} * k * t)), 2)) * 2 / {N}, 6) AS amp FROM k, mean GROUP BY k")
def spectrum_one_sided(spark, d):
    x = signal.spectrum(signal.mean_signal(lanes(spark, d)), N, FPS)
    return x.select(*whole("k"), r("freq", 8).alias("freq"), r("amp").alias("amp"))


#: Gain, and a1 and a2 of each section, of the band-pass of order 4 from 0.1 to 6 Hz, by frame rate. They come from the Butterworth polynomial (1, 2 cos(pi / 8), 1) * (1,
#: 2 cos(3 pi / 8), 1) by substituting the band-pass and bilinear transforms as polynomials and taking the denominator's roots, not from the design under test.
SECTIONS = {
    16.7: (0.28407711641496947, (0.726574361339, 0.163141055119), (0.979030409012, 0.548071554963), (-1.930597488052, 0.93200737975), (-1.970572106101, 0.971974755227)),
    17.0: (0.2678542068742584, (0.680095494118, 0.147976569932), (0.923804558583, 0.537203345783), (-1.931776514985, 0.933139300502), (-1.97111991503, 0.97247406699)),
}


def _cascade_sql(source: str, fps: float) -> str:
    """A recursion over time: each step runs the four sections in turn on the next sample."""
    gain, *parts = SECTIONS[fps]
    sections = [(g, 0.0, -g, 1.0, a1, a2) for g, (a1, a2) in zip((gain, 1.0, 1.0, 1.0), parts, strict=True)]
    value, steps = "x", []
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        new = f"y{k}"
        steps.append((f"{b0!r} * ({value}) + p{k}", new, f"{b1!r} * ({value}) - ({a1!r}) * {new} + q{k}", f"{b2!r} * ({value}) - ({a2!r}) * {new}"))
        value = new
    state = ", ".join(f"p{k}, q{k}" for k in range(len(sections)))
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS p{k}, CAST(0 AS DOUBLE) AS q{k}" for k in range(len(sections)))
    inner = f"SELECT r.vec_id, r.t + 1 AS t, s.v AS x, {', '.join(f'r.p{k}, r.q{k}' for k in range(len(sections)))} FROM iir r JOIN centred s ON s.vec_id = r.vec_id AND s.t = r.t + 1"
    for y, name, _, _ in steps:
        inner = f"SELECT *, {y} AS {name} FROM ({inner})"
    final = ", ".join(f"{p} AS p{k}, {q} AS q{k}" for k, (_, _, p, q) in enumerate(steps))
    return f"WITH RECURSIVE {source}, iir(vec_id, t, v, {state}) AS (SELECT DISTINCT vec_id, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), {zero.replace(' AS p', ' AS p')} FROM centred UNION ALL SELECT vec_id, t, {value} AS v, {final} FROM ({inner}))"


BAND = signal.Analysis(band_pass=True)


@query("bandpass_sos", f"{_cascade_sql(f'{LANES_SQL}, centred AS (SELECT vec_id, t, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM lane)', 16.7)} SELECT vec_id, t, round(v, 6) + 0.0 AS v FROM iir WHERE t >= 0")
def bandpass_sos(spark, d):
    return signal.to_frames(signal.process(lanes(spark, d), BAND).select("vec_id", "signal")).select("vec_id", *whole("t"), r("v").alias("v"))


@query("bandpass_in_pieces", SQL["bandpass_sos"])
def bandpass_in_pieces(spark, d):
    """As bandpass_sos, each lane cut into three pieces that take up the filter's state from the one before."""
    run, x = L.sos_filter_from(BAND.sections()), lanes(spark, d).select("vec_id", L.centred(F.col("signal")).alias("signal"))
    state, parts = F.lit(None).cast("array<double>"), []
    for k, (a, b) in enumerate(((0, 19), (20, 40), (41, 1 << 30))):
        x = x.withColumn(f"piece{k}", run(L.cut(F.col("signal"), a, b), state))
        state = F.col(f"piece{k}.state")
        parts.append(F.col(f"piece{k}.signal"))
    return signal.to_frames(x.select("vec_id", F.concat(*parts).alias("signal"))).select("vec_id", *whole("t"), r("v").alias("v"))


FULL = signal.Analysis(band_pass=True, interpolate=True)


@query(
    "process_stack",
    f"{_cascade_sql(f'{RESAMPLED}, centred AS (SELECT vec_id, t, v - avg(v) OVER (PARTITION BY vec_id) AS v, avg(v) OVER (PARTITION BY vec_id) AS dc, cnt FROM fine)', 17.0)} "
    f"SELECT vec_id, round(max(dc), 6) + 0.0 AS dc, round(sqrt(pow(sum(CASE WHEN t < cnt - 1 THEN i.v * cos(2 * {PI} * {F0} / 17.0 * t) ELSE 0 END), 2) + pow(sum(CASE WHEN t < cnt - 1 THEN i.v * sin(2 * {PI} * {F0} / 17.0 * t) ELSE 0 END), 2)) * 2 / max(cnt), 6) + 0.0 AS ac FROM iir i JOIN centred c USING (vec_id, t) GROUP BY vec_id",
)
def process_stack(spark, d):
    return signal.process(lanes(spark, d), FULL).select("vec_id", r("dc").alias("dc"), r("ac").alias("ac"))


@query(
    "extract_trimmed",
    f"WITH {LANES_SQL}, {MEAN}, {STEPS}, {LIMITS}, {TRIM}, cut AS (SELECT vec_id, t - first AS t, v, last - first + 1 AS n FROM lane, trimmed WHERE t BETWEEN first AND last), m AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS dc FROM cut) SELECT vec_id, round(max(dc), 6) + 0.0 AS dc, round({GOERTZEL}, 6) + 0.0 AS ac FROM m GROUP BY vec_id",
)
def extract_trimmed(spark, d):
    return signal.extract(lanes(spark, d), signal.Analysis()).select("vec_id", r("dc").alias("dc"), r("ac").alias("ac"))


HARD = "limits AS (SELECT CAST(5 AS BIGINT) AS first, CAST(60 AS BIGINT) AS last, CAST(3 AS BIGINT) AS periods)"


@query(
    "extract_hard_limits",
    f"WITH {LANES_SQL}, {HARD}, {TRIM}, cut AS (SELECT vec_id, t - first AS t, v, last - first + 1 AS n FROM lane, trimmed WHERE t BETWEEN first AND last), m AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS dc FROM cut) SELECT vec_id, max(n) AS n, round(max(dc), 6) + 0.0 AS dc, round({GOERTZEL}, 6) + 0.0 AS ac FROM m GROUP BY vec_id",
)
def extract_hard_limits(spark, d):
    x = signal.extract(lanes(spark, d), signal.Analysis(), 5, 60, periods=3)
    return x.select("vec_id", F.size("signal").cast("long").alias("n"), r("dc").alias("dc"), r("ac").alias("ac"))


# Labels stand for measurements here, each with a rate of its own, and with limits from shares of its length.
BY_MEASUREMENT = f"""lanes_at AS (SELECT *, 10.0 + label AS fps FROM lane), mean AS (SELECT label, any_value(fps) AS fps, t, avg(v) AS m FROM lanes_at GROUP BY label, t),
sized AS (SELECT *, max(t) OVER (PARTITION BY label) + 1 AS n FROM mean),
st AS (SELECT *, lead(m) OVER (PARTITION BY label ORDER BY t) - m AS d, stddev_pop(m) OVER (PARTITION BY label) AS sd FROM sized),
each AS (SELECT label, any_value(fps) AS fps, any_value(n) AS n, CAST(least(floor(0.05 * any_value(n)), any_value(n) - 1) AS BIGINT) AS a, CAST(least(floor(0.95 * any_value(n) - 1), any_value(n) - 1) AS BIGINT) AS b FROM sized GROUP BY label),
points AS (SELECT label, CAST(t AS BIGINT) AS pt, 1 AS found FROM st WHERE abs(d) > 2 * sd UNION ALL SELECT label, a, 0 FROM each UNION ALL SELECT label, b, 0 FROM each),
gaps AS (SELECT label, pt AS hi, lag(pt) OVER w AS lo, row_number() OVER w AS k, sum(found) OVER (PARTITION BY label) AS outliers FROM points WINDOW w AS (PARTITION BY label ORDER BY pt)),
best AS (SELECT * FROM gaps WHERE lo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY hi - lo DESC, k DESC) = 1),
l AS (SELECT label, fps, n, CASE WHEN outliers = 0 THEN a ELSE lo + 1 END AS first, CASE WHEN outliers = 0 THEN least(b, n - 1) ELSE hi - 1 END AS last FROM best JOIN each USING (label)),
limits AS (SELECT *, CAST(floor((last - first + 1) * ({F0} / fps)) AS BIGINT) AS periods FROM l),
p AS (SELECT *, coalesce((SELECT max(k) FROM range(0, 200) q(k) WHERE k <= periods AND floor(k / {F0} * fps + 0.5) + first <= last), 0) AS p FROM limits),
raw AS (SELECT label, fps, n, first, CAST(least(n - 1, CASE WHEN periods < 1 THEN greatest(last, n - 1) ELSE first + least(floor(p / {F0} * fps + 0.5), n - 1 - first) END) AS BIGINT) AS last FROM p),
trimmed AS (SELECT label, fps, CAST(n AS BIGINT) AS n, CASE WHEN first >= last THEN 0 ELSE first END AS first, CASE WHEN first >= last THEN n - 1 ELSE last END AS last FROM raw)"""


def _measurements(spark, d) -> tuple[DataFrame, signal.Analysis]:
    return lanes(spark, d).withColumn("fps", F.lit(10.0) + F.col("label")), signal.Analysis(fps="fps")


@query("limits_by_measurement", f"WITH {LANES_SQL}, {BY_MEASUREMENT} SELECT label, n, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM trimmed")
def limits_by_measurement(spark, d):
    return signal.limits(*_measurements(spark, d), keys=["label"], fractions=(0.05, 0.95))


@query("mean_by_measurement", f"WITH {LANES_SQL} SELECT label, t, round(avg(v), 6) + 0.0 AS m FROM lane GROUP BY label, t")
def mean_by_measurement(spark, d):
    return signal.mean_signal(lanes(spark, d), keys=["label"]).select("label", *whole("t"), r("m").alias("m"))


@query(
    "extract_by_measurement",
    f"WITH {LANES_SQL}, {BY_MEASUREMENT}, cut AS (SELECT vec_id, fps, t - first AS t, v, last - first + 1 AS n FROM lane JOIN trimmed USING (label) WHERE t BETWEEN first AND last), m AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS dc FROM cut) "
    f"SELECT vec_id, max(n) AS n, round(max(dc), 6) + 0.0 AS dc, round({GOERTZEL.replace(str(FPS), 'fps')}, 6) + 0.0 AS ac FROM m GROUP BY vec_id",
)
def extract_by_measurement(spark, d):
    x = signal.extract(*_measurements(spark, d), keys=["label"], fractions=(0.05, 0.95))
    return x.select("vec_id", F.size("signal").cast("long").alias("n"), r("dc").alias("dc"), r("ac").alias("ac"))


@query("nearest_sample", f"WITH {SAMPLES_SQL} SELECT lane, arg_min(i, abs(minute - 20000.0) * 1e6 + i * 1e-6) AS i FROM samples GROUP BY lane")
def nearest_sample(spark, d):
    return signal.nearest_sample(samples(spark, d), "lane", 20000.0, "minute").select("lane", *whole("i"))


@query("region_limits", f"WITH {LANES_SQL}, {MEAN} SELECT (SELECT t FROM mean ORDER BY abs(t / {FPS} - 0.71), t LIMIT 1) + 2 AS first, (SELECT t FROM mean ORDER BY abs(t / {FPS} - 2.5), t LIMIT 1) + 3 AS last")
def region_limits(spark, d):
    return signal.region_limits(signal.mean_signal(lanes(spark, d)), 0.71, 2.5, FPS, 2)


@query("viewer_slice", f"WITH {LANES_SQL} SELECT vec_id, t, round(v, 6) + 0.0 AS v FROM lane WHERE t BETWEEN 10 AND 12")
def viewer_slice(spark, d):
    return signal.view(lanes(spark, d), 10, 12).select("vec_id", *whole("t"), r("v").alias("v"))


@query("point_read", f"WITH {LANES_SQL} SELECT round(v, 6) + 0.0 AS v FROM lane WHERE y = 3 AND x = 4 AND t = 17")
def point_read(spark, d):
    return signal.read_point(lanes(spark, d), 17, 3, 4).select(r("v").alias("v"))


# ---- names, folders, measurements

NAMES_SQL = """named AS (SELECT o_orderkey AS seq, 'exp_x' || (o_orderkey % 7) || '_' || (10 + o_orderkey % 15) || CASE WHEN o_orderkey % 3 = 0 THEN 'fps' ELSE 'v' || CASE WHEN o_orderkey % 3 = 1 THEN lpad('' || (o_orderkey % 100), 2, '0') ELSE '' || (o_orderkey % 10) END || 'fps' END || '_' ||
 CASE WHEN (o_orderkey // 60) % 12 < 9 THEN '' || ((o_orderkey // 60) % 12 + 1) ELSE '' || ((o_orderkey // 60) % 12 + 1) END || lpad('' || (o_orderkey % 60), 2, '0') || lpad('' || (o_orderkey % 59), 2, '0') ||
 CASE WHEN o_orderkey % 2 = 0 THEN ' AM' ELSE ' PM' END AS name FROM orders)"""


def named(spark, d):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    hour = F.expr("(o_orderkey div 60) % 12 + 1")
    rate = F.when(k % 3 == 0, F.lit("fps")).otherwise(F.concat(F.lit("v"), F.when(k % 3 == 1, F.lpad(text(k % 100), 2, "0")).otherwise(text(k % 10)), F.lit("fps")))
    half = F.when(k % 2 == 0, " AM").otherwise(" PM")
    name = F.concat(F.lit("exp_x"), text(k % 7), F.lit("_"), text(10 + k % 15), rate, F.lit("_"), text(hour), F.lpad(text(k % 60), 2, "0"), F.lpad(text(k % 59), 2, "0"), half)
    return table(spark, d, "orders").select(k.alias("seq"), name.alias("name"))


DIGITS = "clock AS (SELECT *, split_part(split_part(name, '_', -1), ' ', 1) AS dg, split_part(split_part(name, '_', -1), ' ', 2) AS half FROM named)"
LEGACY = "CASE WHEN half = 'PM' AND length(dg) = 5 THEN 60.0 * (CAST(dg[1:1] AS DOUBLE) + 12) + CAST(dg[2:3] AS DOUBLE) + CAST(dg[4:5] AS DOUBLE) / 60 ELSE 60.0 * CAST(dg[1:2] AS DOUBLE) + CAST(dg[3:4] AS DOUBLE) + CAST(dg[5:6] AS DOUBLE) / 60 END"
CLOCK12 = "60.0 * (CAST(lpad(dg, 6, '0')[1:2] AS DOUBLE) % 12 + CASE WHEN half = 'PM' THEN 12 ELSE 0 END) + CAST(lpad(dg, 6, '0')[3:4] AS DOUBLE) + CAST(lpad(dg, 6, '0')[5:6] AS DOUBLE) / 60"


FPS_SQL = "WITH {} SELECT seq, round(CASE WHEN contains(p, 'v') THEN CAST(split_part(p, 'v', 1) AS DOUBLE) + CAST(split_part(p, 'v', 2) AS DOUBLE) / {} ELSE CAST(p AS DOUBLE) END, 6) AS fps FROM (SELECT seq, replace(split_part(name, '_', 3), 'fps', '') AS p FROM named)"


@query("parse_fps_tenths", FPS_SQL.format(NAMES_SQL, "10"))
def parse_fps_tenths(spark, d):
    return named(spark, d).select("seq", r(names.fps_tenths(F.col("name"))).alias("fps"))


@query("parse_fps", FPS_SQL.format(NAMES_SQL, "pow(10, length(split_part(p, 'v', 2)))"))
def parse_fps(spark, d):
    return named(spark, d).select("seq", r(names.fps(F.col("name"))).alias("fps"))


@query("parse_time_legacy", f"WITH {NAMES_SQL}, {DIGITS} SELECT seq, round({LEGACY}, 6) AS minutes FROM clock")
def parse_time_legacy(spark, d):
    return named(spark, d).select("seq", r(names.minutes_legacy(F.col("name"))).alias("minutes"))


@query("parse_time_12h", f"WITH {NAMES_SQL}, {DIGITS} SELECT seq, round({CLOCK12}, 6) AS minutes FROM clock")
def parse_time_12h(spark, d):
    return named(spark, d).select("seq", r(names.minutes_12h(F.col("name"))).alias("minutes"))


@query(
    "parse_time_day_folder",
    f"WITH {NAMES_SQL}, {DIGITS} SELECT seq, CAST(CASE WHEN half = 'AM' THEN 60 * CAST(dg[1:2] AS INTEGER) + CAST(dg[3:4] AS INTEGER) WHEN length(dg) = 5 THEN 60 * CAST(dg[1:1] AS INTEGER) + CAST(dg[2:3] AS INTEGER) + 720 ELSE CAST(dg[2:3] AS INTEGER) + 720 END AS BIGINT) AS minutes FROM clock",
)
def parse_time_day_folder(spark, d):
    return named(spark, d).select("seq", names.minutes_day_folder(F.col("name")).cast("long").alias("minutes"))


@query("stride_select", f"WITH {NAMES_SQL}, {DIGITS}, m AS (SELECT name, {CLOCK12} AS minutes FROM clock), z AS (SELECT name, minutes - min(minutes) OVER () AS minutes FROM m), p AS (SELECT *, row_number() OVER (ORDER BY minutes, name) - 1 AS place FROM z WHERE contains(name, '_x3_')) SELECT name, round(minutes, 6) AS minutes, place FROM p WHERE place >= 2 AND (place - 2) % 5 = 0")
def stride_select(spark, d):
    x = folders.day_folders(named(spark, d).select("name"), names.minutes_12h(F.col("name")), 2, 5, "_x3_")
    return x.select("name", r("minutes").alias("minutes"), *whole("place"))


FILES_SQL = "files AS (SELECT 'f' || (o_custkey % 100) AS folder, 'img' || lpad('' || o_orderkey, 6, '0') || CASE o_orderpriority WHEN '1-URGENT' THEN '.png' WHEN '2-HIGH' THEN '.tif' WHEN '3-MEDIUM' THEN '.tif' WHEN '5-LOW' THEN '.jpg' ELSE '.txt' END AS file FROM orders)"


@query(
    "majority_format",
    f"WITH {FILES_SQL}, k AS (SELECT folder, file, split_part(file, '.', 2) AS format FROM files), n AS (SELECT folder, format, count(*) AS n FROM k WHERE format IN ('png', 'tif', 'jpg') GROUP BY ALL), b AS (SELECT folder, format, row_number() OVER (PARTITION BY folder ORDER BY n DESC, list_position(['png', 'tif', 'jpg'], format)) AS rn FROM n) SELECT k.folder, k.file, k.format FROM k JOIN b ON k.folder = b.folder AND k.format = b.format AND rn = 1",
)
def majority_format(spark, d):
    kind = F.col("o_orderpriority")
    ext = F.when(kind == "1-URGENT", ".png").when(kind.isin("2-HIGH", "3-MEDIUM"), ".tif").when(kind == "5-LOW", ".jpg").otherwise(".txt")
    files = table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 100).cast("string")).alias("folder"), F.concat(F.lit("img"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), ext).alias("file"))
    return images.majority_format(files)


@query("fraction_limits", "SELECT o_orderkey AS seq, CAST(least(floor(0.25 * n), n - 1) AS BIGINT) AS first, CAST(least(floor(0.9 * n - 1), n - 1) AS BIGINT) AS last FROM (SELECT o_orderkey, 1 + o_custkey % 500 AS n FROM orders)")
def fraction_limits(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), names.fraction_limits(F.lit(0.25), F.lit(0.9), 1 + F.col("o_custkey") % 500).alias("l"))
    return x.select("seq", "l.first", "l.last")


# Days of spools, most with one file of each kind, some days with spools of two sizes or without one.
SPOOLS_SQL = """days AS (SELECT o_custkey % 50 AS day, 's' || o_orderkey AS spool, o_orderkey AS k FROM orders),
have AS (SELECT day, spool, CASE WHEN k % 97 = 0 THEN 2 ELSE 1 END AS n_ini, CASE WHEN k % 89 = 0 THEN 0 ELSE 1 END AS n_sifx, CASE WHEN k % 101 = 0 THEN NULL WHEN day % 3 = 0 THEN 512 + k % 2 ELSE 512 END AS h, 640 AS w FROM days),
sized AS (SELECT *, n_ini = 1 AND n_sifx = 1 AS whole FROM have), ends AS (SELECT *, min(h) FILTER (WHERE whole) OVER (PARTITION BY day) AS a, max(h) FILTER (WHERE whole) OVER (PARTITION BY day) AS b FROM sized)"""


@query("spool_folders", f"WITH {SPOOLS_SQL} SELECT CAST(day AS BIGINT) AS day, spool, CAST(n_ini AS BIGINT) AS n_ini, CAST(n_sifx AS BIGINT) AS n_sifx, CAST(h AS BIGINT) AS h, CASE WHEN NOT whole THEN 'files' WHEN h IS NULL THEN 'no size' WHEN a <> b THEN 'sizes' END AS reason FROM ends")
def spool_folders(spark, d):
    k = F.col("o_orderkey")
    spool = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("day"), F.concat(F.lit("s"), k.cast("string")).alias("spool"), k.alias("k"))
    k = F.col("k")
    named_ = F.array_compact(F.array(F.lit("a.ini"), F.when(k % 97 == 0, "b.ini"), F.when(k % 89 != 0, "a.sifx"), F.lit("1.dat"), F.lit("2.dat")))
    size = F.when(k % 101 == 0, None).when(F.col("day") % 3 == 0, 512 + k % 2).otherwise(512)
    x = spools.checked(spool.select("day", "spool", F.explode(named_).alias("file")), spool.select("day", "spool", size.alias("h"), F.lit(640).alias("w")), ("day",))
    return x.select(*whole("day"), "spool", *whole("n_ini", "n_sifx", "h"), "reason")


@query("shape_check", "SELECT o_custkey AS folder, count(DISTINCT o_orderpriority || o_orderstatus) AS n_shapes, count(DISTINCT o_orderpriority || o_orderstatus) = 1 AS uniform FROM orders GROUP BY 1")
def shape_check(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderpriority").alias("h"), F.col("o_orderstatus").alias("w"))
    return images.shape_check(x, "folder")


@query("session_times", "SELECT row_number() OVER (ORDER BY time) - 1 AS frame, time FROM (SELECT DISTINCT CAST(unnest([o_orderkey % 97, o_custkey % 113]) AS DOUBLE) / 4 AS time FROM orders WHERE o_orderkey % 3 = 0)")
def session_times(spark, d):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "times").otherwise("area")
    q = lambda c, n: (F.col(c) % n / 4.0).cast("string")
    lines = table(spark, d, "orders").select(F.concat_ws(",", kind, q("o_orderkey", 97), q("o_custkey", 113)).alias("value"))
    return folders.session_times(lines).select("frame", "time")


@query(
    "abs_time_order",
    f"WITH {NAMES_SQL}, {DIGITS}, m AS (SELECT name, seq, {CLOCK12} AS t FROM clock) SELECT name, seq, row_number() OVER (ORDER BY t, seq) - 1 AS frame, CAST(floor(t / 60) AS BIGINT) AS hour, CAST(floor(t % 60) AS BIGINT) AS minute, round(t, 6) AS abstime FROM m",
)
def abs_time_order(spark, d):
    x = folders.measurements(named(spark, d))
    return x.select("name", "seq", "frame", *whole("hour", "minute"), r("abstime").alias("abstime"))


@query(
    "add_measurements",
    f"WITH {NAMES_SQL}, {DIGITS}, m AS (SELECT name, seq, {CLOCK12} AS t FROM clock) SELECT seq, row_number() OVER (ORDER BY t, seq) - 1 AS frame FROM m",
)
def add_measurements(spark, d):
    x = named(spark, d)
    return folders.add(folders.measurements(x.filter("seq % 2 = 0")), folders.measurements(x.filter("seq % 2 = 1"))).select("seq", "frame")


@query("relative_time", f"WITH {NAMES_SQL}, {DIGITS}, m AS (SELECT seq, {CLOCK12} AS t FROM clock) SELECT seq, round(t - min(t) OVER (), 6) AS time, CAST(trunc(t - min(t) OVER ()) AS BIGINT) AS whole_time FROM m")
def relative_time(spark, d):
    x = series.relative_times(folders.measurements(named(spark, d)))
    return x.select("seq", r("time").alias("time"), F.col("time").cast("long").alias("whole_time"))


@query("delete_frame", f"WITH {PIXELS_SQL} SELECT CAST(CASE WHEN frame > 2 THEN frame - 1 ELSE frame END AS BIGINT) AS frame, count(*) AS n FROM pixels WHERE frame <> 2 GROUP BY 1")
def delete_frame(spark, d):
    return folders.drop_frame(pixels(spark, d), 2).groupBy("frame").agg(F.count("*").alias("n")).select(*whole("frame"), "n")


# ---- labels

RELABEL = "SELECT CAST(frame AS BIGINT) AS frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(CASE WHEN label = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY frame ORDER BY CASE WHEN label = 0 THEN -1 ELSE label END) - max(CASE WHEN label = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY frame) END AS BIGINT) AS label FROM {}"
YXL = ["frame", "y", "x", "label"]


@query("relabel_contiguous", f"WITH {PIXELS_SQL}, e AS (SELECT * REPLACE (CASE WHEN label IN (2, 5) THEN 0 ELSE label END AS label) FROM pixels) {RELABEL.format('e')}")
def relabel_contiguous(spark, d):
    x = pixels(spark, d).withColumn("label", F.when(F.col("label").isin(2, 5), F.lit(0).cast("long")).otherwise(F.col("label")))
    return labels.relabel(x).select(*whole(*YXL))


PICKED = "(SELECT max(label) FROM pixels WHERE frame = 1 AND y = 7 AND x = 9)"


@query("delete_label", f"WITH {PIXELS_SQL}, e AS (SELECT * REPLACE (CASE WHEN frame = 1 AND label = {PICKED} THEN 0 ELSE label END AS label) FROM pixels) {RELABEL.format('e')}")
def delete_label(spark, d):
    return labels.change(pixels(spark, d), 1, 7, 9, 0).select(*whole(*YXL))


@query("change_label", f"WITH {PIXELS_SQL}, e AS (SELECT * REPLACE (CASE WHEN frame = 1 AND label <> 0 AND label = {PICKED} THEN 12 ELSE label END AS label) FROM pixels) {RELABEL.format('e')}")
def change_label(spark, d):
    return labels.change(pixels(spark, d), 1, 7, 9, 12).select(*whole(*YXL))


@query("paint", f"WITH {PIXELS_SQL} SELECT CAST(frame AS BIGINT) AS frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(CASE WHEN frame = 3 AND y BETWEEN 8 AND 14 AND x BETWEEN 17 AND 23 THEN 10 ELSE label END AS BIGINT) AS label FROM pixels")
def paint(spark, d):
    return labels.paint(pixels(spark, d), labels.square(spark, 3, 11, 20, 3, 10)).select(*whole(*YXL))


# Orders stand for edits: three of four paint a pixel, the others delete a label of a frame.
EDITS_SQL = """ed AS (SELECT o_orderkey AS seq, o_custkey % 7 AS frame, o_orderkey % 4 = 0 AS deletes, o_orderkey // 4 % 20 AS y, o_custkey % 20 AS x, o_orderkey % 12 AS v FROM orders),
painted AS (SELECT frame, y, x, arg_max(v, seq) AS v, max(seq) AS seq FROM ed WHERE NOT deletes GROUP BY ALL), gone AS (SELECT frame, v AS label, max(seq) AS seq FROM ed WHERE deletes GROUP BY ALL)"""


@query(
    "journal_masks",
    f"WITH {PIXELS_SQL}, {EDITS_SQL}, n AS (SELECT p.frame, p.y, p.x, coalesce(e.v, p.label) AS label, coalesce(e.seq, -1) AS seq FROM pixels p LEFT JOIN painted e USING (frame, y, x)) "
    "SELECT CAST(n.frame AS BIGINT) AS frame, CAST(n.y AS BIGINT) AS y, CAST(n.x AS BIGINT) AS x, CAST(CASE WHEN g.seq > n.seq THEN 0 ELSE n.label END AS BIGINT) AS label FROM n LEFT JOIN gone g ON g.frame = n.frame AND g.label = n.label",
)
def journal_masks(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    deletes, value = k % 4 == 0, (k % 12).cast("long")
    edits = table(spark, d, "orders").select(
        k.alias("seq"), F.when(deletes, "change").otherwise("paint").alias("kind"), (c % 7).alias("frame"), F.when(deletes, value).alias("label"), F.expr("o_orderkey div 4 % 20").alias("y"), (c % 20).alias("x"), F.when(deletes, 0).otherwise(value).alias("value")
    )
    return journal.replay_pixels(pixels(spark, d), edits).select(*whole(*YXL))


@query("empty_frames", f"WITH {PIXELS_SQL} SELECT CAST(frame AS BIGINT) AS frame FROM pixels GROUP BY frame HAVING count(*) FILTER (WHERE label <> 0 AND frame % 3 <> 1) = 0")
def empty_frames(spark, d):
    """Every third frame has lost its labels."""
    p = pixels(spark, d)
    return tracking.empty_frames(p.withColumn("label", F.when(F.col("frame") % 3 == 1, 0).otherwise(F.col("label")))).select(*whole("frame"))


@query("label_count", f"WITH {PIXELS_SQL} SELECT CAST(frame AS BIGINT) AS frame, count(DISTINCT label) AS n_labels FROM pixels GROUP BY 1")
def label_count(spark, d):
    return labels.count_labels(pixels(spark, d)).select(*whole("frame"), "n_labels")


@query("pick_label", f"WITH {PIXELS_SQL} SELECT CAST(label AS BIGINT) AS label FROM pixels WHERE frame = 1 AND y = 7 AND x = 9")
def pick_label(spark, d):
    return labels.pick(pixels(spark, d), 1, 7, 9).select(*whole("label"))


CELLS_SQL = """shape AS (SELECT frame, label, avg(y) AS com_y, avg(x) AS com_x, count(*) AS area, round(var_pop(y), 9) AS vy, round(var_pop(x), 9) AS vx, round(covar_pop(y, x), 9) AS vxy FROM pixels WHERE label <> 0 GROUP BY 1, 2),
axes AS (SELECT *, round(0.5 * degrees(atan2(2 * vxy, vx - vy)), 5) AS turn, (vy + vx) / 2 AS mid, sqrt(pow((vy - vx) / 2, 2) + pow(vxy, 2)) AS gap FROM shape),
cells AS (SELECT frame, label, com_y, com_x, area, CASE WHEN turn < 0 THEN turn + 180 ELSE turn END AS angle, CASE WHEN round(4 * sqrt(greatest(mid - gap, 0)), 5) = 0 THEN 0 ELSE round(4 * sqrt(mid + gap), 5) / round(4 * sqrt(greatest(mid - gap, 0)), 5) END AS ar FROM axes)"""


@query("label_area_com", f"WITH {PIXELS_SQL}, {CELLS_SQL} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, round(com_y, 6) AS com_y, round(com_x, 6) AS com_x, area FROM cells")
def label_area_com(spark, d):
    return labels.shape_stats(pixels(spark, d)).select(*whole("frame", "label"), r("com_y").alias("com_y"), r("com_x").alias("com_x"), "area")


def _stats_sql(v: str, digits: int) -> str:
    return f"WITH {PIXELS_SQL} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, round(avg({v}) + {nudge(digits)!r}, {digits}) AS {v}_mean, round(min({v}), {digits}) AS {v}_min, round(max({v}), {digits}) AS {v}_max FROM pixels WHERE label <> 0 GROUP BY 1, 2"


def _stats(spark, d, v: str, digits: int):
    return labels.intensity_stats(pixels(spark, d), v).select(*whole("frame", "label"), r(F.col(f"{v}_mean") + nudge(digits), digits).alias(f"{v}_mean"), *[r(c, digits).alias(c) for c in (f"{v}_min", f"{v}_max")])


@query("label_dc_stats", _stats_sql("dc", 4))
def label_dc_stats(spark, d):
    return _stats(spark, d, "dc", 4)


@query("label_ac_stats", _stats_sql("ac", 6))
def label_ac_stats(spark, d):
    return _stats(spark, d, "ac", 6)


@query("background_mean", f"WITH {PIXELS_SQL} SELECT CAST(frame AS BIGINT) AS frame, round(avg(CASE WHEN label = 0 THEN ac END), 6) AS background FROM pixels GROUP BY 1")
def background_mean(spark, d):
    return labels.background(pixels(spark, d)).select(*whole("frame"), r("background").alias("background"))


MOMENTS = "mom AS (SELECT frame, label, round(var_pop(y), 9) AS vy, round(var_pop(x), 9) AS vx, round(covar_pop(y, x), 9) AS vxy FROM pixels WHERE label <> 0 GROUP BY 1, 2), ell AS (SELECT frame, label, (vy + vx) / 2 AS mid, sqrt(pow((vy - vx) / 2, 2) + pow(vxy, 2)) AS gap, 0.5 * degrees(atan2(2 * vxy, vx - vy)) AS angle FROM mom)"


@query("moment_ellipse", f"WITH {PIXELS_SQL}, {MOMENTS} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, round(4 * sqrt(mid + gap), 5) AS major, round(4 * sqrt(greatest(mid - gap, 0)), 5) AS minor, round(angle, 5) + 0.0 AS angle FROM ell")
def moment_ellipse(spark, d):
    return labels.moment_ellipse(pixels(spark, d)).select(*whole("frame", "label"), r("major", 5).alias("major"), r("minor", 5).alias("minor"), r("angle", 5).alias("angle"))


#: ac is rounded first: a value that lies on a bin's edge would else fall to either side by its last bit.
OTSU = """ends AS (SELECT frame, label, min(ac) AS lo, max(ac) AS hi FROM pix WHERE label <> 0 GROUP BY 1, 2 HAVING max(ac) > min(ac)),
binned AS (SELECT p.*, CAST(floor((ac - lo) / (hi - lo) * 255) AS INTEGER) AS bin FROM pix p JOIN ends USING (frame, label)),
hist AS (SELECT frame, label, bin, CAST(count(*) AS DOUBLE) AS n FROM binned GROUP BY 1, 2, 3),
cum AS (SELECT *, sum(n) OVER u AS w0, sum(n * bin) OVER u AS s0, sum(n) OVER w AS w, sum(n * bin) OVER w AS s FROM hist WINDOW u AS (PARTITION BY frame, label ORDER BY bin), w AS (PARTITION BY frame, label)),
var AS (SELECT frame, label, bin, round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) AS between_ FROM cum WHERE w > w0),
otsu AS (SELECT frame, label, bin AS threshold FROM var QUALIFY row_number() OVER (PARTITION BY frame, label ORDER BY between_ DESC, bin) = 1)"""
PIX = "pix AS (SELECT * REPLACE (round(ac, 8) AS ac) FROM pixels)"


def _rounded(spark, d):
    return pixels(spark, d).withColumn("ac", F.round("ac", 8))


@query("otsu_threshold", f"WITH {PIXELS_SQL}, {PIX}, {OTSU} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, CAST(threshold AS BIGINT) AS threshold FROM otsu")
def otsu_threshold(spark, d):
    return labels.otsu(labels.bins(_rounded(spark, d))).select(*whole("frame", "label", "threshold"))


def _interior_sql(source: str, also: str = "true") -> str:
    return f"""WITH {source}, {PIX}, {OTSU}, ins AS (SELECT b.frame, b.label, b.y, b.x FROM binned b JOIN otsu USING (frame, label) WHERE bin >= threshold AND {also}),
p AS (SELECT a.*, i.y IS NOT NULL AS inside FROM pix a LEFT JOIN ins i USING (frame, label, y, x) WHERE label <> 0),
g AS (SELECT frame, label, count(*) AS area, avg(dc) AS dcm, count(*) FILTER (WHERE inside) AS ia, avg(ac) FILTER (WHERE inside) AS im, coalesce(avg(ac) FILTER (WHERE NOT inside), 0) AS cm FROM p GROUP BY 1, 2),
b AS (SELECT frame, avg(ac) FILTER (WHERE label = 0) AS bg FROM pix GROUP BY 1)
SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, ia AS interior_area, round(coalesce(im, 0) + {nudge(6)!r}, 6) AS interior_mean, round(cm + {nudge(6)!r}, 6) AS contour_mean,
round(CASE WHEN im + bg <> 0 THEN (im - bg) / (im + bg) ELSE 0 END + {nudge(6)!r}, 6) + 0.0 AS back_contrast, round(CASE WHEN im + cm <> 0 THEN (im - cm) / (im + cm) ELSE 0 END + {nudge(6)!r}, 6) + 0.0 AS contour_contrast,
round(CASE WHEN im IS NOT NULL AND dcm <> 0 THEN im / dcm ELSE 0 END, 12) AS ac_dc_ratio, round(ia / area + {nudge(6)!r}, 6) AS solidity FROM g JOIN b USING (frame)"""


def _interior(x: DataFrame) -> DataFrame:
    rest = [r(F.col(c) + nudge(6)).alias(c) for c in ("interior_mean", "contour_mean", "back_contrast", "contour_contrast")]
    return x.select(*whole("frame", "label"), "interior_area", *rest, r("ac_dc_ratio", 12).alias("ac_dc_ratio"), r(F.col("solidity") + nudge(6)).alias("solidity"))


@query("interior_contrast", _interior_sql(PIXELS_SQL))
def interior_contrast(spark, d):
    return _interior(labels.interior_features(_rounded(spark, d)))


# ---- tracking

OVERLAPS = "common AS (SELECT a.frame, a.label, b.label AS next_label, count(*) AS common FROM pixels a JOIN pixels b ON b.frame = a.frame + 1 AND b.y = a.y AND b.x = a.x WHERE a.label <> 0 AND b.label <> 0 GROUP BY 1, 2, 3)"
FWD = "fwd AS (SELECT frame, label, next_label, common / area AS frac FROM common JOIN cells USING (frame, label) WHERE area > 1)"
BACK = "back AS (SELECT c.frame + 1 AS frame, c.next_label AS label, c.label AS prev_label, c.common / k.area AS frac FROM common c JOIN cells k ON k.frame = c.frame + 1 AND k.label = c.next_label)"
CAST3 = "CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, CAST(next_label AS BIGINT) AS next_label"
ALL = f"WITH RECURSIVE {PIXELS_SQL}, {CELLS_SQL}, {OVERLAPS}, {FWD}, {BACK}"
DIST = "sqrt(pow(a.com_y - b.com_y, 2) + pow(a.com_x - b.com_x, 2))"
PAIRED = "FROM cells a JOIN cells b ON b.frame = a.frame + 1"
RATIO = "CASE WHEN a.{0} = 0 THEN 0 WHEN b.{0} / a.{0} > 1 THEN a.{0} / b.{0} ELSE b.{0} / a.{0} END"
SCORED = f"""scored AS (SELECT f.frame, f.label, f.next_label, f.frac, (f.frac + least(1, 2 * f.frac) + turn + ra + least(1, 2 * ra) + rr + least(1, 2 * rr) + least(1, 1 / CASE WHEN dist = 0 THEN 1e-4 ELSE dist END)) / 8 AS score
FROM fwd f JOIN (SELECT a.frame, a.label, b.label AS next_label, {DIST} AS dist, {RATIO.format("angle")} AS turn, {RATIO.format("area")} AS ra, {RATIO.format("ar")} AS rr {PAIRED}) d USING (frame, label, next_label) WHERE f.frac > 0.10)"""
KEPT = "kept AS (SELECT * FROM scored WHERE score > 0.3)"
BEST = """best AS (SELECT frame, label, prev_label FROM back QUALIFY row_number() OVER (PARTITION BY frame, label ORDER BY frac DESC, prev_label) = 1),
edges AS (SELECT k.* FROM (SELECT *, count(*) OVER (PARTITION BY frame, next_label) AS parents FROM kept) k LEFT JOIN best b ON b.frame = k.frame + 1 AND b.label = k.next_label WHERE parents = 1 OR b.prev_label = k.label)"""
ROOTS = "tops AS (SELECT frame, label, 'Cell_' || (row_number() OVER (ORDER BY frame, label) - 1) AS track, row_number() OVER (ORDER BY frame, label) - 1 AS k FROM cells c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.frame + 1 = c.frame AND e.next_label = c.label))"
WALK = """steps AS (SELECT frame, label, next_label, row_number() OVER (PARTITION BY frame, label ORDER BY next_label) - 1 AS place, count(*) OVER (PARTITION BY frame, label) AS siblings FROM edges),
walk AS (SELECT track, frame, label, lpad('' || k, 9, '0') AS path FROM tops UNION ALL SELECT CASE WHEN siblings = 1 THEN w.track ELSE w.track || '_' || place END, w.frame + 1, s.next_label, w.path || '.' || lpad('' || place, 4, '0') FROM walk w JOIN steps s ON w.frame = s.frame AND w.label = s.label)"""
NET = f"{ALL}, {SCORED}, {KEPT}, {BEST}, {ROOTS}, {WALK}"


def _cells(spark, d):
    p = written(pixels(spark, d), "pixels")  # drawn once; what follows reads them several times
    return p, labels.tracked_shapes(p)


def _edges(spark, d):
    p, c = _cells(spark, d)
    c = written(c, "cells")
    return p, c, written(tracking.network(p, c, common=written(tracking.overlaps(p), "overlaps")), "links")


def _walk(spark, d):
    p, c, e = _edges(spark, d)
    return p, c, e, tracking.lineages(c, e)


@query("forward_overlap", f"{ALL} SELECT {CAST3}, round(frac, 6) AS frac FROM fwd")
def forward_overlap(spark, d):
    p, c = _cells(spark, d)
    return tracking.forward(tracking.overlaps(p), c).select(*whole("frame", "label", "next_label"), r("frac").alias("frac"))


@query("back_overlap", f"{ALL} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, CAST(prev_label AS BIGINT) AS prev_label, round(frac, 6) AS frac FROM back")
def back_overlap(spark, d):
    p, c = _cells(spark, d)
    return tracking.backward(tracking.overlaps(p), c).select(*whole("frame", "label", "prev_label"), r("frac").alias("frac"))


@query("inverse_distance", f"{ALL} SELECT CAST(a.frame AS BIGINT) AS frame, CAST(a.label AS BIGINT) AS label, CAST(b.label AS BIGINT) AS next_label, round({DIST}, 6) AS distance, round(least(1, 1 / CASE WHEN {DIST} = 0 THEN 1e-4 ELSE {DIST} END), 6) AS nearness {PAIRED}")
def inverse_distance(spark, d):
    _, c = _cells(spark, d)
    x = tracking.successive(tracking.frame_pairs(c), c)
    return x.select(*whole("frame", "label", "next_label"), r(tracking.distance()).alias("distance"), r(tracking.inverse_distance()).alias("nearness"))


@query("ratio_scores", f"{ALL} SELECT CAST(a.frame AS BIGINT) AS frame, CAST(a.label AS BIGINT) AS label, CAST(b.label AS BIGINT) AS next_label, " + ", ".join(f"round({RATIO.format(c)}, 6) AS {c}_ratio" for c in ("area", "angle", "ar")) + f" {PAIRED}")
def ratio_scores(spark, d):
    _, c = _cells(spark, d)
    x = tracking.successive(tracking.frame_pairs(c), c)
    return x.select(*whole("frame", "label", "next_label"), *[r(tracking.ratio_score(k)).alias(f"{k}_ratio") for k in ("area", "angle", "ar")])


@query("candidate_scores", f"{ALL}, {SCORED} SELECT {CAST3}, round(score, 6) AS score FROM scored")
def candidate_scores(spark, d):
    p, c = _cells(spark, d)
    return tracking.candidates(tracking.forward(tracking.overlaps(p), c), c).select(*whole("frame", "label", "next_label"), r("score").alias("score"))


@query("edges_thresholded", f"{ALL}, {SCORED}, {KEPT} SELECT {CAST3}, round(score, 6) AS score FROM kept")
def edges_thresholded(spark, d):
    p, c = _cells(spark, d)
    return tracking.threshold(tracking.candidates(tracking.forward(tracking.overlaps(p), c), c)).select(*whole("frame", "label", "next_label"), r("score").alias("score"))


@query("candidate_lists", f"{ALL}, {SCORED} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, string_agg('' || next_label, ',' ORDER BY round(score, 9), next_label) AS candidates FROM scored GROUP BY 1, 2")
def candidate_lists(spark, d):
    p, c = _cells(spark, d)
    x = tracking.candidates(tracking.forward(tracking.overlaps(p), c), c)
    best = F.array_sort(F.collect_list(F.struct(F.round("score", 9).alias("score"), F.col("next_label").cast("long").alias("next_label"))))
    return x.groupBy(*whole("frame", "label")).agg(F.array_join(F.transform(best, lambda s: s["next_label"].cast("string")), ",").alias("candidates"))


@query("best_parent_edges", f"{ALL}, {SCORED}, {KEPT}, {BEST} SELECT {CAST3}, round(score, 6) AS score FROM edges")
def best_parent_edges(spark, d):
    return _edges(spark, d)[2].select(*whole("frame", "label", "next_label"), r("score").alias("score"))


@query("roots", f"{ALL}, {SCORED}, {KEPT}, {BEST}, {ROOTS} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, track FROM tops")
def roots(spark, d):
    _, c, e = _edges(spark, d)
    return tracking.roots(c, e).select(*whole("frame", "label"), "track")


@query("lineages", f"{NET} SELECT track, CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label FROM walk")
def lineages(spark, d):
    return _walk(spark, d)[3].select("track", *whole("frame", "label"))


@query("virtual_coords", f"{NET} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, row_number() OVER (PARTITION BY frame ORDER BY path) AS row FROM walk")
def virtual_coords(spark, d):
    return tracking.virtual_rows(_walk(spark, d)[3]).select(*whole("frame", "label", "row"))


NODES = "nodes AS (SELECT row_number() OVER (ORDER BY frame, label) - 1 AS id, frame, label, row_number() OVER (PARTITION BY frame ORDER BY path) AS row, track FROM walk), arcs AS (SELECT a.id AS a, b.id AS b FROM edges e JOIN nodes a ON a.frame = e.frame AND a.label = e.label JOIN nodes b ON b.frame = e.frame + 1 AND b.label = e.next_label)"


@query("export_graph", f"{NET}, {NODES} SELECT a.id AS a, a.track AS a_track, b.id AS b, b.track AS b_track FROM arcs JOIN nodes a ON a.id = arcs.a JOIN nodes b ON b.id = arcs.b")
def export_graph(spark, d):
    _, c, e, w = _walk(spark, d)
    nodes, arcs = tracking.export_graph(c, e, w)
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("track").alias(f"{s}_track"))
    return arcs.join(side("a"), "a").join(side("b"), "b").select(*whole("a"), "a_track", *whole("b"), "b_track")


@query("graph_moves", f'{NET}, {NODES} SELECT id, (SELECT min(b) FROM arcs WHERE a = id) AS "right", (SELECT min(a) FROM arcs WHERE b = id) AS "left", lead(id) OVER (PARTITION BY frame ORDER BY row) AS above, lag(id) OVER (PARTITION BY frame ORDER BY row) AS below FROM nodes')
def graph_moves(spark, d):
    _, c, e, w = _walk(spark, d)
    return tracking.neighbours(*tracking.export_graph(c, e, w)).select(*whole("id", "right", "left", "above", "below"))


# A point beside every third node, and one far from all for every fifth.
CLICKS = "clicks AS (SELECT id AS click, frame + CASE WHEN id % 5 = 0 THEN -300.5 ELSE 0.3 END AS at_frame, row + (id % 7 - 3) * 0.125 AS at_row FROM nodes WHERE id % 3 = 0)"


@query("clicked_nodes", f"{NET}, {NODES}, {CLICKS}, near AS (SELECT c.click, n.id, n.frame, n.label FROM clicks c JOIN nodes n ON pow(n.frame - c.at_frame, 2) + pow(n.row - c.at_row, 2) <= 0.25 QUALIFY row_number() OVER (PARTITION BY c.click ORDER BY pow(n.frame - c.at_frame, 2) + pow(n.row - c.at_row, 2), n.id) = 1) SELECT c.click, n.id, CAST(n.frame AS BIGINT) AS frame, CAST(n.label AS BIGINT) AS label FROM clicks c LEFT JOIN near n USING (click)")
def clicked_nodes(spark, d):
    _, c, e, w = _walk(spark, d)
    nodes = tracking.export_graph(c, e, w)[0]
    i = F.col("id")
    clicks = nodes.filter(i % 3 == 0).select(i.alias("click"), (F.col("frame") + F.when(i % 5 == 0, -300.5).otherwise(0.3)).alias("at_frame"), (F.col("row") + (i % 7 - 3) * 0.125).alias("at_row"))
    return tracking.clicked(nodes, clicks).select(*whole("click", "id", "frame", "label"))


@query("filter_area", f"WITH {PIXELS_SQL}, {CELLS_SQL} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label FROM cells WHERE area < 100")
def filter_area(spark, d):
    return _cells(spark, d)[1].filter("area < 100").select(*whole("frame", "label"))


@query("filter_aspect", f"WITH {PIXELS_SQL}, {MOMENTS} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label FROM ell WHERE mid - gap > 0 AND sqrt((mid + gap) / (mid - gap)) < 1.1")
def filter_aspect(spark, d):
    return labels.moment_ellipse(pixels(spark, d)).filter((F.col("minor") > 0) & (F.col("major") / F.col("minor") < 1.1)).select(*whole("frame", "label"))


@query("filter_lineage", f"{NET} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label FROM walk WHERE contains(track, 'Cell_1') AND split_part(track, '_', 2) = '1'")
def filter_lineage(spark, d):
    return tracking.of_lineage(_walk(spark, d)[3], "Cell_1").select(*whole("frame", "label"))


@query("apply_filter", f"WITH {PIXELS_SQL}, {CELLS_SQL}, e AS (SELECT p.* REPLACE (CASE WHEN c.area < 100 THEN 0 ELSE p.label END AS label) FROM pixels p LEFT JOIN cells c USING (frame, label)) {RELABEL.format('e')}")
def apply_filter(spark, d):
    p, c = _cells(spark, d)
    return labels.relabel(tracking.remove(p, c.filter("area < 100"))).select(*whole(*YXL))


@query("delete_node", f"WITH {PIXELS_SQL} SELECT CAST(frame AS BIGINT) AS frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(CASE WHEN frame = 2 AND label = 3 THEN 0 WHEN frame = 2 AND label > 3 THEN label - 1 ELSE label END AS BIGINT) AS label FROM pixels")
def delete_node(spark, d):
    return tracking.delete_node(pixels(spark, d), 2, 3).select(*whole(*YXL))


@query(
    "edit_link_unlink",
    f"{ALL}, {SCORED}, {KEPT}, {BEST}, a AS (SELECT frame, label, frame + 1 AS next_frame, next_label FROM edges WHERE NOT (frame + 1 = 4 AND next_label = 2) UNION ALL SELECT 1, 3, 4, 2), b AS (SELECT * FROM a WHERE NOT (next_frame = 2 AND next_label = 5)) SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, CAST(next_frame AS BIGINT) AS next_frame, CAST(next_label AS BIGINT) AS next_label FROM b",
)
def edit_link_unlink(spark, d):
    e = _edges(spark, d)[2].select("frame", "label", "next_label")
    return tracking.unlink(tracking.link(e, (4, 2), (1, 3)), (2, 5), "l").select(*whole("frame", "label", "next_frame", "next_label"))


@query("unlink_children", f"{ALL}, {SCORED}, {KEPT}, {BEST} SELECT {CAST3} FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.frame = 2 AND o.label = 5 AND e.frame = 2 AND e.next_label = o.next_label)")
def unlink_children(spark, d):
    return tracking.unlink(_edges(spark, d)[2].select("frame", "label", "next_label"), (2, 5), "r").select(*whole("frame", "label", "next_label"))


EDITED = f"""WITH RECURSIVE {PIXELS_SQL.replace("pixels AS", "raw AS")}, small AS (SELECT frame, label FROM raw WHERE label <> 0 GROUP BY 1, 2 HAVING count(*) < 100),
e AS (SELECT r.* REPLACE (CASE WHEN s.label IS NOT NULL THEN 0 ELSE r.label END AS label) FROM raw r LEFT JOIN small s USING (frame, label)), pixels AS ({RELABEL.format("e")})"""


@query("relinked", f"{EDITED}, {CELLS_SQL}, {OVERLAPS}, {FWD}, {BACK}, {SCORED}, {KEPT}, {BEST}, {ROOTS}, {WALK} SELECT track, CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label FROM walk")
def relinked(spark, d):
    """Small cells are removed, labels made contiguous, and the network and its lineages made anew."""
    p, c = _cells(spark, d)
    p = labels.relabel(tracking.remove(p, c.filter("area < 100")))
    c = labels.tracked_shapes(p)
    return tracking.lineages(c, tracking.network(p, c)).select("track", *whole("frame", "label"))


# ---- series

FEATURES = "feat AS (SELECT frame, label, count(*) AS area, avg(dc) AS dc_mean, avg(ac) AS ac_mean FROM pixels WHERE label <> 0 AND NOT (frame = 1 AND label = 4) GROUP BY 1, 2)"


@query("relinked_frames", f"WITH RECURSIVE {PIXELS_SQL.replace('pixels AS', 'raw AS')}, pixels AS (SELECT * REPLACE (CASE WHEN frame IN (2, 5) AND label % 3 = 1 THEN 0 ELSE label END AS label) FROM raw), {CELLS_SQL}, {OVERLAPS}, {FWD}, {BACK}, {SCORED}, {KEPT}, {BEST} SELECT {CAST3}, round(score, 6) AS score FROM edges")
def relinked_frames(spark, d):
    """Two frames lose cells; their edges alone are made anew."""
    p, c, e = _edges(spark, d)
    gone = F.col("frame").isin(2, 5) & (F.col("label") % 3 == 1)
    edited = p.withColumn("label", F.when(gone, F.lit(0).cast("long")).otherwise(F.col("label")))
    return tracking.relinked(edited, c, e, [2, 5], labels.tracked_shapes)[1].select(*whole("frame", "label", "next_label"), r("score").alias("score"))


def _series(spark, d):
    p, c, e, w = _walk(spark, d)
    f = p.filter("label <> 0 AND NOT (frame = 1 AND label = 4)").groupBy("frame", "label").agg(F.count("*").alias("area"), F.avg("dc").alias("dc_mean"), F.avg("ac").alias("ac_mean"))
    return series.with_features(w.select("track", "frame", "label"), f)


@query("lineage_features", f"{NET}, {FEATURES} SELECT track, CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, area, round(dc_mean + {nudge(4)!r}, 4) AS dc_mean, round(ac_mean + {nudge(6)!r}, 6) AS ac_mean, area IS NULL AS missing FROM walk LEFT JOIN feat USING (frame, label)")
def lineage_features(spark, d):
    return _series(spark, d).select("track", *whole("frame", "label"), "area", r(F.col("dc_mean") + nudge(4), 4).alias("dc_mean"), r(F.col("ac_mean") + nudge(6)).alias("ac_mean"), "missing")


@query("cell_series", f"{NET}, {FEATURES} SELECT track, string_agg('' || frame, ',' ORDER BY frame) AS frames, string_agg('' || area, ',' ORDER BY frame) AS areas FROM walk JOIN feat USING (frame, label) GROUP BY track")
def cell_series(spark, d):
    x = series.collected(_series(spark, d).filter("not missing"), ["area"])
    return x.select("track", F.array_join(F.col("frame").cast("array<string>"), ",").alias("frames"), F.array_join(F.col("area").cast("array<string>"), ",").alias("areas"))


@query("export_rows", f"{NET}, {FEATURES}, g AS (SELECT track, string_agg('' || area || '.000000', ',' ORDER BY frame) AS areas FROM walk JOIN feat USING (frame, label) GROUP BY track) SELECT track, CAST(unnest([0, 1, 2]) AS BIGINT) AS row, unnest([track, 'area,' || areas, '']) AS line FROM g")
def export_rows(spark, d):
    return series.export_rows(_series(spark, d).filter("not missing"), ["area"]).select("track", *whole("row"), "line")


@query("feature_unpivot", f"{NET}, {FEATURES}, j AS (SELECT track, CAST(frame AS BIGINT) AS frame, CAST(area AS DOUBLE) AS area, ac_mean FROM walk JOIN feat USING (frame, label)) SELECT track, frame, 'area' AS feature, round(area, 6) AS value FROM j UNION ALL SELECT track, frame, 'ac_mean', round(ac_mean, 6) FROM j")
def feature_unpivot(spark, d):
    x = _series(spark, d).filter("not missing").withColumn("area", F.col("area").cast("double"))
    return series.unpivoted(x, ["area", "ac_mean"]).select("track", *whole("frame"), "feature", r("value").alias("value"))


@query("attributes", f"{NET}, {FEATURES}, j AS (SELECT * FROM walk LEFT JOIN feat USING (frame, label)) SELECT 'area' AS feature, count(area) AS n FROM j UNION ALL SELECT 'dc_mean', count(dc_mean) FROM j UNION ALL SELECT 'ac_mean', count(ac_mean) FROM j")
def attributes(spark, d):
    """The columns that can be plotted, each with how many values there are."""
    x = _series(spark, d).drop("missing")
    named_ = series.attributes(x)
    return series.unpivoted(x.select("track", "frame", *[F.col(c).cast("double").alias(c) for c in named_]), named_).groupBy("feature").agg(F.count("value").alias("n"))


@query("lineage_select", f"{NET} SELECT DISTINCT track, split_part(track, '_', 2) AS root FROM walk WHERE contains(track, 'Cell_1') OR contains(track, 'Cell_3_')")
def lineage_select(spark, d):
    x = _walk(spark, d)[3].filter(series.selects("track", ["Cell_1", "Cell_3_"]))
    return x.select("track", names.root_of(F.col("track")).alias("root")).distinct()


@query("track_series", f"{NET}, {FEATURES} SELECT CAST(frame AS BIGINT) AS frame, area FROM walk JOIN feat USING (frame, label) WHERE track = 'Cell_0'")
def track_series(spark, d):
    return _series(spark, d).filter("not missing AND track = 'Cell_0'").select(*whole("frame"), "area")


@query("time_range", f"WITH {SAMPLES_SQL} SELECT round(min(minute), 6) AS first_time, round(max(minute), 6) AS last_time FROM samples")
def time_range(spark, d):
    x = series.time_range(samples(spark, d).withColumn("time", F.col("minute")))
    return x.select(r("first_time").alias("first_time"), r("last_time").alias("last_time"))


NEAR = "near AS (SELECT lane, i, minute, value, abs(minute - 20000.0) AS off FROM samples WHERE minute BETWEEN 20000.0 - 60 AND 20000.0 + 60)"


@query("nearest_time_tolerance", f"WITH {SAMPLES_SQL}, {NEAR} SELECT lane, i, round(value, 6) AS value FROM near QUALIFY row_number() OVER (PARTITION BY lane ORDER BY off, i) = 1")
def nearest_time_tolerance(spark, d):
    x = series.at_time(samples(spark, d), "lane", 20000.0, "minute", "i", 60.0)
    return x.select("lane", *whole("i"), r("value").alias("value"))


@query(
    "nearest_time_join",
    f'WITH {SAMPLES_SQL}, q AS (SELECT DISTINCT lane, unnest([1000.0, 9000.5, 25000.25]) AS pt FROM samples), j AS (SELECT q.lane, q.pt, s.i, s.value, abs(s.minute - q.pt) AS off FROM q JOIN samples s ON s.lane = q.lane AND abs(s.minute - q.pt) <= 90) SELECT lane, CAST(pt AS DOUBLE) AS "at", i, round(value, 6) AS value FROM j QUALIFY row_number() OVER (PARTITION BY lane, pt ORDER BY off, i) = 1',
)
def nearest_time_join(spark, d):
    s = samples(spark, d)
    q = s.select("lane").distinct().select("lane", F.explode(F.array(*map(F.lit, (1000.0, 9000.5, 25000.25)))).alias("at"))
    x = series.nearest_times(q, s, "lane", "minute", "i", 90.0)
    return x.select("lane", "at", *whole("i"), r("value").alias("value"))


# ---- geometry and stabilisation, on rectangles and a moving scene, whose outlines, ellipses, interiors and shifts have closed forms

POINTS = "CASE WHEN h = 1 THEN 2 * (w - 1) ELSE 2 * (h + w) - 4 END"


@query("contours", f"WITH {BOXES_SQL} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, CAST({POINTS} AS BIGINT) AS n_points, CAST((h - 1) * (w - 1) AS DOUBLE) AS area, CAST({POINTS} + 1 AS BIGINT) AS n_closed, CAST(x0 AS BIGINT) AS x_first, CAST(y0 AS BIGINT) AS y_first, CAST(x0 + w - 1 AS BIGINT) AS x_last, CAST(y0 + h - 1 AS BIGINT) AS y_last FROM boxes")
def contours(spark, d):
    x = geometry.contours(tables.shapes(spark, d))
    ends = {"x_first": F.element_at("xs", 1), "y_first": F.element_at("ys", 1), "x_last": F.array_max("xs"), "y_last": F.array_max("ys")}
    return x.select(*whole("frame", "label", "n_points"), r("area").alias("area"), F.size("xs").cast("long").alias("n_closed"), *[c.cast("long").alias(n) for n, c in ends.items()])


#: The conic a u**2 + c v**2 = 1 of least error over a rectangle's border, centred: c / a is the root of the ratio of the two squares' own sums of squares about their means.
ELLIPSE_SQL = """rim AS (SELECT frame, label, i - (w - 1) / 2.0 AS u, j - (h - 1) / 2.0 AS v FROM spread WHERE h > 1 AND (i = 0 OR j = 0 OR i = w - 1 OR j = h - 1)),
sums AS (SELECT frame, label, count(*) AS n, sum(u * u) AS su, sum(v * v) AS sv, sqrt((sum(pow(u, 4)) - pow(sum(u * u), 2) / count(*)) / (sum(pow(v, 4)) - pow(sum(v * v), 2) / count(*))) AS q FROM rim GROUP BY 1, 2),
halves AS (SELECT frame, label, sqrt((su + q * sv) / n) AS across, sqrt((su / q + sv) / n) AS down FROM sums),
fitted AS (SELECT b.frame, b.label, CASE WHEN across IS NULL OR across - down > -1e-6 THEN 0.0 ELSE 90.0 END AS angle, coalesce(2 * greatest(across, down), 1) AS major, coalesce(2 * least(across, down), 1) AS minor FROM boxes b LEFT JOIN halves USING (frame, label))"""


@query("ellipse_fit", f"WITH {SHAPES_SQL}, {ELLIPSE_SQL} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, angle, round(major, 5) AS major, round(minor, 5) AS minor, round(major / minor, 5) AS ar FROM fitted")
def ellipse_fit(spark, d):
    x = geometry.ellipses(tables.shapes(spark, d))
    angle = F.when(F.col("major") - F.col("minor") < 1e-6, 0.0).otherwise(F.round("angle", 4) % 180)  # a circle has none
    return x.select("frame", "label", (angle + 0.0).alias("angle"), r("major", 5).alias("major"), r("minor", 5).alias("minor"), r("ar", 5).alias("ar"))


HULLS = "SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, round(CASE WHEN k % 4 = 0 AND h > 1 THEN (2 * (h + w) - 4) / (h * w) ELSE 1 END, 6) AS convexity FROM boxes"


@query("convexity", f"WITH {BOXES_SQL} {HULLS}")
def convexity(spark, d):
    return geometry.convexity(tables.shapes(spark, d, rings=True)).select("frame", "label", r("convexity").alias("convexity"))


@query("filter_convexity", f"WITH {BOXES_SQL}, c AS ({HULLS}) SELECT frame, label FROM c WHERE convexity < 0.8")
def filter_convexity(spark, d):
    return geometry.convexity(tables.shapes(spark, d, rings=True)).filter("convexity < 0.8").select("frame", "label")


#: The brighter right part of a rectangle is one part, of an outline within the band; a line has no outline of that area.
WIDE = "(b.frame, b.label) NOT IN (SELECT (frame, label) FROM boxes WHERE h = 1)"


@query("interior_regions", _interior_sql(SHAPES_SQL, WIDE))
def interior_regions(spark, d):
    p = tables.shapes(spark, d)
    return _interior(labels.interior_features(p, geometry.interiors(p)))


#: A cell's rim at 0, its inside at 5, a pixel at 10 beside two at 255, counted from the least: the threshold of 10 finds nothing large enough, and lower ones come down to the inside.
@query("interior_fallback", f"WITH {BOXES_SQL} SELECT CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, CAST((h - 2) * (w - 2) AS BIGINT) AS n FROM boxes WHERE h > 1")
def interior_fallback(spark, d):
    b = tables.boxes(spark, d)
    x = b.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    i, j = F.col("i"), F.col("j")
    rim = i.isin(0) | j.isin(0) | (i == F.col("w") - 1) | (j == F.col("h") - 1)
    level = F.when(rim, 1.0).when((j == 2) & i.isin(2, 3), 256.0).when((j == 2) & (i == 4), 11.0).otherwise(6.0)
    p = x.select("frame", (F.col("y0") + j).alias("y"), (F.col("x0") + i).alias("x"), "label", level.alias("ac"))
    return geometry.interiors(p).groupBy("frame", "label").agg(F.count("*").alias("n"))


ROUNDED = {"com_y": 6, "com_x": 6, "angle": 6, "major": 5, "minor": 5, "dc_mean": 6, "dc_min": 6, "dc_max": 6, "ac_mean": 6, "ac_min": 6, "ac_max": 6, "interior_mean": 6, "contour_mean": 6, "back_contrast": 6, "contour_contrast": 6, "ac_dc_ratio": 12, "solidity": 6}
NUDGED = ("interior_mean", "contour_mean", "back_contrast", "contour_contrast", "solidity")
#: The ellipse of measurement: axes of 0 for lines.
MEASURED = f"""{ELLIPSE_SQL}, stats AS (SELECT frame, label, avg(y) AS com_y, avg(x) AS com_x, count(*) AS area, avg(dc) AS dc_mean, min(dc) AS dc_min, max(dc) AS dc_max, avg(ac) AS ac_mean, min(ac) AS ac_min, max(ac) AS ac_max FROM pixels WHERE label <> 0 GROUP BY 1, 2),
core AS ({_interior_sql(SHAPES_SQL, WIDE)}),
features AS (SELECT b.frame, b.label, area, round(com_y, 6) AS com_y, round(com_x, 6) AS com_x, angle, round(CASE WHEN h = 1 THEN 0 ELSE major END, 5) AS major, round(CASE WHEN h = 1 THEN 0 ELSE minor END, 5) AS minor,
{", ".join(f"round({c}, 6) AS {c}" for c in ("dc_mean", "dc_min", "dc_max", "ac_mean", "ac_min", "ac_max"))}, interior_area, interior_mean, contour_mean, back_contrast, contour_contrast, ac_dc_ratio, solidity,
CAST({POINTS} + 1 AS BIGINT) AS n_total, CAST(CASE WHEN h > 1 THEN 1 ELSE 0 END AS BIGINT) AS n_interior FROM boxes b JOIN stats USING (frame, label) JOIN fitted USING (frame, label) JOIN core USING (frame, label))"""
COLUMNS = f"CAST(frame AS BIGINT) AS frame, CAST(label AS BIGINT) AS label, area, interior_area, {', '.join(ROUNDED)}"


def _features(x: DataFrame) -> DataFrame:
    return x.select(*[c for c in x.columns if c not in ROUNDED], *[r(F.col(c) + nudge(6) if c in NUDGED else F.col(c), n).alias(c) for c, n in ROUNDED.items()])


@query("cell_features", f"WITH {SHAPES_SQL}, {MEASURED} SELECT {COLUMNS}, n_total, n_interior FROM features")
def cell_features(spark, d):
    x = _features(measure.features(tables.shapes(spark, d), with_outlines=True))
    return x.withColumn("n_total", F.size("total").cast("long")).withColumn("n_interior", F.size("interior").cast("long")).drop("total", "interior")


@query(
    "measured_series",
    f"WITH RECURSIVE {SHAPES_SQL}, {MEASURED}, cells AS (SELECT s.frame, s.label, s.com_y, s.com_x, s.area, f.angle, f.major / f.minor AS ar FROM stats s JOIN fitted f USING (frame, label)), {OVERLAPS}, {FWD}, {BACK}, {SCORED}, {KEPT}, {BEST}, {ROOTS}, {WALK} "
    f"SELECT track, round(10.5 * (frame - (SELECT min(frame) FROM boxes)), 6) AS time, false AS missing, {COLUMNS} FROM walk JOIN features USING (frame, label)",
)
def measured_series(spark, d):
    p = tables.shapes(spark, d)
    times = p.select("frame").distinct().select("frame", (600.0 + 10.5 * F.col("frame")).alias("abstime"))
    x = _features(measure.measure(p, times))
    return x.withColumn("time", r("time"))


@query(
    "segment_default",
    f"WITH {BOXES_SQL} SELECT CAST(frame AS BIGINT) AS frame, row_number() OVER (PARTITION BY frame ORDER BY y0, x0) AS label, CAST(h * w AS BIGINT) AS n FROM boxes UNION ALL SELECT CAST(frame AS BIGINT), 0, CAST({tables.SIDE * tables.SIDE} - sum(h * w) AS BIGINT) FROM boxes GROUP BY frame",
)
def segment_default(spark, d):
    return geometry.segment(tables.images(spark, d)).groupBy("frame", "label").agg(F.count("*").alias("n"))


def _drift_sql(times: float) -> str:
    return f"WITH w AS (SELECT f, {times} * {tables.DRIFT['sx']} AS sx, {times} * {tables.DRIFT['sy']} AS sy FROM (SELECT DISTINCT s_suppkey // 10 AS f FROM supplier)) SELECT CAST(b.f AS BIGINT) AS frame, round(CAST(b.sx - a.sx AS DOUBLE), 1) + 0.0 AS dx, round(CAST(b.sy - a.sy AS DOUBLE), 1) + 0.0 AS dy FROM w a JOIN w b ON b.f = a.f + 1"


@query("stabilise_shift", _drift_sql(1.0))
def stabilise_shift(spark, d):
    return stabilise.shifts(tables.drifting(spark, d)).select("frame", r("dx", 1).alias("dx"), r("dy", 1).alias("dy"))


@query("stabilise_large_shift", _drift_sql(8.0))
def stabilise_large_shift(spark, d):
    """Steps of up to 16 of 48 pixels."""
    return stabilise.shifts(tables.drifting(spark, d, times=8.0)).select("frame", r("dx", 1).alias("dx"), r("dy", 1).alias("dy"))


WARPS = {"dx": "(frame * 5 % 7 - 3) * 0.613", "dy": "(frame * 3 % 5 - 2) * 0.829"}
SHIFTS_SQL = f"{PIXELS_SQL}, warps AS (SELECT frame, CAST({WARPS['dx']} AS DOUBLE) AS dx, CAST({WARPS['dy']} AS DOUBLE) AS dy FROM (SELECT DISTINCT frame FROM pixels WHERE frame > 0)), bk AS (SELECT CAST(frame AS BIGINT) AS frame, -sum(dx) OVER (ORDER BY frame) AS dx, -sum(dy) OVER (ORDER BY frame) AS dy FROM warps)"


def _back(p: DataFrame) -> DataFrame:
    """A shift for every frame of the table but the first, summed and undone."""
    frames = p.select(F.col("frame").cast("long").alias("frame")).distinct().filter("frame > 0")
    return stabilise.back_to_first(frames.select("frame", *[F.expr(e).cast("double").alias(n) for n, e in WARPS.items()]))


@query("cumulative_shift", f"WITH {SHIFTS_SQL} SELECT frame, round(dx, 6) AS dx, round(dy, 6) AS dy FROM bk")
def cumulative_shift(spark, d):
    return _back(pixels(spark, d)).select("frame", r("dx").alias("dx"), r("dy").alias("dy"))


PADS = 'pads AS (SELECT CAST(floor(greatest(0, -min(dy))) AS BIGINT) AS top, CAST(greatest(0, floor(greatest(0, max(dy) + max(side))) - max(side)) AS BIGINT) AS bottom, CAST(floor(greatest(0, -min(dx))) AS BIGINT) AS "left", CAST(greatest(0, floor(greatest(0, max(dx) + max(side))) - max(side)) AS BIGINT) AS "right" FROM bk, dims)'


@query("pad_bounds", f"WITH {SHIFTS_SQL}, {PADS} SELECT * FROM pads")
def pad_bounds(spark, d):
    side, _ = tables.grid(spark, d)
    return stabilise.pads(_back(pixels(spark, d)), side, side)


@query(
    "warp_nearest",
    f"""WITH {SHIFTS_SQL}, {PADS},
moved AS (SELECT im.frame, CAST(y + floor(coalesce(dy, 0) + 0.5) + top AS BIGINT) AS y, CAST(x + floor(coalesce(dx, 0) + 0.5) + "left" AS BIGINT) AS x, label FROM pixels im LEFT JOIN bk ON bk.frame = im.frame, pads),
canvas AS (SELECT f.frame, a.y, b.x FROM (SELECT DISTINCT frame FROM pixels) f, (SELECT unnest(range(0, side + top + bottom)) AS y FROM pads, dims) a, (SELECT unnest(range(0, side + "left" + "right")) AS x FROM pads, dims) b)
SELECT CAST(c.frame AS BIGINT) AS frame, c.y, c.x, CAST(coalesce(label, 0) AS BIGINT) AS label FROM canvas c LEFT JOIN moved m ON m.frame = c.frame AND m.y = c.y AND m.x = c.x""",
)
def warp_nearest(spark, d):
    p, (side, _) = pixels(spark, d).select("frame", "y", "x", "label"), tables.grid(spark, d)
    return stabilise.warp(p, _back(p), side, side, None).select(*whole(*YXL))


@query(
    "session_import",
    f"""WITH {PIXELS_SQL}, ends AS (SELECT max(y) AS h, max(x) AS w FROM pixels), f AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS page FROM (SELECT DISTINCT frame FROM pixels)),
canvas AS (SELECT frame, page, unnest(range(0, h + 1)) AS y, w FROM f, ends), full_ AS (SELECT frame, page, y, unnest(range(0, w + 1)) AS x FROM canvas)
SELECT page AS frame, c.y, c.x, CAST(coalesce(label, 0) AS BIGINT) AS label, round(coalesce(ac, 0), 6) AS ac, round(coalesce(dc, 0), 4) AS dc FROM full_ c LEFT JOIN pixels p USING (frame, y, x)""",
)
def session_import(spark, d):
    """The table as a session's three files, read back."""
    p, folder = pixels(spark, d), f"{shared_dir(spark)}/pulsegrid-session-{uuid.uuid4().hex}"
    sessions.make_folder(spark, folder)
    sessions.write_stacks(p, folder)
    return sessions.read_pixels(spark, folder).select(*whole(*YXL), r("ac").alias("ac"), r("dc", 4).alias("dc"))
