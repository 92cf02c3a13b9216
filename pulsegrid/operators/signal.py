"""Operators over stacks of lanes(…, signal): mean signals, limits, spectra, and the whole extraction of mean and amplitude."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import filters, lanes, names
from pulsegrid.sources.saved import written


@dataclass(frozen=True)
class Analysis:
    """Parameters of an extraction; another analysis is a changed copy. fps is a number, or names the column with the rate of each lane, so that measurements of several rates go through one plan."""

    frequency: float = 1.0
    fps: float | str = 16.7
    interpolate: bool = False
    band_pass: bool = False
    low: float = 0.1
    high: float = 6.0
    order: int = 4
    ceiling_axis: bool = False  # the time axis after interpolation at the rate rounded up, not at that of the samples

    def changed(self, **what) -> Analysis:
        return replace(self, **what)

    @property
    def rate(self) -> Column | float:
        return F.col(self.fps) if isinstance(self.fps, str) else self.fps

    @property
    def rate_keys(self) -> list[str]:
        return [self.fps] if isinstance(self.fps, str) else []

    def _rounded(self, by: Callable, column: Callable) -> Column | float:
        return column(self.rate).cast("double") if isinstance(self.fps, str) else float(by(self.fps))

    @property
    def final_fps(self) -> Column | float:
        return self._rounded(lambda x: math.floor(x + 0.5), lambda c: F.floor(c + 0.5)) if self.interpolate else self.rate

    @property
    def axis_fps(self) -> Column | float:
        return self._rounded(math.ceil, F.ceil) if self.interpolate and self.ceiling_axis else self.final_fps

    def sections(self, fps: float | None = None):
        """The band-pass at a rate; at final_fps, if that is a number."""
        fps = self.final_fps if fps is None else fps
        return filters.band_pass_sections(self.order, *filters.clamp_band(self.low, self.high, self.frequency, fps), fps)


def to_lanes(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames(keys…, t[, page], v) to keys…, signal."""
    place = ["t", "page"] if "page" in frames.columns else ["t"]
    return frames.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*place, "v"))), lambda s: s["v"].cast("double")).alias("signal"))


def to_frames(stack: DataFrame) -> DataFrame:
    """The other way: a row per sample, t and v for signal; none for a lane without samples.

    The outer form, since for the other one Spark infers a filter that computes the whole lane a second time."""
    rows = stack.select(*[c for c in stack.columns if c != "signal"], F.posexplode_outer("signal").alias("t", "v"))
    return rows.filter(F.col("t").isNotNull())


def in_region(y: tuple[int, int], x: tuple[int, int]) -> Column:
    return F.col("y").between(*y) & F.col("x").between(*x)


def _sums(keys: list[str], together: int = 1 << 22) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the lanes of each key within a task, element by element: keys…, s (sums), n (how many values each sum has). Hands on what it has at `together` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        kinds: list[pa.DataType] = []

        def handed() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
            columns += [pa.array([x[i] for x in held.values()], pa.list_(kind)) for i, kind in enumerate((pa.float64(), pa.int64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, [*keys, "s", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, kinds = batch.column("signal"), [batch.schema.field(k).type for k in keys]
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            places: dict[tuple, int] = {}
            names_ = zip(*[batch.column(k).to_pylist() for k in keys], strict=True) if keys else [()] * len(lengths)
            codes = np.array([places.setdefault(k, len(places)) for k in names_], np.int64)
            flat = lists.flatten()
            there = np.asarray(flat.is_valid())
            values = np.where(there, flat.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            if not keys and (lengths == lengths[0]).all():
                ends, s, n = np.array([0, lengths[0]]), *(x.reshape(len(lengths), -1 if len(x) else 0).sum(axis=0) for x in (values, there))
            else:  # the keys' sums lie side by side, each as long as its longest lane
                longest = np.zeros(max(codes) + 1, np.int64)
                np.maximum.at(longest, codes, lengths)
                ends = np.concatenate([[0], np.cumsum(longest)])
                at = np.arange(len(values)) + np.repeat(ends[codes] - (np.cumsum(lengths) - lengths), lengths)
                s, n = (np.bincount(at, x, ends[-1]) for x in (values, there))
            for key, code in places.items():
                own = slice(ends[code], ends[code + 1])
                before = held.get(key, (np.zeros(0), np.zeros(0, np.int64)))
                size = max(len(before[0]), own.stop - own.start)
                held[key] = tuple(np.pad(x, (0, size - len(x))) + np.pad(y, (0, size - len(y))) for x, y in zip(before, (s[own], n[own].astype(np.int64)), strict=True))
            if sum(len(x) for x, _ in held.values()) >= together:
                yield handed()
        if held:
            yield handed()

    return run


def mean_signal(stack: DataFrame, where: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, t, m: the mean over all pixels of each measurement, or those of a region, for lanes of any and of unequal lengths; nulls don't count.

    One pass: tasks add up whole lanes, a row per task, key and sample is shuffled."""
    stack, keys = stack if where is None else stack.filter(where), list(keys)
    kinds = T.StructType([stack.schema[k] for k in keys] + [T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.ArrayType(T.LongType()))])
    parts = stack.select(*keys, F.col("signal").cast("array<double>").alias("signal")).mapInArrow(_sums(keys), kinds)
    rows = parts.select(*keys, F.posexplode(F.arrays_zip("s", "n")).alias("t", "x")).filter("x.n > 0")
    return rows.groupBy(*keys, "t").agg((F.sum("x.s") / F.sum("x.n")).alias("m"))


def steps(mean: DataFrame, sigmas: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, t, d, outlier: differences to the next sample, and whether they exceed `sigmas` population deviations of the signal.

    A row per time step, whatever the number of pixels: the windows are over the signal of one measurement."""
    x = mean.withColumn("d", F.lead("m").over(Window.partitionBy(*keys).orderBy("t")) - F.col("m")).withColumn("sd", F.stddev_pop("m").over(Window.partitionBy(*keys)))
    return x.filter(F.col("d").isNotNull()).select(*keys, "t", "d", (F.abs("d") > sigmas * F.col("sd")).alias("outlier"))


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clean_limits(mean: DataFrame, start: Column | int, end: Column | int, frequency: float, fps: Column | float, sigmas: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, first, last, periods of each measurement: the longest stretch between outliers (the last one of equal ones), moved inward by one at both ends;
    the given limits where there are none. start, end and fps are numbers or made of the keys."""
    one = F.lit(0).alias("_one")
    by = [*keys, "_one"]
    found = steps(mean, sigmas, keys).filter("outlier").select(*keys, one, F.col("t").cast("long").alias("at"), F.lit(1).alias("real"))
    each = mean.groupBy(*keys).agg(F.max("t").cast("long").alias("top")).select(*keys, one, "top")
    ends = each.select(*by, F.explode(F.array(_column(start).cast("long"), _column(end).cast("long"))).alias("at"), F.lit(0).alias("real"))
    w = Window.partitionBy(*by).orderBy("at")
    gaps = found.union(ends).withColumn("row", F.row_number().over(w)).withColumn("before", F.lag("at").over(w))
    size = F.when(F.col("before").isNotNull(), F.struct(F.col("at") - F.col("before"), F.col("row")))
    best = gaps.groupBy(*by).agg(F.max_by(F.struct(F.col("before").alias("lo"), F.col("at").alias("hi")), size).alias("gap"), F.sum("real").alias("outliers"))
    x, clean = each.join(best, by), F.col("outliers") == 0
    x = x.select(*keys, F.when(clean, _column(start)).otherwise(F.col("gap.lo") + 1).cast("long").alias("first"), F.when(clean, F.least(_column(end), F.col("top"))).otherwise(F.col("gap.hi") - 1).cast("long").alias("last"))
    return x.withColumn("periods", F.floor((F.col("last") - F.col("first") + 1) * (_column(frequency) / fps)).cast("long"))


def trim_to_periods(limits: DataFrame, n: Column | int, frequency: float, fps: Column | float) -> DataFrame:
    """limits(…, first, last, periods) with first and last cut to whole periods of a signal of n samples; n and fps are numbers or columns of limits."""
    n = _column(n)
    length = lambda p: F.floor(p / frequency * fps + 0.5)
    fitting = F.filter(F.sequence(F.lit(0), F.greatest("periods", F.lit(0)).cast("int")), lambda p: length(p) + F.col("first") <= F.col("last"))
    p = F.coalesce(F.array_max(fitting), F.lit(0))
    last = F.when(F.col("periods") < 1, F.greatest(F.col("last"), n - 1)).otherwise(F.col("first") + F.least(length(p), n - 1 - F.col("first")))
    x = limits.withColumn("last", F.least(last, n - 1).cast("long"))
    whole = F.col("first") >= F.col("last")
    rest = [c for c in limits.columns if c not in ("first", "last", "periods")]
    return x.select(*rest, F.when(whole, 0).otherwise(F.col("first")).cast("long").alias("first"), F.when(whole, n - 1).otherwise(F.col("last")).cast("long").alias("last"))


def limits(stack: DataFrame, how: Analysis, start: int = 0, end: int | None = None, periods: int | None = None, keys: Sequence[str] = (), fractions: tuple[float, float] | None = None) -> DataFrame:
    """keys…, n, first, last: the samples to use of each measurement's n. With `fractions` the limits start from two shares of n in place of start and end; with `periods` they aren't searched for.

    A row per measurement; the rate, if it is a column, must be the same throughout one."""
    by = [*keys, *[k for k in how.rate_keys if k not in keys]]
    if periods is None:
        mean = mean_signal(stack, keys=by)
        sized = mean.withColumn("n", (F.max("t").over(Window.partitionBy(*by)) + 1).cast("long"))
    else:
        sized = stack.groupBy(*by).agg(F.max(F.size("signal")).cast("long").alias("n"))
    n = F.col("n")
    if fractions:
        span = names.fraction_limits(*map(F.lit, fractions), n)
        first, last = span["first"], span["last"]
    else:
        first, last = F.lit(start), n - 1 if end is None else F.lit(end)
    if periods is None:
        found = clean_limits(sized, first, last, how.frequency, how.rate, keys=[*by, "n"])
    else:
        found = sized.select(*by, "n", first.cast("long").alias("first"), last.cast("long").alias("last"), F.lit(periods).cast("long").alias("periods"))
    return trim_to_periods(found, n, how.frequency, how.rate).select(*keys, "n", "first", "last")


def process(stack: DataFrame, how: Analysis) -> DataFrame:
    """stack with signal resampled, detrended and filtered as asked, dc and ac."""
    x = stack
    if how.interpolate:
        x = x.withColumn("signal", lanes.resample(F.col("signal"), how.rate, how.final_fps))
    x = x.withColumn("dc", lanes.mean(F.col("signal"))).withColumn("signal", lanes.detrend(F.col("signal"), F.col("dc")))
    if how.band_pass:
        run = lanes.sos_filter(how.sections)("signal", how.final_fps) if isinstance(how.fps, str) else lanes.sos_filter(how.sections())("signal")
        x = x.withColumn("signal", run)
    return x.withColumn("ac", lanes.ac(F.col("signal"), how.frequency, how.final_fps))


def time_axis(stack: DataFrame, how: Analysis) -> DataFrame:
    """process()ed stack with times, one for each sample of signal."""
    return stack.withColumn("times", lanes.times(F.col("signal"), how.axis_fps))


#: Rows of limits up to which they are sent to all tasks: at some 50 bytes each, 50 MB.
SENT_LIMITS = 1_000_000


def extract(
    stack: DataFrame, how: Analysis, start: int = 0, end: int | None = None, periods: int | None = None, keys: Sequence[str] = (), fractions: tuple[float, float] | None = None
) -> DataFrame:
    """The whole extraction: limits() of each measurement, trimming, then process(). Adds first and last.

    With keys, the stack holds any number of measurements, told apart by them. Their limits are written, and sent to all tasks if they are few; lanes aren't shuffled then."""
    found = limits(stack, how, start, end, periods, keys, fractions).drop("n")
    if keys:
        found = written(found, "limits")
        x = stack.join(F.broadcast(found) if found.count() <= SENT_LIMITS else found, [*keys])
    else:
        x = stack.crossJoin(F.broadcast(found))  # one row
    return process(x.withColumn("signal", lanes.cut(F.col("signal"), F.col("first").cast("int"), F.col("last").cast("int"))), how)


def spectrum(mean: DataFrame, n: int, fps: float) -> DataFrame:
    """k, freq, amp of the mean signal's one-sided spectrum, bins 0 to n // 2 - 1, each doubled."""
    x = mean.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n // 2 - 1))))
    angle = 2 * math.pi / n * F.col("k") * F.col("t")
    sums = x.groupBy("k").agg(F.sum(F.col("m") * F.cos(angle)).alias("c"), F.sum(F.col("m") * F.sin(angle)).alias("s"))
    return sums.select("k", (F.col("k") * fps / n).alias("freq"), (2.0 / n * F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("amp"))


def nearest_sample(samples: DataFrame, key: str, at: float, time: str, index: str = "i") -> DataFrame:
    """For each key the index of the sample nearest to `at`, the first one of equals."""
    return samples.groupBy(key).agg(F.min_by(F.col(index), F.struct(F.abs(F.col(time) - at), F.col(index))).alias(index))


def region_limits(mean: DataFrame, left: float, right: float, fps: float, offset: int = 0) -> DataFrame:
    """first, last: the samples nearest to two times (the first ones of equals), the second moved one up, counted from an offset."""
    time = F.col("t") / fps
    nearest = lambda at: F.min_by("t", F.struct(F.abs(time - at), F.col("t")))
    return mean.agg((nearest(left) + offset).cast("long").alias("first"), (nearest(right) + 1 + offset).cast("long").alias("last"))


def frequency_limits(low: str, high: str, top: float, default: tuple[float, float] = (0.1, 6.0)) -> tuple[float, float]:
    """Two typed frequencies within 0 and the spectrum's end; the default pair if one can't be read."""
    try:
        return max(float(low), 0.0), min(float(high), top)
    except ValueError:
        return default


def view(stack: DataFrame, first: int, last: int) -> DataFrame:
    """t, y, x, v of the frames of a stack from first to last, both included. Lanes are cut before they are exploded."""
    first = max(first, 0)
    cut = stack.withColumn("signal", lanes.cut(F.col("signal"), first, max(last, first - 1)))
    return to_frames(cut).withColumn("t", F.col("t") + first)


def read_point(stack: DataFrame, t: int, y: int, x: int) -> DataFrame:
    """v at a point; no row outside the stack."""
    return stack.filter((F.col("y") == y) & (F.col("x") == x) & (F.size("signal") > t) & F.lit(t >= 0)).select(F.element_at("signal", t + 1).alias("v"))


def random_stack(spark, frames: int = 400, height: int = 300, width: int = 300, seed: int = 0) -> DataFrame:
    """y, x, signal of uniform noise, as a stack to start with."""
    pixels = spark.range(height * width).select(F.expr(f"id div {width}").alias("y"), F.expr(f"id % {width}").alias("x"))
    return pixels.withColumn("signal", F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda t: (F.pmod(F.xxhash64(F.lit(seed), "y", "x", t), F.lit(1 << 53)) / float(1 << 53))))
