"""Columns over a lane: an array<double> with one value per frame. All are built-in expressions, without shuffle or Python."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for a row, though lambdas inside f use it for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def mean(signal: Column) -> Column:
    return F.aggregate(signal, F.lit(0.0), lambda a, v: a + v) / F.size(signal)


def detrend(signal: Column, centre: Column) -> Column:
    """signal less a centre, which should be a column: an expression would be computed for every sample."""
    return F.transform(signal, lambda v: v - centre)


def centred(signal: Column) -> Column:
    """signal less its mean, which is computed once. (Not for a Python function's argument: Spark can't take such a function out of nested lambdas.)"""
    return once(F.struct(signal.alias("s"), mean(signal).alias("c")), lambda x: F.transform(x["s"], lambda v: v - x["c"]))


def cut(signal: Column, start: Column | int, end: Column | int) -> Column:
    """Samples start to end, both included."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.slice(signal, start + 1, end - start + 1)


def amplitude(signal: Column, angle: Column | float) -> Column:
    """2 / n times the modulus of the sum of v[k] exp(-i angle k); the last sample counts in n only."""
    angle = F.lit(float(angle)) if isinstance(angle, (int, float)) else angle
    used = F.slice(signal, F.lit(1), F.greatest(F.size(signal) - 1, F.lit(0)))
    part = lambda f: F.aggregate(F.transform(used, lambda v, k: v * f(angle * k)), F.lit(0.0), lambda a, v: a + v)
    return 2.0 / F.size(signal) * F.sqrt(F.pow(part(F.cos), 2.0) + F.pow(part(F.sin), 2.0))


def ac(signal: Column, frequency: float, fps: Column | float) -> Column:
    return amplitude(signal, 2 * math.pi * frequency / fps)


def power_at_bin(signal: Column, frequency: float, fps: float) -> Column:
    """The amplitude at the whole bin nearest to the frequency."""
    n = F.size(signal).cast("double")
    return amplitude(signal, 2 * math.pi * F.round(frequency * n / fps) / n)


def times(signal: Column, fps: Column | float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(signal) - 1), lambda i: i / F.lit(fps).cast("double"))


def resample(signal: Column, fps: Column | float, new_fps: Column | float) -> Column:
    """Catmull-Rom interpolation at the rate new_fps; the first and last samples stay where they are."""
    n = F.size(signal)
    count = F.floor((n - 1) * (new_fps / fps) + 1e-9).cast("int") + 1
    step = (n - 1) / F.greatest(count - 1, F.lit(1)).cast("double")

    def at(i: Column) -> Column:
        x = i * step
        k = F.floor(x).cast("int")
        u = x - k
        a, b, c, d = (F.element_at(signal, F.least(F.greatest(k + o, F.lit(0)), n - 1) + 1) for o in (-1, 0, 1, 2))
        return b + 0.5 * u * (c - a + u * (2.0 * a - 5.0 * b + 4.0 * c - d + u * (3.0 * (b - c) + d - a)))

    return F.transform(F.sequence(F.lit(0), count - 1), at)


def cascade(x: np.ndarray, lengths: np.ndarray, sections: np.ndarray, state: np.ndarray) -> None:
    """Runs second-order sections over lanes in place: x [lanes, samples], of which `lengths` count, from and to state [lanes, sections, 2].

    The recurrence is sequential in time, so it steps through time for all lanes at once; a lane's state stays as it is from its end on."""
    ends = lengths.min(initial=x.shape[1])
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        z1, z2 = state[:, k, 0].copy(), state[:, k, 1].copy()
        for t in range(x.shape[1]):
            v = x[:, t].copy()
            y = b0 * v + z1
            n1, n2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            if t < ends:
                z1, z2 = n1, n2
            else:
                on = t < lengths
                z1, z2 = np.where(on, n1, z1), np.where(on, n2, z2)
            x[:, t] = y
        state[:, k, 0], state[:, k, 1] = z1, z2


def padded(lanes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """[lanes, samples] with zeros behind the shorter ones, and their lengths."""
    lengths = lanes.map(len).to_numpy(np.int64)
    x = np.zeros((len(lanes), int(lengths.max(initial=0))))
    for i, v in enumerate(lanes):
        x[i, : lengths[i]] = v
    return x, lengths


def cut_back(x: np.ndarray, lengths: np.ndarray) -> pd.Series:
    return pd.Series([row[:n] for row, n in zip(x, lengths, strict=True)], dtype=object)


def sos_filter(sections: np.ndarray | Callable[[float], np.ndarray]):
    """A column function that runs a cascade of second-order sections over each lane, forward, from rest. With a design function, it takes signal and rate, and lanes of each rate have their own sections."""
    if callable(sections):

        @F.pandas_udf("array<double>")
        def run_at(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            designs: dict[float, np.ndarray] = {}
            for lanes, rates in frames:
                x, lengths = padded(lanes)
                for rate in pd.unique(rates):
                    if rate not in designs:
                        designs[rate] = sections(float(rate))
                    fixed = designs[rate]
                    own = np.flatnonzero(rates.to_numpy() == rate)
                    part = x[own]
                    cascade(part, lengths[own], fixed, np.zeros((len(own), len(fixed), 2)))
                    x[own] = part
                yield cut_back(x, lengths)

        return run_at
    fixed = np.asarray(sections, np.float64)

    @F.pandas_udf("array<double>")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lanes in frames:
            x, lengths = padded(lanes)
            cascade(x, lengths, fixed, np.zeros((len(x), len(fixed), 2)))
            yield cut_back(x, lengths)

    return run


def sos_filter_from(sections: np.ndarray):
    """A column function of signal and state that gives both after it: struct<signal, state>. A state is two numbers for each section, in turn; null is rest."""
    fixed = np.asarray(sections, np.float64)

    @F.pandas_udf("signal array<double>, state array<double>")
    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lanes, states in frames:
            x, lengths = padded(lanes)
            state = np.zeros((len(x), len(fixed), 2))
            for i, z in enumerate(states):
                if z is not None:
                    state[i] = np.asarray(z, float).reshape(len(fixed), 2)
            cascade(x, lengths, fixed, state)
            yield pd.DataFrame({"signal": cut_back(x, lengths), "state": list(state.reshape(len(x), -1))})

    return run
