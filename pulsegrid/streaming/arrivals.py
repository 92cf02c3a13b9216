"""Measurements that arrive while the experiment runs: lanes as a stream, extracted as they come, and windows over their summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.functions import lanes
from pulsegrid.operators import signal

#: Fixed value: the state store that arbitrary state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def lane_stream(spark: SparkSession, folder: str, schema: str = "meas_id string, at timestamp, y int, x int, signal array<double>", per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def extracted(stream: DataFrame, how: signal.Analysis) -> DataFrame:
    """ac and dc of each lane: stateless, so the same plan as for a batch."""
    return signal.process(stream, how)


def activity(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Mean ac and dc per measurement and window of event time; rows later than `late` are dropped."""
    x = stream.withWatermark("at", late).groupBy(F.window("at", width), "meas_id").agg(F.avg("ac").alias("ac"), F.avg("dc").alias("dc"), F.count("*").alias("pixels"))
    return x.select(F.col("window.start").alias("from"), "meas_id", "ac", "dc", "pixels")


class _PieceFilter(StatefulProcessor):
    """Keeps, for each lane of a group, the number of its last piece and the filter's two numbers a section."""

    STATE = T.StructType([T.StructField("lanes", T.ArrayType(T.LongType())), T.StructField("last", T.ArrayType(T.LongType())), T.StructField("z", T.ArrayType(T.DoubleType()))])

    def __init__(self, sections: np.ndarray, keys: list[str], lane: str, piece: str, reset: str | None):
        self.sections, self.keys, self.lane, self.piece, self.reset = np.asarray(sections, float), keys, lane, piece, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filters", self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values([self.piece, self.lane], ignore_index=True)
        held = self.state.get() if self.state.exists() else ([], [], [])
        places = {int(k): i for i, k in enumerate(held[0])}
        known = len(places)
        at = np.array([places.setdefault(int(k), len(places)) for k in x[self.lane]], np.int64)
        last = np.full(len(places), np.iinfo(np.int64).min)
        z = np.zeros((len(places), len(self.sections), 2))
        last[:known], z[:known] = held[1], np.asarray(held[2], float).reshape(known, len(self.sections), 2)
        out = np.empty(len(x), object)
        late = np.zeros(len(x), bool)
        for _, rows_of in x.groupby(self.piece, sort=True).indices.items():
            numbers = x[self.piece].to_numpy()[rows_of]
            late[rows_of] = (numbers <= last[at[rows_of]]) | pd.Series(at[rows_of]).duplicated().to_numpy()
            good = rows_of[~late[rows_of]]
            if not len(good):
                continue
            own = at[good]
            if self.reset is not None:
                z[own[x[self.reset].to_numpy(bool)[good]]] = 0
            values, lengths = lanes.padded(x["signal"].iloc[good])
            state = z[own]
            lanes.cascade(values, lengths, self.sections, state)
            z[own], last[own] = state, x[self.piece].to_numpy()[good]
            out[good] = lanes.cut_back(values, lengths).to_numpy()
        self.state.update(([*places], last.tolist(), z.ravel().tolist()))
        named = {k: [v] * len(x) for k, v in zip(self.keys, key, strict=True)}
        yield pd.DataFrame({**named, self.lane: x[self.lane], self.piece: x[self.piece], "signal": out, "late": late})


def filtered(stream: DataFrame, sections: np.ndarray, keys: Sequence[str] = ("meas_id", "y"), lane: str = "x", piece: str = "piece", reset: str | None = None) -> DataFrame:
    """keys…, lane, piece, signal, late of a stream (or table) of the pieces of lanes, each filtered on from where the last one ended, also after a restart of the query.

    The lanes of one key go through the filter together and share a state of two numbers a section and lane, so a key should be a part of an image, such as a row of one measurement.
    Pieces of a lane are numbered; they may skip numbers, but one that comes after a later one, or a second time, is late: its signal is null and changes nothing. Where the column `reset`
    is true, the filter starts anew with that piece. The session needs the settings STORE."""
    keys = [*keys]
    kinds = T.StructType([*[T.StructField(c, stream.schema[c].dataType) for c in (*keys, lane, piece)], T.StructField("signal", T.ArrayType(T.DoubleType())), T.StructField("late", T.BooleanType())])
    x = stream.select(*keys, lane, piece, F.coalesce(F.col("signal").cast("array<double>"), F.expr("array()").cast("array<double>")).alias("signal"), *([F.coalesce(reset, F.lit(False)).alias(reset)] if reset else []))
    return x.groupBy(*keys).transformWithStateInPandas(_PieceFilter(sections, keys, lane, piece, reset), kinds, "Append", "None")
