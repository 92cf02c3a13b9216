"""Per-cell time series: lineage joined with features, selections, nearest times, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.names import root_of

#: Columns that lists of plottable attributes leave out.
HIDDEN = ("track", "frame", "label", "time", "com_y", "com_x", "total", "interior")


def with_features(lineage: DataFrame, features: DataFrame) -> DataFrame:
    """lineage(track, frame, label) with the features of its cells; missing tells where there are none."""
    x = lineage.join(features.withColumn("_there", F.lit(True)), ["frame", "label"], "left")
    return x.withColumn("missing", F.col("_there").isNull()).drop("_there")


def relative_times(measurements: DataFrame, whole: bool = False) -> DataFrame:
    """measurements(frame, abstime) with time since the first, in whole minutes if asked."""
    first = measurements.agg(F.min("abstime").alias("_first"))  # one row
    t = F.col("abstime") - F.col("_first")
    return measurements.crossJoin(F.broadcast(first)).withColumn("time", t.cast("int").cast("double") if whole else t).drop("_first")


def collected(series: DataFrame, features: list[str]) -> DataFrame:
    """A row per track: each feature as an array in order of frame."""
    rows = F.array_sort(F.collect_list(F.struct("frame", *features)))
    x = series.groupBy("track").agg(rows.alias("rows"))
    return x.select("track", *[F.col("rows")[f].alias(f) for f in ("frame", *features)])


def export_rows(series: DataFrame, features: list[str], digits: int = 6) -> DataFrame:
    """track, row, line: the text block of each track: its name, a line per feature, an empty line."""
    c = collected(series, features)
    value = lambda f: F.concat_ws(",", F.lit(f), F.array_join(F.transform(f, lambda v: F.format_string(f"%.{digits}f", v.cast("double"))), ","))
    lines = F.array(F.col("track"), *[value(f) for f in features], F.lit(""))
    return c.select("track", F.posexplode(lines).alias("row", "line")).orderBy("track", "row")


def write_text(series: DataFrame, features: list[str], path: str) -> None:
    """The blocks of all tracks, sorted, as text files that follow each other in order."""
    export_rows(series, features).select("line").write.text(path)


def unpivoted(series: DataFrame, features: list[str]) -> DataFrame:
    return series.unpivot(["track", "frame"], features, "feature", "value")


def attributes(series: DataFrame) -> list[str]:
    return [c for c in series.columns if c not in HIDDEN]


def selects(track: str, names: list[str]) -> Column:
    """Tracks whose name holds any of the names, so `Cell_1` also selects `Cell_10`."""
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.col(track), n))


def lineage_ids(series: DataFrame) -> DataFrame:
    return series.select(root_of(F.col("track")).alias("root")).distinct()


def time_range(series: DataFrame) -> DataFrame:
    return series.agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def at_time(samples: DataFrame, key: str, at: float, time: str, index: str, tolerance: float = 0.1) -> DataFrame:
    """For each key its sample nearest to `at` (the first of equals), if within the tolerance.

    The tolerance is a range filter that the scan can use; then one partial aggregate per key."""
    close = samples.filter(F.col(time).between(at - tolerance, at + tolerance))
    nearest = F.min_by(F.struct(*[c for c in samples.columns if c != key]), F.struct(F.abs(F.col(time) - at), F.col(index)))
    return close.groupBy(key).agg(nearest.alias("s")).select(key, "s.*")


def nearest_times(queries: DataFrame, samples: DataFrame, key: str, time: str, index: str, tolerance: float = 0.1) -> DataFrame:
    """queries(key, at) joined with their nearest sample within the tolerance: a range join, bucketed by the tolerance so
    that it is an equi-join on key and bucket."""
    bucket = lambda c: F.floor(c / tolerance)
    q = queries.withColumn("_b", F.explode(F.sequence(bucket(F.col("at")) - 1, bucket(F.col("at")) + 1)))
    x = q.join(samples.withColumn("_b", bucket(F.col(time))), [key, "_b"]).filter(F.abs(F.col(time) - F.col("at")) <= tolerance)
    rest = [c for c in samples.columns if c != key]
    return x.groupBy(key, "at").agg(F.min_by(F.struct(*rest), F.struct(F.abs(F.col(time) - F.col("at")), F.col(index))).alias("s")).select(key, "at", "s.*")
