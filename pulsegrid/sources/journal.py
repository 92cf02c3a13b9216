"""Edits of a tracking session as an append-only log over versions of all its tables: masks, network and shifts.

A session's folder holds version=k/pixels, edges and shifts, and edits. The present state is a version with the edits since replayed, not one after another but as tables: the last one that
touches a pixel, a cell's parent or a frame's shift counts. A checkpoint writes the state as the next version, a reset is an edit that goes back to one; nothing is ever overwritten.

Kinds of edits, with the columns they use (others null):
paint         frame, y, x, value: a pixel gets a label
change        frame, label, value: all pixels that have this label then get another, 0 deletes them; background stays
link          frame, label, to_frame, to_label: the later cell's only parent becomes the earlier one; cells of one frame aren't linked
unlink_left   frame, label: the cell loses its parents
unlink_right  frame, label: the cell's children lose all their parents
shift         frame, dx, dy: a frame's shift
reset         value: back to a version

Edits are people's, so a frame's changes fit a task; pixels and edges may be of any number."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.tracking import next_frame

TABLES = ("pixels", "edges", "shifts")
EDIT = "seq long, kind string, frame long, label long, y long, x long, value long, to_frame long, to_label long, dx double, dy double"


def _kind(edits: DataFrame, *kinds: str) -> DataFrame:
    return edits.filter(F.col("kind").isin(*kinds))


def replay_pixels(pixels: DataFrame, edits: DataFrame) -> DataFrame:
    """pixels with paint and change edits applied in order of seq."""
    kind = pixels.schema["label"].dataType
    last = _kind(edits, "paint").groupBy("frame", "y", "x").agg(F.max_by("value", "seq").alias("_value"), F.max("seq").alias("_seq"))
    x = pixels.join(last, ["frame", "y", "x"], "left").withColumn("_since", F.coalesce("_seq", F.lit(-1)).cast("long")).withColumn("_now", F.coalesce("_value", F.col("label").cast("long")))
    changes = _kind(edits, "change").filter("label <> 0").select(F.col("frame").cast("long").alias("frame"), "label", "value", "seq")
    # Labels are followed through changes once for each (frame, label, time of painting), not for each pixel.
    met = x.filter("_now <> 0").select(F.col("frame").cast("long").alias("frame"), "_now", "_since").distinct().join(changes.select("frame", F.col("label").alias("_now")).distinct(), ["frame", "_now"], "left_semi")

    def follow(some: pd.DataFrame, changed: pd.DataFrame) -> pd.DataFrame:
        steps = defaultdict(list)
        for label, value, seq in changed.sort_values("seq")[["label", "value", "seq"]].itertuples(index=False, name=None):
            steps[label].append((seq, value))
        out = []
        for frame, now, since in some[["frame", "_now", "_since"]].itertuples(index=False, name=None):
            label, at = now, since
            while label and (step := next((s for s in steps.get(label, ()) if s[0] > at), None)):
                at, label = step
            out.append((frame, now, since, label))
        return pd.DataFrame(out, columns=["frame", "_now", "_since", "_to"]).astype("int64")

    to = met.groupBy("frame").cogroup(changes.groupBy("frame")).applyInPandas(follow, "frame long, _now long, _since long, _to long")
    x = x.join(to, ["frame", "_now", "_since"], "left")
    return x.withColumn("label", F.coalesce("_to", "_now").cast(kind)).select(pixels.columns)


def replay_edges(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """edges(frame, label, next_frame, next_label, …, added) with link and unlink edits applied; other columns of new links are null."""
    x = edges.withColumn("next_frame", next_frame(edges)).withColumn("_since", F.lit(-1).cast("long"))
    x = x if "added" in x.columns else x.withColumn("added", F.lit(0))
    forth = F.col("frame") < F.col("to_frame")
    linked = _kind(edits, "link").filter(F.col("frame") != F.col("to_frame")).select(
        "seq", *[F.when(forth, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("frame", "frame", "to_frame"), ("label", "label", "to_label"), ("next_frame", "to_frame", "frame"), ("next_label", "to_label", "label"))]
    )
    none = F.lit(None).cast("long")
    events = linked.unionByName(_kind(edits, "unlink_left").select("seq", none.alias("frame"), none.alias("label"), F.col("frame").alias("next_frame"), F.col("label").alias("next_label")))
    child = ["next_frame", "next_label"]
    last = events.groupBy(*child).agg(F.max_by(F.struct("frame", "label"), "seq").alias("parent"), F.max("seq").alias("_since"))
    new = last.filter("parent.frame IS NOT NULL").select("parent.frame", "parent.label", *child, "_since", F.lit(1).alias("added"))
    x = x.join(last.select(*child), child, "left_anti").unionByName(new, allowMissingColumns=True)
    right = _kind(edits, "unlink_right").groupBy("frame", "label").agg(F.max("seq").alias("_cut"))
    cut = x.join(right, ["frame", "label"]).filter("_cut > _since").groupBy(*child).agg(F.max("_cut").alias("_cut"))
    x = x.join(cut, child, "left").filter("_cut IS NULL OR _cut < _since")
    return x.select(*[c for c in edges.columns if c not in ("next_frame", "added")], "next_frame", "added")


def replay_shifts(shifts: DataFrame, edits: DataFrame) -> DataFrame:
    """shifts(frame, dx, dy) with shift edits applied."""
    last = _kind(edits, "shift").groupBy("frame").agg(F.max_by(F.struct("dx", "dy"), "seq").alias("s")).select("frame", "s.dx", "s.dy")
    return shifts.join(last, "frame", "left_anti").select("frame", "dx", "dy").unionByName(last)


REPLAY = {"pixels": replay_pixels, "edges": replay_edges, "shifts": replay_shifts}


class Journal:
    """A session's tables and edits in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def versions(self) -> dict[int, int]:
        """The versions that stand, each with the number of the last edit in it."""
        if not self._exists("versions"):
            return {}
        return {r.version: r.upto for r in self.spark.read.parquet(f"{self.folder}/versions").collect()}  # a row per checkpoint

    def _write(self, version: int, tables: dict[str, DataFrame], upto: int) -> None:
        """All tables, and then the row that makes the version one; a checkpoint that was cut off before is written over."""
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{self.folder}/version={version}/{name}")
        self.spark.createDataFrame([(version, upto)], "version int, upto long").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")

    def begin(self, pixels: DataFrame, edges: DataFrame, shifts: DataFrame) -> None:
        if self.versions():
            raise ValueError(f"{self.folder} holds a session")
        self._write(0, {"pixels": pixels, "edges": edges, "shifts": shifts}, -1)

    def edits(self) -> DataFrame:
        return self.spark.read.schema(EDIT).parquet(f"{self.folder}/edits") if self._exists("edits") else self.spark.createDataFrame([], EDIT)

    def _last(self) -> int:
        found = self.edits().agg(F.max("seq")).first()[0]
        return max(-1 if found is None else found, *self.versions().values())

    def append(self, *edits: dict) -> None:
        """Edits in order, as dictionaries of the columns that they use."""
        names = [c.split()[0] for c in EDIT.split(", ")]
        first = self._last() + 1
        rows = [tuple({**e, "seq": first + k}.get(n) for n in names) for k, e in enumerate(edits)]
        if bad := [e for e in edits if e.get("kind") not in ("paint", "change", "link", "unlink_left", "unlink_right", "shift", "reset") or e.keys() - {*names[1:]}]:
            raise ValueError(f"no edit: {bad[0]}")
        self.spark.createDataFrame(rows, EDIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/edits")

    def state(self) -> dict[str, DataFrame]:
        """The tables as they are now."""
        known = self.versions()
        latest = max(known)
        base, since = latest, known[latest]
        reset = _kind(self.edits(), "reset").filter(F.col("seq") > since).orderBy(F.desc("seq")).select("seq", "value").first()
        if reset:
            base, since = reset.value, reset.seq
        edits = self.edits().filter((F.col("seq") > since) & (F.col("kind") != "reset"))
        read = lambda name: self.spark.read.parquet(f"{self.folder}/version={base}/{name}")
        return {name: REPLAY[name](read(name), edits) for name in TABLES}

    def checkpoint(self) -> int:
        """Writes the state of all tables as the next version and gives its number."""
        version = max(self.versions()) + 1
        self._write(version, self.state(), self._last())
        return version

    def reset(self, version: int) -> None:
        """Goes back to a version; edits since stay in the log."""
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self.append({"kind": "reset", "value": version})
