"""Intermediate tables in the cluster's shared folder: they cut lineages and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_paths: dict[str, None] = {}
_read_by: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, one for this process if all of Spark runs in it; on a cluster that is an error,
    since each executor would write to a disk of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="pulsegrid-"))
    return _own[0]


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/pulsegrid-{name}-{uuid.uuid4().hex}"
    _paths[path] = None
    if (scope := _scope.get()) is not None:
        scope.append(path)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _read_by[out] = path
    return out


def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """As written(), in as many buckets by key as shuffles have partitions: groupings by key read it without a shuffle. What the bytes hold is taken to be packed already.

    The catalogue's entry goes at once, the files stay until drop()."""
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = f"pulsegrid_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{at}"
    _paths[path] = None
    if (scope := _scope.get()) is not None:
        scope.append(path)
    df.write.bucketBy(n, key).option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(at)
    out = spark.table(at)
    spark.sql(f"DROP TABLE {at}")
    _read_by[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if path in _paths:
        del _paths[path]
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes what written() returned, once nothing reads it any more."""
    for df in tables:
        if path := _read_by.pop(df, None):
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What written() makes inside is deleted on leaving, but for tables handed to the function that this gives; an outer scratch() takes these over."""
    mine: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_read_by[df])
        return df

    outer = _scope.get()
    token = _scope.set(mine)
    try:
        yield keep
    finally:
        _scope.reset(token)
        for path in mine:
            if path not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this process has written. DataFrames that still read them can't be used afterwards."""
    for path in [*_paths]:
        _delete(spark, path)
