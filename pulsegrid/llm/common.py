"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.saved import dealt, drop, scratch, shared_dir, written

__all__ = ["SPACE", "dealt", "drop", "row_key", "scratch", "shared_dir", "table", "take_rows", "text_or_empty", "written"]

#: Bytes between words, as the regular expression class [\x20\x09-\x0D]; bytes.split() splits at exactly these.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_key(df: DataFrame) -> list[Column]:
    """128 bits that equal rows share, as the columns _pg_k1 and _pg_k2. Columns of this subpackage's own start with _pg_."""

    def plain(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        return F.array_sort(F.map_entries(c)) if isinstance(field.dataType, T.MapType) else c

    cols = [plain(f) for f in df.schema.fields]
    return [F.xxhash64(*cols).alias("_pg_k1"), F.xxhash64(F.lit("second"), *cols).alias("_pg_k2")]


def take_rows(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of docs, in as many copies as copies(_pg_k1, _pg_k2, _pg_copies) says for their key; a row per key there, equal rows count as one.

    The join leaves rows sorted and partitioned by the key, so dropping what repeats needs no further shuffle."""
    keyed = docs.select("*", *row_key(docs))
    one = keyed.join(copies.filter("_pg_copies > 0"), ["_pg_k1", "_pg_k2"]).dropDuplicates(["_pg_k1", "_pg_k2"])
    again = F.explode(F.sequence(F.lit(1), F.col("_pg_copies").cast("int")))
    return one.withColumn("_pg_copy", again).select(*[F.col(f"`{c}`") for c in docs.columns])
