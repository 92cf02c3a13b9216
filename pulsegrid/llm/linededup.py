"""Line deduplication: range-partitioned line hashes with a secondary sort, first occurrences streamed, drop bitmaps returned.

Every keyed line becomes (hash, document, row, position), range-partitioned and sorted by all of them, so that even one line
that a third of the corpus holds is spread over partitions. Each partition is streamed once: the first document
of a hash owns it. Only the run of hashes at the head of a partition may have begun in an earlier one; its owner is
settled from one small border row per partition. What goes back to the documents is a compressed bitmap of
the lines to keep, not text.

Defined cases: a null or empty text is one empty line; a line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys
under `min_chars` code points are kept always; documents with one doc_id are one document, a null doc_id is one document,
last in order; repeated rows get the same lines; an empty table gives an empty result; columns besides doc_id and
text are ignored by keep_bitmaps() and kept by dedup_rows().
A very long text is streamed line by line; of equal doc_ids that hold a line first, all keep it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import text_or_empty, written

NO_ID = (1 << 63) - 1
BLANK = b" \t\n\x0b\x0c\r"


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc, row_hash, pos of every line whose key has min_chars code points."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs_, rows, pos = [], [], [], []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for i, line in enumerate(text.as_py().encode().split(b"\n")):
                    key = line.strip(BLANK).lower()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        keys.append(xxhash.xxh3_128_digest(key))
                        docs_.append(doc)
                        rows.append(row)
                        pos.append(i)
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs_, pa.int64()), pa.array(rows, pa.int64()), pa.array(pos, pa.int32())], schema=schema)

    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_or_empty()).alias("row_hash"), text_or_empty().alias("text"))
    return x.mapInArrow(split, "h1 long, h2 long, doc long, row_hash long, pos int")


def stream_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: its dropped lines, the lines of its head run (to be settled) and a border row.

    kind 0: dropped; 1: head run; 2: border with the first hash, last hash and the last hash's first document here."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("l1", pa.int64()), ("l2", pa.int64()), ("doc", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32())])

    def rows(kind: int, part: int, doc: np.ndarray, row_hash: np.ndarray, pos: np.ndarray, ends: tuple = (0, 0, 0, 0)) -> pa.RecordBatch:
        n = len(doc)
        fixed = [pa.array(np.full(n, v, t)) for v, t in ((kind, np.int32), (part, np.int32), *((e, np.int64) for e in ends))]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(doc), pa.array(row_hash), pa.array(pos)], schema=schema)

    first = last = None
    owner, part = 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        part, h1, h2, doc, row_hash, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        part = int(part[0])
        if first is None:
            first = (int(h1[0]), int(h2[0]))
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = last != (int(h1[0]), int(h2[0]))
        owns = np.where(new, doc, owner)
        owns = owns[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        head = (h1 == first[0]) & (h2 == first[1])
        for kind, mask in ((0, ~head & (doc != owns)), (1, head)):
            if mask.any():
                yield rows(kind, part, doc[mask], row_hash[mask], pos[mask].astype(np.int32))
        last, owner = (int(h1[-1]), int(h2[-1])), int(owns[-1])
    if first is not None:
        yield rows(2, part, np.array([owner]), np.array([0]), np.array([0], np.int32), (*first, *last))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc, row_hash, pos of every line that goes."""
    spark = docs.sparkSession
    lines = line_hashes(docs, min_chars)
    ranged = lines.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "h1", "h2", "doc", "row_hash", "pos").sortWithinPartitions("h1", "h2", "doc", "row_hash", "pos")
    kinds = "kind int, part int, h1 long, h2 long, l1 long, l2 long, doc long, row_hash long, pos int"
    streamed = written(ranged.select(F.spark_partition_id().alias("part"), "h1", "h2", "doc", "row_hash", "pos").mapInArrow(stream_owners, kinds), "line-stream")
    # A row per partition. A hash that reaches from one partition into the next keeps the owner of the first that holds it.
    w = Window.orderBy("part")
    same = (F.col("h1") == F.lag("l1").over(w)) & (F.col("h2") == F.lag("l2").over(w))
    runs = (
        streamed.filter("kind = 2")
        .withColumn("joined", F.coalesce(same, F.lit(False)))
        .withColumn("through", (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")))
        # the owner handed on by a partition: its own, unless it is of one hash only and that began earlier
        .withColumn("handed", F.when(~(F.col("joined") & F.col("through")), F.col("doc")))
        .withColumn("earlier", F.last("handed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("part"), F.when(F.col("joined"), F.col("earlier")).alias("earlier"))
    )
    head = streamed.filter("kind = 1")
    own = head.groupBy("part").agg(F.min("doc").alias("here"))
    # A row per partition at most: small enough to broadcast.
    border = own.join(runs, "part").select("part", F.coalesce("earlier", "here").alias("owner"))
    head = head.join(F.broadcast(border), "part").filter(F.col("doc") != F.col("owner"))
    cols = ["doc", "row_hash", "pos"]
    return streamed.filter("kind = 0").select(*cols).unionByName(head.select(*cols))


def pack_bits(positions: np.ndarray) -> bytes:
    """Bits of the lines to keep, up to the last dropped one; lines beyond are kept."""
    keep = np.ones(int(positions.max()) + 1, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes() + bytes([len(keep) % 8]), 1)


def unpack_bits(bitmap: bytes) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    return bits[: len(bits) - (8 - raw[-1]) % 8].astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc, row_hash, keep: a bitmap for every document that loses a line."""

    @F.pandas_udf("binary")
    def bitmap(positions: pd.Series) -> pd.Series:
        return positions.map(lambda p: pack_bits(np.asarray(p, np.int64)))

    return dropped_lines(docs, min_chars).groupBy("doc", "row_hash").agg(F.collect_list("pos").alias("gone")).select("doc", "row_hash", bitmap("gone").alias("keep"))


def kept(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text of the lines that stay, how many lines there were and how many went."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    stays = unpack_bits(bitmap)
    left = [x for i, x in enumerate(lines) if i >= len(stays) or stays[i]]
    return "\n".join(left), len(lines), len(lines) - len(left)


def with_bitmaps(docs: DataFrame, min_chars: int) -> DataFrame:
    bits = keep_bitmaps(docs, min_chars).withColumnsRenamed({"doc": "_pg_doc", "row_hash": "_pg_row", "keep": "_pg_keep"})
    x = docs.withColumn("_pg_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_pg_row", F.xxhash64(text_or_empty()))
    return x.join(bits, ["_pg_doc", "_pg_row"], "left")


def line_report(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs(doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept(t.as_py(), k.as_py()) for t, k in zip(b.column(1), b.column(2), strict=True)]
            cols = [b.column(0), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    x = with_bitmaps(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), min_chars)
    return x.select("doc_id", "text", "_pg_keep").mapInArrow(report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_rows(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with each text reduced to the lines that stay and n_chars, if there, to fit; rows whose text loses nothing are as they were."""

    @F.pandas_udf("string")
    def reduced(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([kept(t, k)[0] for t, k in zip(text, bitmap, strict=True)], dtype=object)

    x = with_bitmaps(docs, min_chars).withColumn("text", F.when(F.col("text").isNotNull(), reduced(text_or_empty(), "_pg_keep")))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.when(F.col("_pg_keep").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return x.select(*[F.col(f"`{c}`") for c in docs.columns])
