"""Document fingerprints of Lempel-Ziv phrases.

A text is parsed into the phrases of an LZ78 dictionary over its words: each phrase is the longest one known followed by one more word. The set of
phrases is hashed and its `keep` smallest hashes are the fingerprint; the likeness of two fingerprints is the share of
common hashes among the `keep` smallest of both together, an estimate of the phrase sets' Jaccard likeness (exact for small
sets). Words over `longest` bytes, as in scripts without spaces, are cut into runs of so many bytes, which may part a character: only bytes are compared.

edited_pairs() also needs each document's successor by doc_id. Texts are range-partitioned by doc_id once and streamed in order;
the only successors that aren't in the same partition are those of the partitions' last rows, which are matched with the next
partitions' first rows afterwards.

Defined cases: a null text counts as empty; the fingerprint of a text without words is empty, and two such are alike (1), one such and
another are not (0); a null doc_id comes first; equal doc_ids are ordered by their text's hash, repeated rows follow each other; a single
document is its own successor; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import text_or_empty, written

HEX = 8  # digits of a hash in a fingerprint


def phrases(words: list[bytes]) -> set[bytes]:
    seen: set[bytes] = set()
    known = b""
    for w in words:
        phrase = known + b" " + w
        if phrase in seen:
            known = phrase
        else:
            seen.add(phrase)
            known = b""
    if known:
        seen.add(known + b" ")  # the unfinished last phrase
    return seen


def words_of(text: str, longest: int) -> list[bytes]:
    words = text.encode().split()
    if words and max(map(len, words)) > longest:
        return [w[i : i + longest] for w in words for i in range(0, len(w), longest)]
    return words


def fingerprint(text: str, keep: int = 64, longest: int = 32) -> np.ndarray:
    """The `keep` smallest distinct 32-bit hashes of the phrases, ascending."""
    digest = xxhash.xxh32_intdigest
    hashes = np.unique(np.array([digest(p) for p in phrases(words_of(text, longest))], np.uint32))
    return hashes[:keep]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = 64) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:keep]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def digits(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def from_digits(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _row(doc_id: int | None, text: str, own: np.ndarray, following: str, its: np.ndarray, keep: int, longest: int) -> tuple:
    new = edited(text, following)
    print_ = own if new == text else fingerprint(new, keep, longest)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), digits(own), digits(print_), likeness(own, print_, keep), likeness(own, its, keep)


def edited_pairs(docs: DataFrame, keep: int = 64, longest: int = 32) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    kinds = f"kind int, part int, {RESULT}, text string"
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in NAMES[2:5]), *((n, pa.float64()) for n in NAMES[5:]), ("text", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a result; 1: the partition's first text; 2: its last row, still without successor."""
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        before, part = None, 0
        for batch in batches:
            out = []
            for p, doc_id, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                own = fingerprint(text, keep, longest)
                part = p.as_py()
                if before is None:
                    out.append((1, part, None, None, None, None, None, None, None, text))
                else:
                    out.append((0, part, *_row(*before, text, own, keep, longest), None))
                before = (doc_id, text, own)
            if out:
                yield batch_of(out)
        if before is not None:
            yield batch_of([(2, part, before[0], None, None, None, None, None, None, before[1])])

    ordered = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    streamed = written(ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(stream, kinds), "lz-stream", "zstd")
    # One first and one last row for each partition: the k-th partition's last row is followed by the next one's first.
    w = Window.orderBy("part")
    heads = streamed.filter("kind = 1").select("part")
    heads = heads.select("part", F.lead("part").over(w).alias("next"), F.first("part").over(w).alias("first")).select("part", F.coalesce("next", "first").alias("next"))
    follows = streamed.filter("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = streamed.filter("kind = 2").select("part", "doc_id", "text").join(heads, "part").join(follows, "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = _row(doc_id, text, fingerprint(text, keep, longest), following, fingerprint(following, keep, longest), keep, longest)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types[2:-1], strict=True)], names=NAMES)

    return streamed.filter("kind = 0").select(*NAMES).unionByName(ends.select("doc_id", "text", "following").mapInArrow(finish, RESULT))
