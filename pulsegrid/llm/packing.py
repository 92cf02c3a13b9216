"""Packing of token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

Each document is tokenised once. Whole sequences' worth of its ids are cut off and fill a sequence each; what is left (less than a
sequence) goes to a random group of bounded size, and every group is packed on its own.
Only piece lengths and checksums move between tasks, never ids or texts.

Ids are those of the `tokenizers` file byte_bpe_50k.json. They are made by tiktoken with the same vocabulary and merges,
which is about six times as fast; tests compare the two.

Defined cases: a null or empty text is one piece, the end id; null or repeated doc_ids and repeated rows are packed as
documents of their own; an empty table gives an empty result; other input columns are ignored.
A very long text fills whole sequences and one rest; rests of equal length keep their order.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import written

SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(json_path: str | None, rank_path: str | None):
    """text -> list of ids, as tokenizers gives with add_special_tokens=False."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    slow = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special={SPECIAL}) if SPECIAL in text else fast.encode_ordinary(text)
        except BaseException as e:  # the regular expression engine may give up on extreme runs; others pass on
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if not slow:
                slow.append(Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces_of(docs: DataFrame, size: int, end_id: int, json_path: str | None, rank_path: str | None) -> DataFrame:
    """A row per piece of docs(doc_id, text): whole sequences, then what is left."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, rank_path)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw, n = np.array(ids, "<u4").tobytes(), len(ids)
                for start in range(0, n, size):
                    length = min(size, n - start)
                    for col, v in zip(out, (doc_id, start, length, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + length)]), n), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=PIECE)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (all at most size); ties keep their order.

    The tree's leaves are the bins' free room, a node holds the larger of its children: the first bin with room is found by going down
    from the root, left child first.
    """
    n = len(lengths)
    width = 1 << max(0, (n - 1).bit_length())
    room = [size] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, k = int(lengths[i]), 1
        while k < width:
            k *= 2
            if room[k] < need:
                k += 1
        bins[i], offsets[i] = k - width, size - room[k]
        room[k] -= need
        while k > 1:
            k //= 2
            top = max(room[2 * k], room[2 * k + 1])
            if room[k] == top:
                break
            room[k] = top
    return bins, offsets


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, group: int = 8192, seed: int = 1, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of docs(doc_id, text)."""
    pieces = written(pieces_of(docs, size, end_id, json_path, rank_path).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = pieces.filter(F.col("length") == size).select(*cols, (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < size)
    groups = max(1, math.ceil(rest.count() / group))
    room = 1 << 32  # of ids for each group; ids of whole sequences are odd, these are even

    def fill(key: tuple, x: pa.Table) -> pa.Table:
        x = x.sort_by("piece")
        bins, offsets = first_fit_decreasing(x["length"].to_numpy(), size)
        return x.select(cols).append_column("sequence_id", pa.array(2 * (key[0].as_py() * room + bins))).append_column("offset", pa.array(offsets))

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rest.withColumn("grp", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups))).groupBy("grp").applyInArrow(fill, kinds)
    return whole.unionByName(packed)
