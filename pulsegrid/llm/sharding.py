"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Documents with equal text form a group that stays in one shard. Sizes are summed per group before
anything moves; groups below 1/packets of all bytes are bundled by hash into at most `packets` packets, larger ones
(at most `packets` of them, by their size) stay single. Differencing then runs over these items, whose number is
bounded whatever the input, and the item-to-shard table is small enough to broadcast by construction.

Defined cases: null text counts as empty (size 1, crc32 of no bytes); null or repeated doc_ids and repeated rows are
each kept as a row of their own with a slot of its own; an empty table gives an empty result; other input columns are
ignored.
A text of any length is one size; items of equal size come in descending order of their numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import text_or_empty, written


def difference(sizes: list[int], n: int) -> list[int]:
    """The bin of each item: the two partial partitions of largest spread are combined, largest bin upon smallest."""
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s] + [0] * (n - 1), [[i]] + [[] for _ in range(n - 1)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, sums_a, bins_a = heapq.heappop(heap)
        _, _, sums_b, bins_b = heapq.heappop(heap)
        both = []
        for k in range(n):
            a, b = bins_a[k], bins_b[n - 1 - k]
            if len(a) < len(b):
                a, b = b, a
            a.extend(b)
            both.append((sums_a[k] + sums_b[n - 1 - k], a))
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], i, [x[0] for x in both], [x[1] for x in both]))
    out = [0] * len(sizes)
    for k, items in enumerate(heap[0][3] if heap else []):
        for i in items:
            out[i] = k
    return out


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, packets: int = 8192) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs(doc_id, text)."""
    text = text_or_empty()
    slim = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("grp"),
            F.spark_partition_id().alias("chunk"),
            F.monotonically_increasing_id().alias("pos"),
        ),
        "shard-rows",
    )
    total = slim.agg(F.sum("size")).first()[0] or 0
    big = F.col("bytes") * packets > F.lit(total)
    items = (
        slim.groupBy("grp")
        .agg(F.sum("size").alias("bytes"))
        .select(big.alias("big"), F.when(big, F.col("grp")).otherwise(F.pmod("grp", F.lit(packets))).alias("item"), "bytes")
        .groupBy("big", "item")
        .agg(F.sum("bytes").alias("bytes"))
    )

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            x = pd.concat(parts).sort_values(["bytes", "big", "item"], ascending=False, ignore_index=True)
            yield x.assign(dealt=difference(x["bytes"].tolist(), n_shards))[["big", "item", "dealt"]]

    dealt = written(items.repartition(1).mapInPandas(deal, "big boolean, item long, dealt int"), "shard-items")
    single = F.broadcast(dealt.filter("big").select(F.col("item").alias("grp"), F.col("dealt").alias("alone")))
    bundled = F.broadcast(dealt.filter("not big").select(F.col("item").alias("packet"), F.col("dealt").alias("together")))
    rows = (
        slim.withColumn("packet", F.pmod("grp", F.lit(packets)))
        .join(single, "grp", "left")
        .join(bundled, "packet", "left")
        .withColumn("shard", F.coalesce("alone", "together"))
    )
    before = (
        rows.groupBy("shard", "chunk")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n"))
        .drop("n")
    )
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("pos")) - 1
    return (
        rows.withColumn("within", within)
        .join(before, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
