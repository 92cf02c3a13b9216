"""Hard negatives by a full sort of scores per anchor.

Rows are dealt into blocks and anchors into batches; a task meets one block with one batch, so neither the rows nor an anchor's scores are ever in one place. For each anchor
the block's integer scores are sorted whole, by score and id. The first pass reads the anchor's best rows of its own label from the sorted lists; what
the blocks found is merged to its positives. The second pass sorts again (the lists would take more room than the vectors) and, for each positive, finds the upper limit by
binary search and reads the first k rows of other labels from there down to the lower limit; the blocks' lists of at most k are merged.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; only vectors of equal length meet (empty ones with each other, at score 0);
a repeated row is another row, so it may be a positive of its twin; equal scores come by smaller vec_id; rows without a vec_id are no anchors but can be positives and negatives, after those with one;
an anchor without others of its label, or without rows between the limits, has no output, nor has an empty table; other input columns are ignored, whatever their names.
Components must fit 32 bits after scaling (else an error), scores 63 bits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import written
from pulsegrid.llm.vectors import exact_floats, packing, unpacked, whole

KIND = "<i4"
TOP = (1 << 63) - 1


def mine(
    embeddings: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = 16384, batch: int = 4096
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of embeddings(vec_id, label, embedding); anchors have a vec_id divisible by `every`.

    A negative's score is at least low and at most high hundredths of the positive's. A block holds up to about `block` rows, a batch up to about `batch` anchors; small tables are cut finer, for more tasks."""
    spark = embeddings.sparkSession
    rows = embeddings.filter(whole() & F.col("label").isNotNull()).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"),
        F.col("vec_id").isNull().alias("nameless"),
        F.col("label").cast("long").alias("label"),
        F.size("embedding").alias("dim"),
        packing(KIND)(F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))).alias("v"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "hard-rows")
    anchors = rows.filter(~F.col("nameless") & (F.col("vec_id") % every == 0))
    n, asked = rows.count(), anchors.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks, batches = max(1, -(-n // block), min(tasks, -(-n // 256))), max(1, -(-asked // batch))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    have = rows.select("*", dealt(blocks).alias("block"), spread(batches).alias("batch")).repartition(tasks, "block", "batch").groupBy("block", "batch")

    def meet(asking: DataFrame, read: Callable, columns: list[str]) -> DataFrame:
        """read(anchor, scores, rows), both in order of score, for every anchor and block."""

        def search(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            out, block = [], block.sort_values(["nameless", "vec_id", "row"])  # what is sorted by score from here on has its ties in order
            for dim, mine in ask.groupby("dim"):
                near = block[block["dim"] == dim]
                if not len(near):
                    continue
                x, q = exact_floats(unpacked(near["v"], KIND), unpacked(mine["v"], KIND))
                lists = {c: near[c].to_numpy() for c in ("vec_id", "nameless", "label", "row")}
                for anchor, vector in zip(mine.to_dict("records"), q, strict=True):
                    scores = (x @ vector).astype(np.int64)
                    order = np.lexsort((np.arange(len(scores)), -scores))
                    out += read(anchor, scores[order], {c: v[order] for c, v in lists.items()})
            return pd.DataFrame(out, columns=columns).astype({c: "bool" if c == "nameless" else "int64" for c in columns})

        asks = asking.select("*", dealt(batches).alias("batch"), spread(blocks).alias("block")).repartition(tasks, "block", "batch").groupBy("block", "batch")
        return have.cogroup(asks).applyInPandas(search, ", ".join(f"{c} {'boolean' if c == 'nameless' else 'long'}" for c in columns))

    def same_label(anchor: dict, scores: np.ndarray, at: dict) -> list[tuple]:
        good = np.flatnonzero((at["label"] == anchor["label"]) & (at["row"] != anchor["row"]))[:positives]
        return [(anchor["row"], at["vec_id"][i], at["nameless"][i], at["row"][i], scores[i]) for i in good]

    def between(anchor: dict, scores: np.ndarray, at: dict) -> list[tuple]:
        out, other = [], at["label"] != anchor["label"]
        for place, p in enumerate(map(int, anchor["wanted"])):
            most, least = min(high * p // 100, TOP), max(-(-low * p // 100), -TOP)
            a, b = np.searchsorted(-scores, -most, "left"), np.searchsorted(-scores, -least, "right")
            good = a + np.flatnonzero(other[a : max(a, b)])[:k]
            out += [(anchor["row"], place, at["vec_id"][i], at["nameless"][i], at["row"][i], scores[i]) for i in good]
        return out

    in_order = [F.desc("score"), F.col("nameless"), F.col("vec_id"), F.col("row")]
    best = Window.partitionBy("anchor").orderBy(*in_order)
    found = meet(anchors, same_label, ["anchor", "vec_id", "nameless", "row", "score"]).withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < positives)
    found = written(found.withColumn("id", F.when(~F.col("nameless"), F.col("vec_id"))), "hard-positives")
    lists = found.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "score")))["score"].alias("wanted"))  # at most `positives` a list
    asking = anchors.join(lists, "row")
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])  # columns of their own beside those of all rows
    negatives = meet(asking, between, ["anchor", "place", "vec_id", "nameless", "row", "score"])
    nth = Window.partitionBy("anchor", "place").orderBy(*in_order)
    negatives = negatives.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
    named = found.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return negatives.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), F.when(~F.col("nameless"), F.col("vec_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def with_some_relabelled(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose vec_id is divisible by `every` get the next label."""
    label = F.col("label").cast("long")
    return embeddings.withColumn("label", F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label))
