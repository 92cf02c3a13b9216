"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of the mix's size, stopped at `most` times its own size (the excess goes to the other
sources by weight). Each of its documents should then be copied target / source_size times. The whole part is taken; the fractional
parts are rounded in pairs: mass moves at random between the two sides, in units of words, so that the expected copies and the
pair's words stay as they are, until one side is integral. Within a bounded bucket of a source a document is paired with
the pool of the smaller ones, which share one fraction. Each bucket leaves one fractional document at most; these are rounded against each other in a reduction tree, level by level; the last
one of a source takes the nearer count.

Random numbers depend on the seed, the bucket and the order by doc_id and size only, so reruns agree however rows are laid out.

Defined cases: null text has size 0 and is never taken, nor is any document without words; a null source is a source of its own, the
last in order; repeated rows are documents of their own; an empty table gives an empty result; other input columns are
ignored by mix() and kept by mixed_rows().
A very long text is one document of its size; ties of size are broken alike in every run.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import SPACE, row_key, take_rows, text_or_empty, written

WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """sources(source, source_size) with place and target. min(cap, level * weight) summed over the sources gives the mix's size;
    the sources at their cap are those of the smallest cap / weight. Taking the first k of that order as capped gives a level for each k, and
    the largest of them is the true one: it rises while one more source is over its cap and falls after."""
    first = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    every = Window.partitionBy()
    up_to = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    x = (
        sources.withColumn("place", F.row_number().over(first) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("wanted", share * F.sum("source_size").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
        .withColumn("level", (F.col("wanted") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("level", F.max("level").over(every))
    )
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return x.select("source", "source_size", "place", target.alias("target"))


def pivot(sizes: np.ndarray, fractions: np.ndarray, seed: list[int]) -> tuple[np.ndarray, int, float]:
    """0 or 1 for each document, and the place and fraction of the one left (-1: none). sum(size * fraction) stays as it is."""
    took = (fractions >= 1).astype(np.int32)
    open_at = np.flatnonzero((fractions > 0) & (fractions < 1) & (sizes > 0))
    draws = np.random.Generator(np.random.PCG64(seed)).random(len(open_at)).tolist()
    s, p = sizes.tolist(), fractions.tolist()
    left, q = -1, 0.0
    for i, u in zip(open_at.tolist(), draws, strict=True):
        if left < 0:
            left, q = i, p[i]
            continue
        a, b = s[left], s[i]
        up = min((1 - q) * a, p[i] * b)  # words that may move from i to the one left over
        down = min(q * a, (1 - p[i]) * b)
        move = up if u * (up + down) < down else -down
        q, r = q + move / a, p[i] - move / b
        q, r = (round(q) if abs(q - round(q)) < 1e-12 else q), (round(r) if abs(r - round(r)) < 1e-12 else r)
        if 0 < q < 1 and 0 < r < 1:  # neither exactly integral for want of precision: the nearer one is
            if min(q, 1 - q) < min(r, 1 - r):
                q = round(q)
            else:
                r = round(r)
        if 0 < q < 1:
            took[i] = int(r)
            continue
        took[left] = int(q)
        left, q = (i, r) if 0 < r < 1 else (-1, 0.0)
        if left < 0:
            took[i] = int(r)
    return took, left, q


def pivot_pool(sizes: np.ndarray, p: float, seed: list[int]) -> tuple[np.ndarray, int, float]:
    """As pivot(), for documents that share one fraction p, by descending size.

    Each document is paired with the pool of all after it, whose common fraction gives or takes the words that move. Large ones are settled
    while the pool can still make up for them, so what is left over in the end is small."""
    took = np.zeros(len(sizes), np.int32)
    s = sizes[sizes > 0].tolist()
    draws = np.random.Generator(np.random.PCG64(seed)).random(len(s)).tolist()
    rest = sum(s)
    for i, (a, u) in enumerate(zip(s, draws, strict=True)):
        rest -= a
        if p < 1e-12 or p > 1 - 1e-12:
            took[i : len(s)] = round(p)
            break
        if not rest:
            return took, i, p
        up, down = min((1 - p) * a, p * rest), min(p * a, (1 - p) * rest)
        move = up if u * (up + down) < down else -down
        q, p = p + move / a, p - move / rest
        if 1e-12 < q < 1 - 1e-12:  # the pool is integral, this document is not
            took[i + 1 : len(s)] = round(p)
            return took, i, q
        took[i] = round(q)
    return took, -1, 0.0


def mix_rows(rows: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, bucket: int = 2048, fan_in: int = 256, seed: int = 3) -> DataFrame:
    """rows(row_key..., source, size) with source_size, target, copies. rows must have doc_id; other columns are kept."""
    sums = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "mix-sources")
    goal = targets(sums.select("source", "source_size"), share, most, weights)
    n_of = sums.select(F.col("source").alias("s2"), "n_rows")
    goal = written(
        goal.join(n_of, goal["source"].eqNullSafe(n_of["s2"])).select(
            "source", "source_size", "place", "target", F.ceil(F.col("n_rows") / bucket).alias("n_buckets"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("want")
        ),
        "mix-targets",
    )
    g = goal.withColumnRenamed("source", "s2")
    joined = rows.join(g, rows["source"].eqNullSafe(g["s2"])).drop("s2").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("n_buckets")))
    names = joined.columns
    shape = joined.withColumn("copies", F.lit(0)).withColumn("left", F.lit(0.0)).select(*names, "copies", "left").schema

    order = [(c, "descending") for c in ("size", "doc_id", *(n for n in names if n.startswith("_pg_")))]

    def level_0(key: tuple, x: pa.Table) -> pa.Table:
        x = x.sort_by(order)
        sizes, want = x["size"].to_numpy(), x["want"][0].as_py()  # one for all documents of a source
        whole = math.floor(want + 1e-12)
        took, left, q = pivot_pool(sizes, min(max(want - whole, 0.0), 1.0), [seed, 0, key[0].as_py(), key[1].as_py()])
        rest = np.full(len(sizes), -1.0)
        if left >= 0:
            rest[left] = q
        copies = np.where(sizes > 0, whole + took, 0).astype(np.int32)
        return x.select(names).append_column("copies", pa.array(copies)).append_column("left", pa.array(rest))

    first = written(joined.groupBy("place", "bucket").applyInArrow(level_0, shape), "mix-first")
    level, width = 1, goal.agg(F.max("n_buckets")).first()[0] or 1
    rest = first.filter("left >= 0").select("place", "bucket", "size", "left", F.col("bucket").alias("node"))
    done = None

    def higher(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["size", "bucket"], ascending=False, ignore_index=True)
        took, left, q = pivot(x["size"].to_numpy(), x["left"].to_numpy(), [seed, 1, *map(int, key)])
        rest = np.full(len(x), -1.0)
        if left >= 0:
            rest[left] = q
        return x.assign(took=took, left=rest)[["place", "bucket", "size", "node", "took", "left"]]

    while True:
        rest = rest.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        x = written(rest.groupBy("place", "node").applyInPandas(higher, "place int, bucket long, size long, node long, took int, left double"), f"mix-level-{level}")
        settled = x.filter("left < 0").select("place", "bucket", "took")
        done = settled if done is None else done.unionByName(settled)
        rest = x.filter("left >= 0").select("place", "bucket", "size", "left", "node")
        width, level = -(-width // fan_in), level + 1
        if width <= 1:
            break
    last = F.when(F.col("left") >= 0.5, 1).otherwise(0)  # one document of each source at most: the nearer count
    done = done.unionByName(rest.select("place", "bucket", last.cast("int").alias("took")))
    done = done.select(F.col("place").alias("p2"), F.col("bucket").alias("b2"), "took")
    out = first.join(done, (F.col("left") >= 0) & (F.col("place") == F.col("p2")) & (F.col("bucket") == F.col("b2")), "left")
    return out.withColumn("copies", F.col("copies") + F.coalesce("took", F.lit(0))).drop("p2", "b2", "took", "left", "place", "bucket", "n_buckets", "want")


def n_words(text: str = "text"):
    return F.regexp_count(text_or_empty(text), F.lit(f"[^{SPACE}]+")).cast("long")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs(doc_id, text, source)."""
    rows = written(docs.select("doc_id", "source", n_words().alias("size")), "mix-rows")
    return mix_rows(rows, **how).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) in as many copies as the mix takes of them."""
    rows = written(docs.select("doc_id", "source", n_words().alias("size"), *row_key(docs)), "mix-rows")
    copies = mix_rows(rows, **how).groupBy("_pg_k1", "_pg_k2").agg(F.sum("copies").alias("_pg_copies"))
    return take_rows(docs, copies)
