"""Connected components of an edge table by alternating large-star and small-star steps.

Defined cases: loops and repeated edges count as none and one; the order of an edge's ends doesn't matter; null ends don't occur (nodes are hashes);
without edges there are no rows; other columns are ignored. A round's table is deleted when the next one stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop, written


SALTS = 4


def _join_least(rows: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """rows with m of least(node, m) for their key. A hot node's rows are dealt over several tasks, and since both sides are
    shuffled for this join alone, adaptive execution may split them further."""
    many = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int"))
    return salted.join(many, (salted[key] == many["node"]) & (salted["salt"] == many["salt"])).select("a", "b", "m")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node links its larger neighbours to its least neighbour or itself; small: its smaller neighbours and itself.

    edges(a, b) have a > b."""
    if large:
        # A node that is some edge's b counts itself, so one aggregate has what every b hands to its larger neighbours.
        seen = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("m")), F.struct(F.col("b").alias("node"), F.col("b").alias("m")))).alias("x")).select("x.*")
        return _join_least(edges, "b", seen.groupBy("node").agg(F.min("m").alias("m"))).select("a", F.col("m").alias("b"))
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    return _join_least(edges, "a", least).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether edges(a, b), distinct and a > b, are stars already: every a has one b, and no b is an a. Each b is then the least node of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    ups = ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down"))
    return ups.filter("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) of every node of edges(a, b) that isn't its own root."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, now = now, written(_stars(_stars(now, True), False).filter("a <> b").distinct(), "stars")
        drop(before)
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
