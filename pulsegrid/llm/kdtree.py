"""Exact top-k by inner product: a KD-tree per shard, best-first traversal with box bounds and a propagated kth score.

Vectors become integers, floor(scale * x). The space is cut into cells at medians of the widest dimension of a bounded sample, and a cell's vectors into shards of up to about `shard` by hash
(a cell may hold any number of equal ones), so that a shard's vectors lie near each other. Each shard's vectors are split likewise, all of them, down to leaves with tight bounding boxes; its tree
is built once and written. The inner product of a query with anything in a box is at most sum(max(q * low, q * high)); boxes are opened in descending order of this bound until it falls below the query's kth score so far.

The search goes in two steps. First every query goes to the cell of the best bound, and there opens the best leaf of each shard; the kth best of all it found is a
lower bound of the true kth score. With this bound propagated, it goes to those cells whose box reaches it, where shards are searched exactly. A task holds one tree at a time, past which
the queries of its shard are streamed.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; only vectors of equal length meet; a query meets
every row but those of its own vec_id; ties go to the smaller vec_id; repeated rows are candidates each; null vec_ids are neither queries nor candidates;
without queries or candidates the result is empty; other input columns are ignored, whatever their names. Components must fit 2**31 after scaling.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import written

NO_FLOOR = -(1 << 62)


class Tree:
    """Nodes in arrays: box, children, and the leaf's slice of the reordered vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        order, self.low, self.high, self.child, self.span = np.argsort(ids, kind="stable"), [], [], [], []
        ids, vectors = ids[order], vectors[order]
        place = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            box = vectors[place[a:b]]
            k = len(self.low)
            self.low.append(box.min(axis=0))
            self.high.append(box.max(axis=0))
            self.child.append([-1, -1])
            self.span.append((a, b))
            if parent >= 0:
                self.child[parent][side] = k
            spread = self.high[k] - self.low[k]
            if b - a > leaf and spread.max() > 0:
                at = (b - a) // 2
                place[a:b] = place[a:b][np.argpartition(box[:, int(spread.argmax())], at, kind="introselect")]
                todo += [(a, a + at, k, 0), (a + at, b, k, 1)]
        for k, (a, b) in enumerate(self.span):
            if self.child[k][0] < 0:
                place[a:b] = np.sort(place[a:b])  # by id, so that ties fall to the smaller
        self.ids, self.vectors = ids[place], vectors[place]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """Of every node's box."""
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        return self.high @ up + self.low @ down

    def search(self, own: int, query: np.ndarray, k: int, floor: int, only_best: bool = False) -> list[tuple[int, int]]:
        """(score, -id) of the k best with a score of at least `floor`, descending; with only_best, those of the first leaf opened."""
        bounds, best = self.bounds(query).tolist(), []
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            kth = best[0][0] if len(best) == k else floor
            if -bound < max(kth, floor):
                break
            left, right = self.child[node]
            if left >= 0:
                heapq.heappush(todo, (-bounds[left], left))
                heapq.heappush(todo, (-bounds[right], right))
                continue
            a, b = self.span[node]
            scores = self.vectors[a:b] @ query
            ids = self.ids[a:b]
            good = np.flatnonzero((scores >= max(kth, floor)) & (ids != own))
            if len(good) > k:
                good = good[np.lexsort((ids[good], -scores[good]))[:k]]
            for i in good.tolist():
                item = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if only_best and best:
                break
        return sorted(best, reverse=True)


class Cells:
    """Space in cells: halved, again and again, at medians of the sample's widest dimension until there are about `parts`, or a cell's sample is one point."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.axis, self.value, self.child, self.count = [], [], [], 0
        todo = [(np.arange(len(sample)), parts, -1, 0)]
        while todo:
            some, n, parent, side = todo.pop()
            x = sample[some]
            spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
            if n <= 1 or not spread.any():
                at, self.count = -1 - self.count, self.count + 1
            else:
                at, axis = len(self.axis), int(spread.argmax())
                v = x[:, axis]
                middle = np.partition(v, len(v) // 2)[len(v) // 2]
                value = middle if (v < middle).any() else v[v > middle].min()
                self.axis.append(axis)
                self.value.append(value)
                self.child.append([0, 0])
                left = v < value
                todo += [(some[left], n // 2, at, 0), (some[~left], n - n // 2, at, 1)]
            if parent >= 0:
                self.child[parent][side] = at

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        axis, value, child = np.array(self.axis, np.int64), np.array(self.value), np.array(self.child, np.int64)
        at = np.full(len(x), 0 if self.axis else -1, np.int64)
        while (on := np.flatnonzero(at >= 0)).size:
            node = at[on]
            at[on] = child[node, (x[on, axis[node]] >= value[node]).astype(np.int64)]
        return -1 - at


def _array(blobs: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), -1).astype(kind)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard: int = 8192, batch: int = 2048, leaf: int = 128, sample: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, embedding) whose vec_id is divisible by `every`. Cells come from at most `sample` rows, 16 to a cell at least; routes of queries are made `batch` at a time."""
    spark = vectors.sparkSession

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.asarray(v, np.int64).tobytes())

    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(fine & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )
    rows = written(rows.select("vec_id", "dim", packed("v").alias("v"), F.array_max(F.transform("v", F.abs)).alias("top"), F.monotonically_increasing_id().alias("row")), "kd-rows")
    n, top, widest = rows.agg(F.count("*"), F.coalesce(F.max("top"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    kind = np.float64 if float(top) ** 2 * widest < 2.0**52 else np.int64  # inner products are exact in floats, which is faster, or else in integers
    shards = max(1, -(-n // shard))
    some = rows.orderBy(F.xxhash64("row", F.lit("cells")), "row").limit(sample).select("dim", "v").toPandas()
    cells = {d: Cells(_array(x["v"], kind), max(1, min(shards, len(x) // 16))) for d, x in some.groupby("dim")}

    def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for dim, same in x.groupby("dim"):
                yield same.assign(cell=cells[dim].of(_array(same["v"], kind)) if dim in cells else 0)[["vec_id", "dim", "v", "row", "cell"]]

    placed = written(rows.select("vec_id", "dim", "v", "row").mapInPandas(to_cells, "vec_id long, dim int, v binary, row long, cell long"), "kd-cells")
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))  # a row per cell

    def build(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(x["vec_id"].to_numpy(), _array(x["v"], kind), leaf)
        return pd.DataFrame([(*key, tree.low[0].astype("<i8").tobytes(), tree.high[0].astype("<i8").tobytes(), pickle.dumps(tree))], columns=["dim", "cell", "part", "low", "high", "tree"])

    key = ["dim", "cell", "part"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-2 * shards // 8))  # a few trees to a task
    dealt = placed.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), "shards").cast("int"))
    trees = written(dealt.select(*key, "vec_id", "v").repartition(tasks, *key).groupBy(*key).applyInPandas(build, "dim int, cell long, part int, low binary, high binary, tree binary"), "kd-trees")

    def around(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        low, high = (_array(x[c], np.int64) for c in ("low", "high"))
        return pd.DataFrame([(*key, int(x["part"].max()) + 1, low.min(axis=0).tobytes(), high.max(axis=0).tobytes())], columns=["dim", "cell", "parts", "low", "high"])

    boxes = trees.select(*key, "low", "high").groupBy("dim", "cell").applyInPandas(around, "dim int, cell long, parts int, low binary, high binary").toPandas()  # of at most sample / 16 cells, and one for each length that the sample missed
    known = {d: (x["cell"].to_numpy(), x["parts"].to_numpy(), _array(x["low"], kind), _array(x["high"], kind)) for d, x in boxes.groupby("dim")}
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"]).select("vec_id", "dim", "v", "row")
    none = F.lit(NO_FLOOR)  # in place of null, since pandas would make the column one of floats

    def meet(asked: DataFrame, only_best: bool) -> DataFrame:
        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, of = None, None
            for x in frames:
                out = []
                for *shard_, asks, blob, own, q, row, floor in x[[*key, "asks", "tree", "vec_id", "v", "row", "floor"]].itertuples(index=False, name=None):
                    if not asks:
                        tree, of = pickle.loads(blob), shard_
                    elif shard_ == of:  # else no vector fell into this part of its cell
                        out += [(own, row, -i, s) for s, i in tree.search(own, np.frombuffer(q, "<i8").astype(kind), k, floor, only_best)]
                yield pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"]).astype("int64")

        have = trees.select(*key, F.lit(False).alias("asks"), "tree", F.lit(0).cast("long").alias("vec_id"), F.lit(None).cast("binary").alias("v"), F.lit(0).cast("long").alias("row"), none.alias("floor"))
        sent = routes(asked, known, kind, only_best, batch).select(*key, F.lit(True).alias("asks"), F.lit(None).cast("binary").alias("tree"), "vec_id", "v", "row", "floor")
        both = have.unionByName(sent).repartition(tasks, *key).sortWithinPartitions(*key, "asks")
        return both.mapInPandas(search, "query_id long, row long, vec_id long, score long")

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    nearest = written(meet(queries.withColumn("floor", none), True), "kd-first")
    floors = nearest.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("row", F.col("score").alias("floor"))
    found = meet(queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", none)), False)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def routes(asked: DataFrame, known: dict[int, tuple], kind: type, only_best: bool, batch: int) -> DataFrame:
    """dim, cell, part, vec_id, v, row, floor: asked(vec_id, dim, v, row, floor) for all shards of the cells that a query must go to: the one of the best bound, or those whose bound reaches its floor.

    known: of each length the cells, their numbers of shards and their boxes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for dim, same in x.groupby("dim"):
                cells, parts, low, high = known[dim]
                for at in range(0, len(same), batch):
                    some = same.iloc[at : at + batch]
                    q = _array(some["v"], kind)
                    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    if only_best:
                        which, to = np.arange(len(some)), bounds.argmax(axis=1)
                    else:
                        which, to = np.nonzero(bounds >= some["floor"].to_numpy()[:, None])
                    times = parts[to]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    out = some.iloc[np.repeat(which, times)]
                    yield out.assign(cell=np.repeat(cells[to], times), part=part)[["dim", "cell", "part", "vec_id", "v", "row", "floor"]]

    return asked.select("vec_id", "dim", "v", "row", "floor").mapInPandas(run, "dim int, cell long, part int, vec_id long, v binary, row long, floor long")
