"""Approximate nearest neighbours by cross-polytope hashing, with cosines worked out exactly for all candidates.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; a vector's hash in a table is the signed axis nearest to it after one rotation, and of a second
rotation's first few axes where the table of vectors is large, so that a bucket holds about `bucket` rows at any size. A query probes the (table, bucket) pairs
whose axes it lies nearest to, over all tables in one order. How many it probes is fitted: at most `sample` queries are compared with all rows, and the
number of probes is the least that finds `aim` of their true neighbours. Every row is in every table, whatever the sample.

Equal vectors are one candidate, which carries its k + 1 smallest rows (no more can be among a query's k nearest), and equal queries search once. Buckets over `chunk` vectors are cut
into chunks, and a probe goes to each of them. A query that has fewer than k rows from its probes searches all buckets of one table, that is all rows.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; only vectors of equal length meet; a query's own row is no candidate, but a repeated row
is one of its twin's; ties go to the smaller vec_id; rows without a vec_id are no queries but can be neighbours, after those with one; repeated query rows have a
result each; an empty table gives an empty result; other input columns are ignored, whatever their names. Components are scaled by powers of two before squaring, which is exact, so that nothing overflows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import written
from pulsegrid.llm.vectors import packing, unpacked, whole


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row, whose length is a power of two, scaled to keep lengths."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


class Tables:
    """The hash functions: for each table two rotations of `width` axes, the second one cut to `second` of them (0: not used)."""

    def __init__(self, width: int, tables: int, second: int, seed: int):
        self.width, self.tables, self.second = width, tables, second
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, width))
        self.buckets = 2 * width * max(1, 2 * second)

    def axes(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        """[rows, axes]: how far each vector reaches along each signed axis of a rotation."""
        for signs in self.signs[table, which]:
            x = hadamard(x * signs)
        x = x if which == 0 else x[:, : self.second]
        return np.concatenate([x, -x], axis=1)

    def reach(self, x: np.ndarray, table: int) -> np.ndarray:
        """[rows, buckets]: along the axes of each bucket together."""
        first = self.axes(x, table, 0)
        return first if not self.second else (first[:, :, None] + self.axes(x, table, 1)[:, None, :]).reshape(len(x), -1)

    def buckets_of(self, x: np.ndarray) -> np.ndarray:
        """[rows, tables]: the bucket of each vector in each table, numbered over all tables."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            b = self.axes(x, t, 0).argmax(axis=1)
            out[:, t] = t * self.buckets + (b * 2 * self.second + self.axes(x, t, 1).argmax(axis=1) if self.second else b)
        return out

    def probes_of(self, x: np.ndarray, count: int | None = None) -> np.ndarray:
        """[rows, count]: the buckets of all tables that each vector reaches farthest into, in descending order."""
        reach = np.concatenate([self.reach(x, t) for t in range(self.tables)], axis=1)
        if count is not None and count < reach.shape[1]:
            near = np.argpartition(-reach, count - 1, axis=1)[:, :count]
            return np.take_along_axis(near, np.argsort(-np.take_along_axis(reach, near, axis=1), axis=1, kind="stable"), axis=1)
        return np.argsort(-reach, axis=1, kind="stable")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, with their largest components between a half and one."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def units(x: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors, with zeros up to the width."""
    x = scaled(x)
    return np.pad(x / lengths(x)[:, None], ((0, 0), (0, width - x.shape[1])))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of a query with every row, each summed in the same order, wherever the row stands (a matrix product may not do that)."""
    return (x * q).sum(axis=1) / (lengths(x) * np.sqrt((q * q).sum()))


def nearest(
    embeddings: DataFrame, k: int = 5, every: int = 50, tables: int = 8, bucket: int = 512, chunk: int = 4096, aim: float = 0.95, sample: int = 256, probes: int | None = None, seed: int = 0
) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of embeddings(vec_id, embedding) nearest to each row whose vec_id is divisible by `every`.

    With `probes` their number isn't fitted."""
    spark, kind = embeddings.sparkSession, embeddings.schema["embedding"].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    fine = whole() & (F.size("embedding") > 0) & F.exists("embedding", lambda x: x != 0)
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))  # no zeros below zero, so that equal vectors have equal bytes
    rows = embeddings.filter(fine).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("nameless"), F.size("embedding").alias("dim"), packing(dtype)(plain).alias("v"), F.monotonically_increasing_id().alias("row")
    )
    rows = written(rows, "polytope-rows")
    # A row per vector: its smallest rows, and whether any of its rows asks. Both come from rank-limited windows, which are cut down before anything moves.
    by_id = Window.partitionBy("v").orderBy("nameless", "vec_id", "row")
    few = rows.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1)
    asks = ~F.col("nameless") & (F.col("vec_id") % every == 0)
    index = few.groupBy("v").agg(F.first("dim").alias("dim"), F.min("row").alias("rep"), F.array_sort(F.collect_list(F.struct("nameless", "vec_id", "row"))).alias("members"))
    index = written(index, "polytope-index")
    queries = rows.filter(asks).join(index.select("v", "rep"), "v").select("vec_id", "row", "rep")
    queries = written(queries, "polytope-queries")
    asking = written(index.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "dim", "v"), "polytope-asking")
    n, width = index.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    width = 1 << (width - 1).bit_length()
    second = 0
    while n > 2 * bucket * width * max(1, 2 * second) and second < width:  # one axis more halves a bucket, about
        second = max(1, 2 * second)
    hashes = Tables(width, tables, second, seed)
    if probes is None:
        probes = fitted_probes(index, asking, hashes, dtype, k, aim, sample)

    def by_length(x: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for _, same in x.groupby("dim"):
            yield same, unpacked(same["v"], dtype)

    def to_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for same, v in by_length(x):
                yield pd.DataFrame({"rep": same["rep"], "buckets": list(hashes.buckets_of(units(v, width)))})

    def to_probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for same, v in by_length(x):
                step = max(1, (1 << 21) // (tables * hashes.buckets))
                for at in range(0, len(same), step):
                    yield pd.DataFrame({"rep": same["rep"].iloc[at : at + step], "buckets": list(hashes.probes_of(units(v[at : at + step], width), probes))})

    def search(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, mine in ask.groupby("dim"):
            near = have[have["dim"] == dim].sort_values(["nameless", "vec_id", "rep"])
            if not len(near):
                continue
            x, q, reps = scaled(unpacked(near["v"], dtype)), scaled(unpacked(mine["v"], dtype)), near["rep"].to_numpy()
            rough = (q / lengths(q)[:, None]) @ (x / lengths(x)[:, None]).T
            for own, vector, close in zip(mine["rep"].tolist(), q, rough, strict=True):
                good = np.flatnonzero(close >= np.partition(close, -min(k + 1, len(close)))[-min(k + 1, len(close))] - 1e-9)
                exact = cosines(x[good], vector)
                best = np.argsort(-exact, kind="stable")[: k + 1]
                out += [(own, reps[good[i]], exact[i]) for i in best]
        return pd.DataFrame(out, columns=["asking", "rep", "score"]).astype({"asking": "int64", "rep": "int64", "score": "float64"})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = index.select("rep", "dim", "v").mapInPandas(to_buckets, "rep long, buckets array<long>").select("rep", F.explode("buckets").alias("bucket"))
    placed = written(placed, "polytope-buckets")
    first = F.element_at("members", 1)
    vectors = index.select("rep", "dim", "v", first["nameless"].alias("nameless"), first["vec_id"].alias("vec_id"))
    parts = lambda n: F.ceil(n / chunk).cast("int")

    def met(probed: DataFrame) -> DataFrame:
        """asking, rep, score: the best k + 1 vectors of every (query, bucket) of probed(rep, bucket). A bucket of over `chunk` vectors, or asked for by more queries, is cut both ways."""
        sizes = placed.select("bucket", F.lit(1).alias("n"), F.lit(0).alias("m")).unionAll(probed.select("bucket", F.lit(0), F.lit(1))).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        cut = written(sizes.filter((F.col("n") > chunk) | (F.col("m") > chunk)).select("bucket", F.greatest(parts(F.col("n")), F.lit(1)).alias("chunks"), F.greatest(parts(F.col("m")), F.lit(1)).alias("batches")), "polytope-cut")
        one_of = lambda c: F.pmod(F.xxhash64("rep"), F.coalesce(c, F.lit(1))).cast("int")
        all_of = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
        have = placed.join(cut, "bucket", "left").select("bucket", "rep", one_of("chunks").alias("chunk"), all_of("batches").alias("batch")).join(vectors, "rep")
        to = probed.join(cut, "bucket", "left").select("bucket", "rep", one_of("batches").alias("batch"), all_of("chunks").alias("chunk")).join(asking, "rep")
        left, right = (x.repartition(tasks, "bucket", "chunk", "batch").groupBy("bucket", "chunk", "batch") for x in (have, to))
        return left.cogroup(right).applyInPandas(search, "asking long, rep long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        """The k nearest rows of every query row."""
        best = Window.partitionBy("asking").orderBy(F.desc("score"), "nameless", "vec_id", "rep")
        found = found.dropDuplicates(["asking", "rep"]).join(vectors.select("rep", "nameless", "vec_id"), "rep")
        found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).select("asking", "rep", "score")
        members = found.join(index.select("rep", "members"), "rep").select("asking", "score", F.explode("members").alias("m")).select("asking", "score", "m.*")
        lists = members.groupBy("asking").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "nameless", "vec_id", "row"))).alias("list"))  # at most (k + 1) ** 2
        rest = F.slice(F.filter("list", lambda m: m["row"] != F.col("own")), 1, k)
        one = queries.select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), F.col("rep").alias("asking")).join(lists, "asking", "left")
        return one.select("query_id", "own", "asking", F.coalesce(rest, F.expr("array()").cast(lists.schema["list"].dataType)).alias("list"))

    probed = asking.mapInPandas(to_probes, "rep long, buckets array<long>").select("rep", F.explode("buckets").alias("bucket"))
    once = written(ranked(met(written(probed, "polytope-probes"))), "polytope-found")
    short = once.filter(F.size("list") < k).select(F.col("asking").alias("rep")).distinct()
    if not short.isEmpty():
        rest = ranked(met(short.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(hashes.buckets - 1)).cast("array<long>")))))  # the first table's buckets hold every vector once
        once = once.filter(F.size("list") >= k).unionByName(rest.join(short.select(F.col("rep").alias("asking")), "asking", "left_semi"))
    out = once.select("query_id", F.posexplode("list").alias("place", "m"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.when(~F.col("m.nameless"), F.col("m.vec_id")).alias("vec_id"), (-F.col("m.down")).alias("score"))


def fitted_probes(index: DataFrame, asking: DataFrame, hashes: Tables, dtype: str, k: int, aim: float, sample: int) -> int:
    """The least number of probes that finds `aim` of the k nearest other vectors of at most `sample` queries, which are compared with all vectors.

    The sample goes to the tasks in the function; what comes back is sample * k buckets' places."""
    picked = asking.orderBy(F.xxhash64("rep", F.lit("sample")), "rep").limit(sample).collect()
    everything = hashes.tables * hashes.buckets
    if not picked:
        return everything
    own = {d: [r for r in picked if r["dim"] == d] for d in sorted({r["dim"] for r in picked})}

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for x in frames:
            for dim, same in x.groupby("dim"):
                if dim not in own:
                    continue
                v, q = (units(np.stack([np.frombuffer(b, dtype) for b in blobs]), hashes.width) for blobs in (same["v"], [r["v"] for r in own[dim]]))
                reps = same["rep"].to_numpy()
                for r, scores in zip(own[dim], q @ v.T, strict=True):
                    scores = np.where(reps == r["rep"], -np.inf, scores)
                    s, i, b = best.get(r["rep"], (np.zeros(0), np.zeros(0, np.int64), []))
                    top = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
                    s, i, b = np.concatenate([s, scores[top]]), np.concatenate([i, reps[top]]), b + [same["v"].iloc[t] for t in top]
                    keep = np.lexsort((i, -s))[:k]
                    best[r["rep"]] = s[keep], i[keep], [b[t] for t in keep]
        rows = [(a, r, c, v) for a, (s, i, b) in best.items() for c, r, v in zip(s, i, b, strict=True) if np.isfinite(c)]
        yield pd.DataFrame(rows, columns=["asking", "rep", "score", "v"])

    nearest_of = Window.partitionBy("asking").orderBy(F.desc("score"), "rep")
    found = index.select("rep", "dim", "v").mapInPandas(compare, "asking long, rep long, score double, v binary").withColumn("place", F.row_number().over(nearest_of)).filter(F.col("place") <= k).select("asking", "v").collect()
    at, needed = {r["rep"]: r["v"] for r in picked}, []
    for f in found:
        q, v = (units(np.frombuffer(b, dtype)[None], hashes.width) for b in (at[f["asking"]], f["v"]))
        place = np.empty(everything, np.int64)
        place[hashes.probes_of(q)[0]] = np.arange(everything)
        needed.append(int(place[hashes.buckets_of(v)[0]].min()) + 1)
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))) - 1)] if needed else everything
