"""Linking labels across frames: overlaps, candidate scores, merge resolution, lineages, filters and edits.

cells(frame, label, com_y, com_x, area[, angle, ar]) are vertices, edges(frame, label, next_label, score) link frame to frame + 1 unless they
carry next_frame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.sources.saved import drop, written


def empty_frames(pixels: DataFrame) -> DataFrame:
    """frame: those without a labelled pixel, which can't be tracked through."""
    return pixels.groupBy("frame").agg(F.max(F.when(F.col("label") != 0, 1)).alias("some")).filter("some IS NULL").select("frame")


def overlaps(pixels: DataFrame) -> DataFrame:
    """frame, label, next_label, common: pixels that two labels of successive frames share.

    One equi-join on (frame, y, x); both sides are partitioned alike."""
    now = pixels.filter("label <> 0").select("frame", "y", "x", "label")
    after = now.select((F.col("frame") - 1).alias("frame"), "y", "x", F.col("label").alias("next_label"))
    return now.join(after, ["frame", "y", "x"]).groupBy("frame", "label", "next_label").agg(F.count("*").alias("common"))


def forward(common: DataFrame, cells: DataFrame) -> DataFrame:
    """frame, label, next_label, frac of the label's own area; cells of one pixel overlap nothing."""
    return common.join(cells.select("frame", "label", "area"), ["frame", "label"]).filter("area > 1").select("frame", "label", "next_label", (F.col("common") / F.col("area")).alias("frac"))


def backward(common: DataFrame, cells: DataFrame) -> DataFrame:
    """frame, label (of the later cell), prev_label, frac of the later cell's area."""
    later = common.select((F.col("frame") + 1).alias("frame"), F.col("next_label").alias("label"), F.col("label").alias("prev_label"), "common")
    return later.join(cells.select("frame", "label", "area"), ["frame", "label"]).select("frame", "label", "prev_label", (F.col("common") / F.col("area")).alias("frac"))


def successive(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """pairs(frame, label, next_label, …) with the cells' columns, and the next cell's with the prefix next_."""
    after = cells.select((F.col("frame") - 1).alias("frame"), *[F.col(c).alias(f"next_{c}") for c in cells.columns if c != "frame"])
    return pairs.join(cells, ["frame", "label"]).join(after, ["frame", "next_label"])


def frame_pairs(cells: DataFrame) -> DataFrame:
    """Every label of a frame with every one of the next: frame, label, next_label. The matrices of old; scoring needs overlapping pairs only."""
    after = cells.select((F.col("frame") - 1).alias("frame"), F.col("label").alias("next_label"))
    return cells.select("frame", "label").join(after, "frame")


def distance() -> Column:
    return F.sqrt(F.pow(F.col("com_y") - F.col("next_com_y"), 2.0) + F.pow(F.col("com_x") - F.col("next_com_x"), 2.0))


def inverse_distance() -> Column:
    """min(1, 1 / d), a distance of 0 counting as 1e-4."""
    return F.least(F.lit(1.0), 1.0 / F.when(distance() == 0, 1e-4).otherwise(distance()))


def ratio_score(name: str) -> Column:
    """The smaller of two values over the larger; 0 where the first is 0."""
    a, b = F.col(name).cast("double"), F.col(f"next_{name}").cast("double")
    return F.when(a == 0, 0.0).when(b / a > 1, a / b).otherwise(b / a)


def candidates(frac: DataFrame, cells: DataFrame, least: float = 0.10, weights: tuple[float, ...] = (1, 1, 1, 1, 1)) -> DataFrame:
    """frame, label, next_label, frac, score of pairs that overlap by more than `least`.

    Terms: overlap, its double up to 1, angle, area, its double up to 1, aspect ratio, its double up to 1, nearness up to 1. weights
    are those of nearness, overlap, angle, area, aspect ratio. Missing angle or aspect ratio count 0."""
    near, over, turn, size, aspect = map(float, weights)
    x = successive(frac.filter(F.col("frac") > least), cells)
    zero = F.lit(0.0)
    angle = turn * (ratio_score("angle") if "angle" in cells.columns else zero)
    ar = aspect * (ratio_score("ar") if "ar" in cells.columns else zero)
    area, share = size * ratio_score("area"), over * F.col("frac")
    double = lambda c: F.least(F.lit(1.0), 2 * c)
    total = share + double(share) + angle + area + double(area) + ar + double(ar) + F.least(F.lit(1.0), near * inverse_distance())
    return x.select("frame", "label", "next_label", "frac", (total / (sum(map(float, weights)) + size + aspect + over)).alias("score"))


def threshold(scored: DataFrame, least: float = 0.3) -> DataFrame:
    return scored.filter(F.col("score") > least)


def best_parents(edges: DataFrame, back: DataFrame) -> DataFrame:
    """Of a cell's several parents the one that overlaps it most, among all labels before (the smallest of equals); if that one is no
    parent, none stays. Single parents stay."""
    best = back.groupBy(F.col("frame"), F.col("label")).agg(F.min_by("prev_label", F.struct(-F.col("frac"), "prev_label")).alias("best"))
    best = best.select((F.col("frame") - 1).alias("frame"), F.col("label").alias("next_label"), "best")
    parents = edges.groupBy("frame", "next_label").agg(F.count("*").alias("parents"))
    x = edges.join(parents, ["frame", "next_label"]).join(best, ["frame", "next_label"], "left")
    return x.filter((F.col("parents") == 1) | (F.col("label") == F.col("best"))).select(edges.columns)


def network(pixels: DataFrame, cells: DataFrame, least: float = 0.10, score: float = 0.3, common: DataFrame | None = None) -> DataFrame:
    """The edges of the forest: overlaps, scores, threshold and best parents in one plan. Overlaps are read twice; large ones may be given as written (a row per pair of cells that share pixels)."""
    common = overlaps(pixels) if common is None else common
    return best_parents(threshold(candidates(forward(common, cells), cells, least), score), backward(common, cells))


def relinked(pixels: DataFrame, cells: DataFrame, edges: DataFrame, touched: list[int], shapes: Callable[[DataFrame], DataFrame], least: float = 0.10, score: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """cells and edges after the pixels of some frames were edited, as if all were made anew: the edited frames' cells by shapes(pixels), and the edges into and out of these frames.

    Only those frames and their neighbours are read of the pixels, which as files should be partitioned by frame."""
    near = sorted({f + k for f in touched for k in (-1, 0, 1)})
    pairs = sorted({f + k for f in touched for k in (-1, 0)})
    now = cells.filter(~F.col("frame").isin(touched)).unionByName(shapes(pixels.filter(F.col("frame").isin(touched))).select(cells.columns))
    part = network(pixels.filter(F.col("frame").isin(near)), now.filter(F.col("frame").isin(near)), least, score)
    return now, edges.filter(~F.col("frame").isin(pairs)).unionByName(part.filter(F.col("frame").isin(pairs)).select(edges.columns))


def next_frame(edges: DataFrame) -> Column:
    return F.col("next_frame") if "next_frame" in edges.columns else F.col("frame") + 1


def in_order(cells: DataFrame, name: str) -> DataFrame:
    """cells with their number from 0 in order of frame and label. They are ranked within frames; only a row per frame passes through one task."""
    up_to = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = cells.groupBy("frame").agg(F.count("*").alias("_n")).select("frame", (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"))
    x = cells.withColumn(name, F.row_number().over(Window.partitionBy("frame").orderBy("label")) - 1).join(before, "frame")
    return x.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before")


def roots(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """frame, label, track: cells without a parent, named Cell_i in order of frame and label."""
    child = edges.select(next_frame(edges).alias("frame"), F.col("next_label").alias("label")).distinct()
    x = in_order(cells.select("frame", "label").join(child, ["frame", "label"], "left_anti"), "k")
    return x.select("frame", "label", F.concat(F.lit("Cell_"), F.col("k").cast("string")).alias("track"))


def _ranked(edges: DataFrame) -> DataFrame:
    """Edges with the child's place among its siblings and their number; added links come after found ones."""
    order = ["added", "next_frame", "next_label"] if "added" in edges.columns else ["next_label"]
    x = edges.withColumn("next_frame", next_frame(edges))
    w = Window.partitionBy("frame", "label")
    return x.select("frame", "label", "next_frame", "next_label", (F.row_number().over(w.orderBy(*order)) - 1).alias("place"), F.count("*").over(w).alias("siblings"))


def lineages(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """track, frame, label, path: a track goes on while a cell has one child; at a division child i starts track_i. path orders the
    cells of a frame as a depth-first walk meets them: a digit for most divisions, as names and paths are as long as lineages are deep.

    Each cell points to its parent and holds its own piece of the name; joining the pointers with themselves doubles the
    reach, so the rounds are as many as the longest lineage has binary digits, whatever the recursion limits."""
    cells, edges = written(cells.select("frame", "label"), "cells"), written(edges, "links")  # each is read several times
    tops = roots(cells, edges)
    none = F.lit(None).cast("long")
    first = tops.select(*[F.col(c).cast("long").alias(c) for c in ("frame", "label")], none.alias("up_frame"), none.alias("up_label"), "track", F.lpad(F.element_at(F.split("track", "_"), 2), 9, "0").alias("path"))
    alone = F.col("siblings") == 1
    steps = _ranked(edges).select(
        F.col("next_frame").cast("long").alias("frame"),
        F.col("next_label").cast("long").alias("label"),
        F.col("frame").cast("long").alias("up_frame"),
        F.col("label").cast("long").alias("up_label"),
        F.when(alone, "").otherwise(F.concat(F.lit("_"), F.col("place").cast("string"))).alias("track"),
        F.when(alone, "").when(F.col("place") < 9, F.col("place").cast("string")).otherwise(F.concat(F.lit("9"), F.lpad(F.col("place").cast("string"), 10, "0"))).alias("path"),
    )
    now, settled = written(first.unionByName(steps), "lineage"), []
    drop(cells, edges)
    while True:
        moving, root = now.filter("up_frame IS NOT NULL"), F.col("up_frame").isNull()
        settled.append(now.filter(root))
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, settled).select("track", "frame", "label", "path")
        up = reduce(DataFrame.unionByName, [*settled, moving]).select(F.col("frame").alias("f"), F.col("label").alias("l"), F.col("up_frame").alias("uf"), F.col("up_label").alias("ul"), F.col("track").alias("t"), F.col("path").alias("p"))
        x = moving.join(up, (F.col("up_frame") == F.col("f")) & (F.col("up_label") == F.col("l")))
        # Only what moved is written again.
        now = written(x.select("frame", "label", F.col("uf").alias("up_frame"), F.col("ul").alias("up_label"), F.concat("t", "track").alias("track"), F.concat("p", "path").alias("path")), "lineage")


def virtual_rows(walk: DataFrame, *more: str) -> DataFrame:
    """frame, label, row and `more`: the place of each cell in its frame as a depth-first walk over all trees fills it, from 1."""
    return walk.select("frame", "label", *more, F.row_number().over(Window.partitionBy("frame").orderBy("path")).cast("long").alias("row"))


def export_graph(cells: DataFrame, edges: DataFrame, walk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, frame, label, row, track) in order of frame and label, and arcs(a, b) between their ids."""
    nodes = written(in_order(virtual_rows(walk, "track"), "id").select("id", "frame", "label", "row", "track"), "nodes")  # names move once, to their frame
    a = nodes.select(F.col("id").alias("a"), "frame", "label")
    b = nodes.select(F.col("id").alias("b"), F.col("frame").alias("next_frame"), F.col("label").alias("next_label"))
    x = edges.withColumn("next_frame", next_frame(edges))
    return nodes, x.join(a, ["frame", "label"]).join(b, ["next_frame", "next_label"]).select("a", "b")


def neighbours(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, right, left, above, below: where a step from a node leads (the first arc out, the first in, the next row in the frame)."""
    out = arcs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("right"))
    into = arcs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("left"))
    w = Window.partitionBy("frame").orderBy("row")
    x = nodes.withColumn("above", F.lead("id").over(w)).withColumn("below", F.lag("id").over(w))
    return x.select("id", "above", "below").join(out, "id", "left").join(into, "id", "left")


def clicked(nodes: DataFrame, clicks: DataFrame, radius: float = 0.5) -> DataFrame:
    """clicks(click, at_frame, at_row, …) with the id, frame and label of the node nearest to each on the plane of frames and rows (of equally near ones the smaller id), null if none is within the radius.

    Points meet nodes of their own and the eight neighbouring squares of side `radius`, so any number of points goes through one equi-join."""
    square = lambda c, n: F.floor(F.col(c) / radius).alias(n)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    q = clicks.select("click", "at_frame", "at_row", square("at_frame", "_f"), square("at_row", "_r"), F.explode(around).alias("_s"))
    q = q.select("click", "at_frame", "at_row", (F.col("_f") + F.col("_s.a")).alias("_f"), (F.col("_r") + F.col("_s.b")).alias("_r"))
    x = q.join(nodes.select("id", "frame", "label", "row", square("frame", "_f"), square("row", "_r")), ["_f", "_r"])
    far = F.pow(F.col("frame") - F.col("at_frame"), 2.0) + F.pow(F.col("row") - F.col("at_row"), 2.0)
    best = x.filter(far <= radius * radius).groupBy("click").agg(F.min_by(F.struct("id", "frame", "label"), F.struct(far, F.col("id"))).alias("n"))
    return clicks.join(best, "click", "left").select(*clicks.columns, "n.id", "n.frame", "n.label")


def node_at(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """The nodes of cells(frame, label), as an image's picked labels are found in the graph."""
    return nodes.join(cells.select("frame", "label").distinct(), ["frame", "label"], "left_semi")


def of_lineage(walk: DataFrame, track: str) -> DataFrame:
    """frame, label of tracks that hold the name and have its root."""
    root = track.split("_")[1] if "_" in track else ""
    return walk.filter(F.contains("track", F.lit(track)) & (F.element_at(F.split("track", "_"), 2) == root)).select("frame", "label")


def remove(pixels: DataFrame, listed: DataFrame) -> DataFrame:
    """Pixels of listed(frame, label) become background; relabelling and relinking follow as usual."""
    x = pixels.join(listed.select("frame", "label", F.lit(1).alias("gone")).distinct(), ["frame", "label"], "left")
    return x.withColumn("label", F.when(F.col("gone").isNotNull(), F.lit(0).cast(pixels.schema["label"].dataType)).otherwise(F.col("label"))).select(pixels.columns)


def delete_node(pixels: DataFrame, frame: int, label: int) -> DataFrame:
    """One cell becomes background and the labels above it move down by one in that frame."""
    here = F.col("frame") == frame
    kind = pixels.schema["label"].dataType
    moved = F.when(here & (F.col("label") == label), 0).when(here & (F.col("label") > label), F.col("label") - 1).otherwise(F.col("label"))
    return pixels.withColumn("label", moved.cast(kind))


def link(edges: DataFrame, parent: tuple[int, int], child: tuple[int, int]) -> DataFrame:
    """The child's only parent becomes `parent`; both are (frame, label), the earlier one is the parent, and one frame is no link."""
    if parent[0] == child[0]:
        return edges
    parent, child = sorted([parent, child])
    x = edges.withColumn("next_frame", next_frame(edges))
    if "added" not in x.columns:
        x = x.withColumn("added", F.lit(0))
    x = x.filter(~((F.col("next_frame") == child[0]) & (F.col("next_label") == child[1])))
    new = x.sparkSession.createDataFrame([(parent[0], parent[1], child[0], child[1])], "frame long, label long, next_frame long, next_label long")
    return x.unionByName(new.withColumn("added", F.lit(1)), allowMissingColumns=True)


def unlink(edges: DataFrame, cell: tuple[int, int], side: str) -> DataFrame:
    """Without the edges to a cell's children (`r`; these lose all their parents) or from its parents (`l`)."""
    x = edges.withColumn("next_frame", next_frame(edges))
    if side == "l":
        out = x.filter(~((F.col("next_frame") == cell[0]) & (F.col("next_label") == cell[1])))
    else:
        orphans = x.filter((F.col("frame") == cell[0]) & (F.col("label") == cell[1])).select("next_frame", "next_label")
        out = x.join(orphans, ["next_frame", "next_label"], "left_anti")
    return out.select(*edges.columns)
