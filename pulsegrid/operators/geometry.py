"""Shapes of labelled regions: contours, ellipses, hulls, interiors. Grouped by (frame, label): a group is one cell's pixels.

Image coordinates: x to the right, y down. Contours are closed walks over border pixels, clockwise as seen, from the
topmost, then leftmost pixel. Of several components the one whose first pixel comes first in row order is "the" contour. Ellipse angles
are those of the major axis against the x axis, in degrees, 0 to 180.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pulsegrid.operators import labels, parts
from pulsegrid.sources.saved import drop, written

# The eight neighbours clockwise from east, as (dy, dx).
AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
# The neighbours in the order in which a walk that came from one looks at them: the next clockwise first, the one it came from last.
CLOCKWISE = tuple(tuple((came + turn) % 8 for turn in range(1, 9)) for came in range(8))


def grid(y: np.ndarray, x: np.ndarray, on: np.ndarray | None = None) -> tuple[np.ndarray, int, int]:
    """A mask with a margin of one, and where its corner lies."""
    y0, x0 = int(y.min()) - 1, int(x.min()) - 1
    mask = np.zeros((int(y.max()) - y0 + 2, int(x.max()) - x0 + 2), bool)
    mask[y - y0, x - x0] = True if on is None else on
    return mask, y0, x0


def components(mask: np.ndarray, least: float = 0.0) -> list[np.ndarray]:
    """8-connected parts of a mask as masks, in row order of their first pixels; without those whose box has no room for an outline of the area `least`."""
    label = parts.run_labels(mask)
    n = int(label.max(initial=0))
    room = np.full(n + 1, np.inf)
    if least > 0:
        y, x = np.nonzero(label)
        room = np.ones(n + 1)
        for place in (y, x):
            low, high = np.full(n + 1, max(mask.shape)), np.zeros(n + 1, np.int64)
            np.minimum.at(low, label[y, x], place)
            np.maximum.at(high, label[y, x], place)
            room *= high - low
    return [label == k for k in range(1, n + 1) if room[k] >= least]


def trace(mask: np.ndarray) -> np.ndarray:
    """[n, 2] (x, y): the outer border of the part that holds the first pixel in row order; the mask needs a margin of one."""
    wide, at = mask.shape[1], mask.ravel().item  # pixels go by their place in row order
    start = int(mask.argmax()) if mask.size else 0
    if not mask.size or not at(start):
        return np.zeros((0, 2), np.int64)
    steps = [dy * wide + dx for dy, dx in AROUND]
    walk, here, came = [], start, 4  # the pixel west of the first one is empty
    first_step = None
    while True:
        for k in CLOCKWISE[came]:
            if at(here + steps[k]):
                break
        else:
            walk = [start]
            break
        if here == start:
            if first_step is None:
                first_step = k
            elif k == first_step:
                break
        walk.append(here)
        here, came = here + steps[k], (k + 4) % 8
    out = np.empty((len(walk), 2), np.int64)
    out[:, 1], out[:, 0] = np.divmod(walk, wide)
    return out


def shoelace(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    following = lambda v: np.concatenate([v[1:], v[:1]])
    return abs(float(np.dot(x, following(y)) - np.dot(y, following(x)))) / 2


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count says, and beside it 0, 1, … within the index."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def filled(points: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixels inside a polygon of pixel centres or on its border, line by line: each edge is met where it crosses a row, and spans between crossings are filled."""
    starts = np.zeros((shape[0], shape[1] + 1), np.int64)  # how many crossings lie left of a pixel, as differences
    border = np.zeros(shape, bool)
    (x0, y0), (dx, dy) = points.T, (np.concatenate([points[1:], points[:1]]) - points).T
    n = np.maximum(np.gcd(dx, dy), 1)  # pixel centres that lie on an edge, its end being the next one's
    edge, k = spread(n)
    border[y0[edge] + k * (dy // n)[edge], x0[edge] + k * (dx // n)[edge]] = True
    edge, k = spread(np.abs(dy))  # the rows that an edge crosses, without the lowest
    rows = np.minimum(y0, y0 + dy)[edge] + k
    across = x0[edge] + dx[edge] * (rows - y0[edge]) / dy[edge]
    np.add.at(starts, (rows, np.clip(np.floor(across).astype(int) + 1, 0, shape[1])), np.sign(dy)[edge])
    return (np.cumsum(starts, axis=1)[:, :-1] % 2 == 1) | border


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by two monotone chains, without points on its sides."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)

    def chain(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def fit_ellipse(points: np.ndarray) -> tuple[float, float, float] | None:
    """(angle, major, minor), full axes, of the conic of least algebraic error through the points that is an ellipse; None if there is none.

    The constrained least-squares problem has one solution; for points on a line, there is none."""
    p = points.astype(float)
    centre = p.mean(axis=0)
    scale = np.abs(p - centre).max()
    if not scale:
        return None
    x, y = ((p - centre) / scale).T
    quad, line = np.stack([x * x, x * y, y * y], axis=1), np.stack([x, y, np.ones_like(x)], axis=1)
    s1, s2, s3 = quad.T @ quad, quad.T @ line, line.T @ line
    if np.linalg.cond(s3) > 1e12:
        return None
    back = -np.linalg.solve(s3, s2.T)
    m = s1 + s2 @ back
    m = np.array([m[2] / 2, -m[1], m[0] / 2])
    _, vectors = np.linalg.eig(m)
    vectors = np.real(vectors)
    good = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 1e-12)
    if not len(good):
        return None
    a, b, c = vectors[:, good[0]]
    d, e, f = back @ vectors[:, good[0]]
    shape = np.array([[a, b / 2], [b / 2, c]])
    middle = np.linalg.solve(2 * shape, [-d, -e])
    level = middle @ shape @ middle - f
    values, axes = np.linalg.eigh(shape * np.sign(level))
    if values.min() <= 0:
        return None
    half = np.sqrt(abs(level) / values) * scale
    long = int(half.argmax())
    # Rounded, lest an axis along x is at 0 or at 180 by its last bit; a circle has none.
    angle = 0.0 if half.max() - half.min() <= 1e-9 * half.max() else float(np.round(np.degrees(np.arctan2(axes[1, long], axes[0, long])), 9) % 180)
    return angle, float(2 * half.max()), float(2 * half.min())


def by_cell(pixels: DataFrame, columns: list[str], schema: str, f: Callable[[dict[str, np.ndarray]], tuple | list[tuple]]) -> DataFrame:
    """f of each cell's pixels (y, x and columns), in row order; schema without frame and label. Points of outlines are (x, y).

    Cells are sorted within partitions, and many of them go to Python at once, since small groups cost more to hand over than to work out. No more than a batch and the cell that it ends with are held."""
    kinds = f"frame long, label long, {schema}"
    out = to_arrow_schema(StructType.fromDDL(kinds))

    def each(x: pa.Table, at: list[int]) -> pa.RecordBatch:
        frame, label = x["frame"].to_numpy(), x["label"].to_numpy()
        values = {c: x[c].to_numpy() for c in ("y", "x", *columns)}
        rows = []
        for a, b in zip(at, at[1:], strict=False):
            got = f({c: v[a:b] for c, v in values.items()})
            key = int(frame[a]), int(label[a])
            rows += [(*key, *g) for g in (got if isinstance(got, list) else [got])]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.type, from_pandas=True) for k, kind in enumerate(out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in batches:
            if not len(x):
                continue
            held.append(x)
            first, last = held[0].slice(0, 1), x.slice(len(x) - 1)
            if first["frame"].equals(last["frame"]) and first["label"].equals(last["label"]):
                continue  # still the one cell
            x = pa.Table.from_batches(held)
            frame, label = x["frame"].to_numpy(), x["label"].to_numpy()
            at = [0, *(np.flatnonzero((frame[1:] != frame[:-1]) | (label[1:] != label[:-1])) + 1).tolist()]
            yield each(x, at)
            held = x.slice(at[-1]).to_batches()
        if held:
            x = pa.Table.from_batches(held)
            yield each(x, [0, len(x)])

    cells = pixels.filter("label <> 0").select("frame", "label", "y", "x", *columns)
    # As many tasks as asked for: cells are few bytes and much work.
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "frame", "label").sortWithinPartitions("frame", "label", "y", "x").mapInArrow(run, kinds)


def _first_contour(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, int]:
    mask, y0, x0 = grid(x["y"], x["x"])
    return trace(mask), mask, y0, x0


def contours(pixels: DataFrame) -> DataFrame:
    """frame, label, n_points, area (of the polygon), xs, ys: the first contour, closed by its first point."""

    def f(x: dict[str, np.ndarray]) -> tuple:
        c, _, y0, x0 = _first_contour(x)
        closed = np.concatenate([c, c[:1]])
        return len(c), shoelace(c), (closed[:, 0] + x0).tolist(), (closed[:, 1] + y0).tolist()

    return by_cell(pixels, [], "n_points int, area double, xs array<int>, ys array<int>", f)


def ellipses_of(contour: np.ndarray, pixels: int) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """fit_ellipse() of a contour, for tracking and for measurement; with four points or fewer (or points on a line): angle 0, axes 1, 1 for tracking and 0, 0 (1, 1 for a single pixel) for measurement."""
    e = fit_ellipse(contour) if len(contour) > 4 else None
    side = 1.0 if pixels == 1 else 0.0
    return e or (0.0, 1.0, 1.0), e or (0.0, side, side)


def ellipse_of(contour: np.ndarray, pixels: int, tracking: bool) -> tuple[float, float, float]:
    """One of ellipses_of()."""
    return ellipses_of(contour, pixels)[0 if tracking else 1]


def ellipses(pixels: DataFrame, tracking: bool = True) -> DataFrame:
    """frame, label, angle, major, minor, ar of the ellipse fitted to the first contour, as ellipse_of() says."""

    def f(x: dict[str, np.ndarray]) -> tuple:
        e = ellipse_of(_first_contour(x)[0], len(x["y"]), tracking)
        return (*e, e[1] / e[2] if e[2] else 0.0)

    return by_cell(pixels, [], "angle double, major double, minor double, ar double", f)


def convexity(pixels: DataFrame) -> DataFrame:
    """frame, label, convexity: pixels over pixels of the filled hull of the first contour."""

    def f(x: dict[str, np.ndarray]) -> tuple:
        c, mask, *_ = _first_contour(x)
        h = hull(c)
        return (float(mask.sum() / filled(h, mask.shape).sum()),)

    return by_cell(pixels, [], "convexity double", f)


def otsu_of(values: np.ndarray) -> int:
    """The first of 256 bins that maximises the variance between the classes up to and above it."""
    n = np.bincount(values, minlength=256).astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    ok = (w0 > 0) & (w1 > 0)
    between = np.zeros(256)
    between[ok] = w0[ok] * w1[ok] * (s0[ok] / w0[ok] - s1[ok] / w1[ok]) ** 2
    return int(np.round(between, 6).argmax())


def interior_of(mask: np.ndarray, values: np.ndarray, least: float = 0.2, most: float = 1.0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Interior pixels and their contours: parts at or over a threshold whose outline's area is within the band, filled.

    The threshold is Otsu's, then four fifths of the one before while nothing is found and it is at least 1, then the mean."""
    n, inside = int(mask.sum()), values[mask]
    empty = np.zeros_like(mask)
    if not n or (low := inside.min()) == (high := inside.max()):
        return empty, []
    eight = np.full(mask.shape, -1)
    eight[mask] = np.clip((inside - low) / (high - low), 0, 1) * 255

    def found(t: float) -> tuple[np.ndarray, list[np.ndarray]]:
        out, outlines = empty.copy(), []
        for part in components(mask & (eight >= t), int(n * least)):
            c = trace(part)
            if int(n * least) <= shoelace(c) <= int(n * most):
                outlines.append(c)
                out |= filled(c, mask.shape)
        return out, outlines

    t = float(otsu_of(eight[mask]))
    if np.ptp(np.flatnonzero(mask.any(axis=1))) * np.ptp(np.flatnonzero(mask.any(axis=0))) < int(n * least):
        return empty, []  # a line has no room for such an outline, whatever the threshold
    out, outlines = found(t)
    while not outlines and t >= 1:
        t *= 0.8
        out, outlines = found(t)
    return (out, outlines) if outlines else found(float(eight[mask].mean()))


def interiors(pixels: DataFrame, value: str = "ac") -> DataFrame:
    """frame, label, y, x of interior pixels, for labels.interior_features()."""

    def f(x: dict[str, np.ndarray]) -> list[tuple]:
        ys, xs = x["y"], x["x"]
        mask, y0, x0 = grid(ys, xs)
        values = np.zeros(mask.shape)
        values[ys - y0, xs - x0] = x[value]
        out, _ = interior_of(mask, values)
        return [(int(a) + y0, int(b) + x0) for a, b in zip(*np.nonzero(out & mask), strict=True)]

    return by_cell(pixels, [value], "y long, x long", f)


def segment(images: DataFrame, model: Callable[[np.ndarray], np.ndarray] | None = None, tile: int = 512) -> DataFrame:
    """images(frame, y, x, dc) with label. With a model(image) -> labels, a frame is a task.

    Without one: pixels over Otsu's threshold of the frame, in connected parts, numbered in row order. Thresholds come from histograms, and parts from tiles, so a frame of any size is many tasks, each of a bounded number of pixels."""
    if model is None:
        keys = ["frame", "_tile"]
        rest = images.drop("label").select("*", parts.of_tile(tile))
        bound = written(rest.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("dc").alias("_lo"), F.max("dc").alias("_hi")), "bounds")  # a row per tile
        # A task joins its pixels with their tiles' limits, sorts them and hands them over, all in one stage, so it gets half as many as elsewhere.
        n = parts.pieces(images.sparkSession, 2 * (bound.agg(F.sum("_n")).first()[0] or 0))
        ends = bound.groupBy("frame").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        ends = bound.select(*keys).join(ends, "frame")
        level = F.floor(F.when(F.col("_hi") > F.col("_lo"), (F.col("dc") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)).cast("int")
        # Pixels meet their tile's row, so they are dealt by tiles only.
        binned = rest.select(*keys, "dc").repartition(n, *keys).join(ends, keys).select("frame", F.lit(0).alias("label"), level.alias("bin"))
        found = labels.otsu(binned.filter("bin IS NOT NULL")).select("frame", "threshold")
        limits = written(ends.join(found, "frame", "left"), "limits")
        drop(bound)
        on = rest.repartition(n, *keys).join(limits, keys).withColumn("_on", F.coalesce(level > F.col("threshold"), F.lit(False)))
        return parts.labelled(on.select(*rest.columns, "_on"), "_on", tile=tile, n=n, dealt=True).drop("_on")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        y, c = x["y"].to_numpy(), x["x"].to_numpy()
        image = np.full((y.max() - y.min() + 1, c.max() - c.min() + 1), x["dc"].min(), float)
        image[y - y.min(), c - c.min()] = x["dc"]
        return x.assign(label=model(image)[y - y.min(), c - c.min()].astype("int64"))

    keep = images.drop("label").withColumn("label", F.lit(0).cast("long"))
    return keep.groupBy("frame").applyInPandas(run, keep.schema)
