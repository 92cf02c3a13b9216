"""Connected parts by tiles against a search by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import geometry, parts
from pulsegrid.operators.components import components
from pulsegrid.sources import tables


def by_hand(mask: np.ndarray) -> np.ndarray:
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = n
                todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return out


def spiral(side: int) -> np.ndarray:
    out, y, x, dy, dx = np.zeros((side, side), bool), 0, 0, 0, 1
    for n in [side, *[k for k in range(side - 1, 0, -2) for _ in (0, 1)]]:
        for _ in range(n - (n == side)):
            out[y, x] = True
            y, x = y + dy, x + dx
        out[y, x] = True
        dy, dx = dx, -dy
    return out


def masks() -> list[np.ndarray]:
    rng = np.random.default_rng(3)
    grid = np.zeros((40, 40), bool)
    grid[::2, ::2] = True
    diagonal = np.eye(40, dtype=bool) | np.eye(40, dtype=bool)[::-1]
    return [rng.random((40, 40)) < p for p in (0.2, 0.4, 0.6)] + [spiral(40), grid, diagonal, np.ones((40, 40), bool), np.zeros((40, 40), bool)]


def test_runs():
    for mask in masks():
        want = by_hand(mask)
        assert (parts.run_labels(mask) == want).all()
        assert [k.sum() for k in geometry.components(mask)] == [(want == n).sum() for n in range(1, want.max() + 1)]
    assert parts.run_labels(np.zeros((0, 0), bool)).shape == (0, 0)


@pytest.mark.parametrize("tile", [7, 16, 512])
def test_parts_over_tiles(spark, tile):
    all_ = dict(enumerate(masks()))
    rows = [(f, y, x, bool(m[y, x]), f"{f}-{y}", 99) for f, m in all_.items() for y in range(40) for x in range(40) if m[y, x] or (y + x) % 3]
    got = parts.labelled(spark.createDataFrame(rows, "frame long, y long, x long, on boolean, also string, label int"), "on", tile=tile)
    found = {(r.frame, r.y, r.x): (r.label, r.also) for r in got.collect()}
    assert len(found) == len(rows)
    for f, m in all_.items():
        want = by_hand(m)
        assert all(found[f, y, x] == (want[y, x], f"{f}-{y}") for g, y, x, *_ in rows if g == f)
    assert parts.labelled(got.limit(0), "on", tile=tile).count() == 0


def test_places_below_zero_and_keys(spark):
    rows = [(m, 0, y, x, True) for m in "ab" for y, x in [(-9, -9), (-8, -8), (-8, 3), (5, 5)]]
    got = parts.labelled(spark.createDataFrame(rows, "meas string, frame int, y long, x long, on boolean"), "on", ("meas", "frame"), tile=4)
    assert sorted((r.meas, r.y, r.x, r.label) for r in got.collect()) == sorted((m, y, x, k) for m in "ab" for y, x, k in [(-9, -9, 1), (-8, -8, 1), (-8, 3, 2), (5, 5, 3)])


def test_segments_by_tiles_as_whole(spark):
    rng = np.random.default_rng(5)
    yy, xx = np.mgrid[:60, :60]
    rows, want = [], {}
    for f in range(2):
        image = rng.random((60, 60)) * 5
        for _ in range(6):
            cy, cx, r = rng.integers(5, 55, 2).tolist() + [int(rng.integers(3, 12))]
            image[(yy - cy) ** 2 + (xx - cx) ** 2 < r * r] += 100
        eight = ((image - image.min()) / (image.max() - image.min()) * 255).astype(int)
        want[f] = by_hand(eight > geometry.otsu_of(eight.ravel()))
        rows += [(f, y, x, float(image[y, x]), 7) for y in range(60) for x in range(60)]
    rows += [(9, y, x, 3.0, 7) for y in range(3) for x in range(3)]  # a frame of one value has no parts
    for tile in (13, 512):
        got = {(r.frame, r.y, r.x): r.label for r in geometry.segment(spark.createDataFrame(rows, "frame long, y long, x long, dc double, label long"), tile=tile).collect()}
        assert len(got) == len(rows) and all(got[f, y, x] == (want[f][y, x] if f in want else 0) for f, y, x, *_ in rows)
    own = geometry.segment(spark.createDataFrame(rows, "frame long, y long, x long, dc double, label long"), lambda image: (image > 50).astype(int))
    assert {r.label for r in own.collect()} == {0, 1}


def test_tasks_of_bounded_size(spark, monkeypatch):
    """Images of two values are few bytes, and still no task has most of their pixels."""
    monkeypatch.setattr(parts, "PIECE", 2000, raising=False)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of many pixels are larger than that
    try:
        images = tables.images(spark, "/root/testdata/sf0.01")
        for x in (images, geometry.segment(images, tile=32).filter("label > 0")):
            rows = [r["count"] for r in x.groupBy(F.spark_partition_id().alias("task")).count().collect()]
            assert len(rows) > 8 and max(rows) < sum(rows) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_components_of_any_nodes(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(500 + k, 501 + k) for k in range(60)] + [(900, 900 + k) for k in range(1, 50)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    want = {x: top(x) for x in up if top(x) != x}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == want
    pair = lambda c: F.struct(F.lit("k").alias("k"), F.col(c).alias("n")).alias(c)
    assert {r.node.n: r.root.n for r in components(df.select(pair("a"), pair("b"))).collect()} == want
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_pixels_are_dealt_to_tiles_once(spark, monkeypatch, limit):
    """What joins a pixel with its tile's limits and what labels the tile share one shuffle, however the join is made; pixels without a frame or place are left out, those without a value are off."""
    plans, write = {}, parts.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(parts, "written", seen)
    rows = [(f, y - 4, x, 90.0 if (y // 3 + x // 3) % 3 == 0 else None if x == 1 else 1.0 + x) for f in (0, 3) for y in range(9) for x in range(12)]
    odd = [(None, 1, 1, 50.0), (0, None, 1, 50.0), (3, 2, None, 50.0)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = {(r.frame, r.y, r.x): (r.dc, r.label) for r in geometry.segment(spark.createDataFrame([*rows, *odd], "frame long, y long, x long, dc double"), tile=5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plans["tiles"].count("REPARTITION_BY_NUM") == 1
    want = by_hand(np.array([[(y // 3 + x // 3) % 3 == 0 for x in range(12)] for y in range(9)]))
    assert got == {(f, y, x): (dc, want[y + 4, x]) for f, y, x, dc in rows}
