import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import geometry, labels, measure, series, stabilise, tracking
from pulsegrid.plans import catalogue

#: Frame, label, first and last row, first and last column of drawn rectangles.
RECTANGLES = ((0, 1, 2, 9, 3, 12), (0, 2, 12, 18, 3, 9), (1, 1, 3, 10, 4, 7), (1, 2, 3, 10, 9, 13), (1, 3, 13, 19, 4, 10), (2, 1, 4, 11, 5, 8), (2, 2, 4, 11, 10, 14), (2, 3, 14, 20, 5, 5), (2, 4, 22, 22, 22, 22))
SIDE = 26


def drawn(spark):
    """frame, y, x, label, dc, ac: the rectangles on an empty ground, brighter towards their middles."""
    boxes = spark.createDataFrame([*RECTANGLES], "frame long, label long, y0 long, y1 long, x0 long, x1 long")
    ground = spark.range(3 * SIDE * SIDE).select(F.expr(f"id div {SIDE * SIDE}").alias("frame"), F.expr(f"id % {SIDE * SIDE} div {SIDE}").alias("y"), F.expr(f"id % {SIDE}").alias("x"))
    inside = (F.col("g.frame") == F.col("b.frame")) & F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
    x = ground.alias("g").join(F.broadcast(boxes).alias("b"), inside, "left")
    edge = F.least(F.col("y") - F.col("y0"), F.col("y1") - F.col("y"), F.col("x") - F.col("x0"), F.col("x1") - F.col("x"))
    bright = F.coalesce(10.0 + 20.0 * F.least(edge, F.lit(2)), F.lit(1.0))
    return x.select("g.frame", "y", "x", F.coalesce("label", F.lit(0)).cast("long").alias("label"), (5.0 * bright + F.col("y") * 0.25 + F.col("x") * 0.125).alias("dc"), bright.alias("ac"))


def image(spark, boxes, frames=2, side=16):
    """frame, y, x, label, dc, ac of boxes(frame, label, y0, y1, x0, x1)."""
    out = []
    for f in range(frames):
        for y in range(side):
            for x in range(side):
                label = next((b[1] for b in boxes if b[0] == f and b[2] <= y <= b[3] and b[4] <= x <= b[5]), 0)
                out.append((f, y, x, label, float(x + y), float(x)))
    return spark.createDataFrame(out, "frame long, y long, x long, label long, dc double, ac double")


def tracks(walk):
    return {(r.frame, r.label): r.track for r in walk.collect()}


def test_relabel_keeps_background(spark):
    p = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate([0, 2, 5, 5])] + [(1, 0, i, v) for i, v in enumerate([7, 3])], "frame long, y long, x long, label long")
    got = {(r.frame, r.x): r.label for r in labels.relabel(p).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (0, 3): 2, (1, 0): 2, (1, 1): 1}


def test_division(spark):
    p = image(spark, [(0, 1, 2, 9, 2, 11), (1, 1, 2, 9, 2, 6), (1, 2, 2, 9, 8, 11)])
    cells = labels.shape_stats(p)
    walk = tracking.lineages(cells, tracking.network(p, cells))
    assert tracks(walk) == {(0, 1): "Cell_0", (1, 1): "Cell_0_0", (1, 2): "Cell_0_1"}
    rows = {(r.frame, r.label): r.row for r in tracking.virtual_rows(walk).collect()}
    assert rows == {(0, 1): 1, (1, 1): 1, (1, 2): 2}


def test_merge_keeps_the_larger_overlap(spark):
    edges = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 1, 0.6)], "frame long, label long, next_label long, score double")
    back = spark.createDataFrame([(1, 1, 1, 0.7), (1, 1, 2, 0.2)], "frame long, label long, prev_label long, frac double")
    assert [r.label for r in tracking.best_parents(edges, back).collect()] == [1]


def test_best_overlap_by_no_parent_leaves_a_root(spark):
    edges = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 1, 0.6)], "frame long, label long, next_label long, score double")
    back = spark.createDataFrame([(1, 1, 3, 0.7), (1, 1, 2, 0.2)], "frame long, label long, prev_label long, frac double")
    assert tracking.best_parents(edges, back).count() == 0


def test_ties_go_to_the_smaller_label(spark):
    edges = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 1, 0.6)], "frame long, label long, next_label long, score double")
    back = spark.createDataFrame([(1, 1, 2, 0.3), (1, 1, 1, 0.3)], "frame long, label long, prev_label long, frac double")
    assert [r.label for r in tracking.best_parents(edges, back).collect()] == [1]


def test_single_pixels_overlap_nothing_forward(spark):
    p = image(spark, [(0, 1, 3, 3, 3, 3), (1, 1, 3, 3, 3, 3)])
    cells, common = labels.shape_stats(p), tracking.overlaps(p)
    assert tracking.forward(common, cells).count() == 0 and tracking.backward(common, cells).count() == 1


def test_score_at_weights_one(spark):
    cells = spark.createDataFrame([(0, 1, 5.0, 5.0, 20, 30.0, 1.5), (1, 1, 5.0, 7.0, 10, 60.0, 3.0)], "frame long, label long, com_y double, com_x double, area long, angle double, ar double")
    frac = spark.createDataFrame([(0, 1, 1, 0.4)], "frame long, label long, next_label long, frac double")
    got = tracking.candidates(frac, cells).first().score
    assert got == pytest.approx((0.4 + 0.8 + 0.5 + 0.5 + 1 + 0.5 + 1 + 0.5) / 8)


def test_long_lineage_and_names(spark):
    n = 300
    cells = spark.createDataFrame([(f, 1) for f in range(n)] + [(n, 1), (n, 2), (n, 3)], "frame long, label long")
    edges = spark.createDataFrame([(f, 1, 1) for f in range(n - 1)] + [(n - 1, 1, k) for k in (1, 2, 3)], "frame long, label long, next_label long")
    got = tracks(tracking.lineages(cells, edges))
    assert all(got[f, 1] == "Cell_0" for f in range(n)) and [got[n, k] for k in (1, 2, 3)] == ["Cell_0_0", "Cell_0_1", "Cell_0_2"]


def test_no_cells(spark):
    p = image(spark, [])
    cells = labels.shape_stats(p)
    assert tracking.lineages(cells, tracking.network(p, cells)).count() == 0


def test_links_over_frames_come_last(spark):
    cells = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (3, 1)], "frame long, label long")
    edges = spark.createDataFrame([(0, 1, 2)], "frame long, label long, next_label long")
    linked = tracking.link(edges, (3, 1), (0, 1))
    assert tracks(tracking.lineages(cells, linked)) == {(0, 1): "Cell_0", (1, 2): "Cell_0_0", (3, 1): "Cell_0_1", (1, 1): "Cell_1"}
    assert tracking.link(edges, (1, 1), (1, 2)) is edges
    assert tracks(tracking.lineages(cells, tracking.unlink(linked, (0, 1), "r"))) == {(0, 1): "Cell_0", (1, 1): "Cell_1", (1, 2): "Cell_2", (3, 1): "Cell_3"}


def test_lineage_selections(spark):
    walk = spark.createDataFrame([("Cell_1", 0, 1), ("Cell_10", 0, 2), ("Cell_1_0", 1, 1)], "track string, frame long, label long")
    assert walk.filter(series.selects("track", ["Cell_1"])).count() == 3
    assert sorted(map(tuple, tracking.of_lineage(walk, "Cell_1").collect())) == [(0, 1), (1, 1)]


def test_nearest_time_within_tolerance(spark):
    s = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate((0, 10, 20))], "track string, i long, time double")
    assert [r.i for r in series.at_time(s, "track", 10.05, "time", "i").collect()] == [1]
    assert series.at_time(s, "track", 10.2, "time", "i").count() == 0
    q = spark.createDataFrame([("a", 10.05), ("a", 10.2), ("a", 19.95), ("a", -0.05)], "track string, at double")
    assert sorted((r["at"], r.i) for r in series.nearest_times(q, s, "track", "time", "i").collect()) == [(-0.05, 0), (10.05, 1), (19.95, 2)]


def test_export_text(spark):
    s = spark.createDataFrame([("Cell_0", 1, 2.5, 3), ("Cell_0", 0, 1.5, 4)], "track string, frame long, time double, area long")
    assert [r.line for r in series.export_rows(s, ["time", "area"], 2).collect()] == ["Cell_0", "time,1.50,2.50", "area,4.00,3.00", ""]


def test_missing_features_are_told(spark):
    lineage = spark.createDataFrame([("Cell_0", 0, 1), ("Cell_0", 1, 1)], "track string, frame long, label long")
    features = spark.createDataFrame([(0, 1, 5)], "frame long, label long, area long")
    assert {r.frame: (r.area, r.missing) for r in series.with_features(lineage, features).collect()} == {0: (5, False), 1: (None, True)}


def test_shapes(spark):
    p = drawn(spark)
    c = {(r.frame, r.label): r for r in geometry.contours(p).collect()}
    assert (c[0, 1].n_points, c[0, 1].area) == (32, 63.0) and c[0, 1].xs[0] == c[0, 1].xs[-1] == 3
    assert (c[2, 4].n_points, c[2, 4].area) == (1, 0.0)
    assert all(r.convexity == 1 for r in geometry.convexity(p).filter("NOT (frame = 2 AND label = 3)").collect())
    e = {(r.frame, r.label): r for r in geometry.ellipses(p).collect()}
    assert e[1, 1].angle == pytest.approx(90) and e[1, 1].major > e[1, 1].minor
    m = {(r.frame, r.label): (r.major, r.minor) for r in geometry.ellipses(p, tracking=False).collect()}
    assert m[2, 4] == (1, 1) and m[2, 3] == (0, 0) and e[2, 3].major == 1


def test_ellipse_fit_is_exact_on_an_ellipse():
    import numpy as np

    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    x, y = 8 * np.cos(t), 3 * np.sin(t)
    turn = np.radians(30)
    points = np.stack([x * np.cos(turn) - y * np.sin(turn) + 50, x * np.sin(turn) + y * np.cos(turn) - 7], axis=1)
    assert geometry.fit_ellipse(points) == pytest.approx((30, 16, 6))


def test_concave_part_and_hole():
    import numpy as np

    mask = np.zeros((12, 12), bool)
    mask[2:10, 2:10] = True
    mask[4:8, 4:8] = False
    c = geometry.trace(mask)
    assert len(c) == 28 and geometry.filled(c, mask.shape).sum() == 64
    mask[2:6, 5:7] = False
    assert geometry.filled(geometry.hull(geometry.trace(mask)), mask.shape).sum() == 64
    two = mask.copy()
    two[11, 11] = True
    assert len(geometry.components(two)) == 2


def test_bright_core_is_the_interior(spark):
    p = image(spark, [(0, 1, 2, 12, 2, 12)], 1)
    core = F.col("y").between(4, 10) & F.col("x").between(4, 10)
    p = p.withColumn("ac", F.when(core, 10.0).when((F.col("y") == 2) & (F.col("x") == 2), 3.0).when(F.col("label") == 1, 2.0).otherwise(1.0))
    inside = geometry.interiors(p)
    assert inside.count() == 49
    f = labels.interior_features(p, inside).first()
    assert (f.interior_area, f.interior_mean) == (49, 10.0) and f.contour_mean == pytest.approx(145 / 72) and f.back_contrast > 0 and f.contour_contrast > 0
    thin = image(spark, [(0, 1, 2, 9, 3, 3)], 1).withColumn("ac", F.col("y").cast("double"))
    assert geometry.interiors(thin).count() == 0


def test_segmentation_finds_boxes(spark):
    p = image(spark, [(0, 1, 2, 5, 2, 5), (0, 2, 8, 12, 8, 12)], 1).withColumn("dc", F.when(F.col("label") > 0, 9.0).otherwise(1.0))
    got = geometry.segment(p)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 215, 1: 16, 2: 25}


def test_shift_is_found(spark):
    import numpy as np

    yy, xx = np.mgrid[:24, :24]
    blob = lambda cy, cx: 50 * np.exp(-((yy - cy) ** 2 + (xx - cx) ** 2) / 20)
    dx, dy = stabilise.ecc_shift(blob(12, 12), blob(13.2, 10.5))
    assert (dx, dy) == pytest.approx((-1.5, 1.2), abs=0.05)


def test_warp_brings_frames_together(spark):
    p = image(spark, [(0, 1, 4, 6, 4, 6), (1, 1, 6, 8, 3, 5)])
    back = stabilise.back_to_first(spark.createDataFrame([(1, -1.0, 2.0)], "frame long, dx double, dy double"))
    assert tuple(stabilise.pads(back, 16, 16).first()) == (2, 0, 0, 1)
    w = stabilise.warp(p, back, 16, 16)
    assert w.count() == 2 * 18 * 17
    where = lambda f: {(r.y, r.x) for r in w.filter((F.col("frame") == f) & (F.col("label") == 1)).collect()}
    assert where(0) == where(1) and len(where(0)) == 9
    empty = w.filter("frame = 0 AND y = 0 AND x = 0").first()
    assert empty.dc == pytest.approx(15.0) and w.filter("frame = 1 AND x = 0 AND y = 17").count() == 1


def test_whole_measurement(spark):
    times = spark.createDataFrame([(0, 600.0), (1, 610.5), (2, 622.0)], "frame long, abstime double")
    rows = measure.measure(drawn(spark), times).collect()
    got = {(r.frame, r.label): r for r in rows}
    assert len(rows) == 9 and got[0, 1].track == "Cell_0" and got[0, 1].time == 0 and got[2, 1].time == 22
    assert got[1, 1].track == "Cell_0_0" and got[1, 2].track == "Cell_0_1" and got[2, 4].track.count("_") == 1
    assert got[0, 1].area == 80 and got[0, 1].ac_max == 50 and not any(r.missing for r in rows)
    full = measure.features(drawn(spark), with_outlines=True).filter("frame = 0 AND label = 1").first()
    assert len(full.total) == 33 and full.total[0] == full.total[-1] and len(full.interior) == 1
    assert series.attributes(measure.features(drawn(spark), with_outlines=True)) == measure.FEATURES


def textured(seed: int, side: int = 160):
    """An image of many soft spots."""
    import numpy as np

    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:side, :side]
    return sum(float(a) * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / float(w)) for y, x, a, w in zip(*rng.uniform(0, side, (2, 120)), rng.uniform(20, 90, 120), rng.uniform(4, 30, 120), strict=True)) + rng.normal(0, 1.0, (side, side))


@pytest.mark.parametrize("dx, dy", [(32, -29), (-33, 31), (0, 32), (5, -2), (0, 0), (-40, -40)])
def test_shifts_of_a_third_of_the_image(dx, dy):
    whole = textured(7, 180)
    fixed, moving = whole[42:138, 42:138], whole[42 - dy : 138 - dy, 42 - dx : 138 - dx]
    start = stabilise.coarse_shift(fixed, moving)
    assert start == (dx, dy)
    assert stabilise.ecc_shift(fixed, moving, start=start) == pytest.approx((dx, dy), abs=0.05)
    if abs(dx) + abs(dy) > 20:  # from nothing, Gauss-Newton alone ends elsewhere
        assert max(abs(a - b) for a, b in zip(stabilise.ecc_shift(fixed, moving), (dx, dy), strict=True)) > 3


def test_images_without_contrast_stay():
    import numpy as np

    flat = np.full((20, 30), 4.0)
    assert stabilise.coarse_shift(flat, flat) == (0, 0) and stabilise.ecc_shift(flat, flat, start=(0, 0)) == (0.0, 0.0)


def test_relinking_of_touched_frames(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(9)
    rows = []
    for f in range(8):
        for k in range(6):
            y, x = 12 * (k // 3) + rng.integers(0, 3), 12 * (k % 3) + rng.integers(0, 3)
            rows += [(f, int(y + a), int(x + b), k + 1, 1.0, 1.0) for a in range(rng.integers(5, 9)) for b in range(rng.integers(5, 9))]
    p = spark.createDataFrame(rows, "frame long, y long, x long, label long, dc double, ac double").dropDuplicates(["frame", "y", "x"])
    cells = labels.tracked_shapes(p)
    edges = tracking.network(p, cells)
    edited = p.withColumn("label", F.when(F.col("frame").isin(0, 4) & (F.col("label") == 2), 0).when((F.col("frame") == 4) & (F.col("x") > 20), 1).otherwise(F.col("label")).cast("long"))
    edited.write.partitionBy("frame").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p")).select(p.columns)
    now, links = tracking.relinked(stored, cells, edges, [0, 4], labels.tracked_shapes)
    flat = lambda x: sorted((tuple(round(float(v), 6) for v in r) for r in x.collect()))
    want = labels.tracked_shapes(edited)
    assert flat(now.select(sorted(now.columns))) == flat(want.select(sorted(want.columns)))
    assert flat(links) == flat(tracking.network(edited, want)) != flat(edges)
    plan = links._jdf.queryExecution().executedPlan().toString()
    import re

    pruned = [x for x in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)]
    assert pruned and all(re.search(r"frame.* IN \(", x) for x in pruned)


def test_clicks(spark):
    nodes = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 2, 2), (2, 1, 1, 1), (3, 5, 9, 40)], "id long, frame long, label long, row long")
    clicks = spark.createDataFrame([("a", 0.2, 1.1), ("b", 0.0, 1.5), ("c", 3.0, 3.0), ("d", 5.4, 40.0), ("e", -0.4, 0.9), ("f", None, 1.0)], "click string, at_frame double, at_row double")
    assert {r.click: (r.id, r.label) for r in tracking.clicked(nodes, clicks).collect()} == {"a": (0, 1), "b": (0, 1), "c": (None, None), "d": (3, 9), "e": (0, 1), "f": (None, None)}
    assert [r.id for r in tracking.node_at(nodes, spark.createDataFrame([(0, 2), (7, 7)], "frame long, label long")).collect()] == [1]


def test_graphs_draw_pixels_once(spark):
    """The table of pixels is scanned once, and what is made of them is read instead."""
    d = "/root/testdata/sf0.001"
    for name in ("graph_moves", "export_graph", "best_parent_edges"):
        files = catalogue.queries()[name](spark, d).inputFiles()
        assert files and not [f for f in files if "lineitem" in f]


def test_shapes_are_worked_out_once(spark):
    """What a measurement returns reads the shapes, and works none out again."""
    p = drawn(spark)
    x = measure.measure(p, p.select("frame").distinct().withColumn("abstime", F.col("frame") * 10.0))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and x.count() == len(RECTANGLES)


def test_cells_of_several_batches(spark):
    """Cells that begin and end anywhere in the batches that Python gets."""
    want = sorted(map(str, geometry.contours(drawn(spark)).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, geometry.contours(drawn(spark)).collect())) == want and len(want) == len(RECTANGLES)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_filled_polygons_by_hand():
    """Star-shaped polygons against a test of each pixel."""
    import numpy as np

    rng = np.random.default_rng(12)
    for _ in range(30):
        turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 12)))
        far = rng.uniform(3, 14, len(turn))
        points = np.stack([15 + np.round(far * np.cos(turn)), 15 + np.round(far * np.sin(turn))], axis=1).astype(int)
        got, want = geometry.filled(points, (31, 31)), np.zeros((31, 31), bool)
        for y in range(31):
            for x in range(31):
                inside = False
                for (x0, y0), (x1, y1) in zip(points.tolist(), np.roll(points, -1, axis=0).tolist(), strict=True):
                    cross = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
                    if cross == 0 and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1):
                        want[y, x] = True
                    if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                        inside = not inside
                want[y, x] |= inside
        assert (got == want).all()


def test_shapes_that_are_no_rectangles(spark):
    """An L, a ring, and two parts of one label."""
    rows = [(0, y, x, 1) for y in range(2, 12) for x in range(2, 12) if y >= 8 or x <= 4]
    rows += [(0, y, x, 2) for y in range(2, 12) for x in range(20, 30) if y in (2, 11) or x in (20, 29)]
    rows += [(0, y, x, 3) for y in range(20, 24) for x in range(2, 6)] + [(0, y, x, 3) for y in range(26, 29) for x in range(8, 11)]
    p = spark.createDataFrame(rows, "frame long, y long, x long, label long")
    found = {r.label: r for r in geometry.contours(p).collect()}
    assert (found[1].n_points, found[1].area) == (35, 39.5) and (found[2].n_points, found[2].area) == (36, 81.0) and (found[3].n_points, found[3].area) == (12, 9.0)
    convex = {r.label: r.convexity for r in geometry.convexity(p).collect()}
    assert convex[1] == pytest.approx(58 / 73) and convex[2] == pytest.approx(36 / 100) and convex[3] == pytest.approx(25 / 16)
    fits = {r.label: r for r in geometry.ellipses(p).collect()}
    assert fits[1].angle == pytest.approx(45.0, abs=3) and fits[2].ar == pytest.approx(1.0) and fits[2].angle == 0.0


def test_paths_are_short_and_keep_any_number_of_siblings(spark):
    """Forty divisions in a row: the path is no longer than the name but for the root's digits; rows follow the places of 10,002 children."""
    chain = [(k, 1, c) for k in range(40) for c in (1, 2)]
    cells = spark.createDataFrame([(0, 1), *[(k + 1, c) for k, _, c in chain]], "frame long, label long")
    walk = tracking.lineages(cells, spark.createDataFrame(chain, "frame long, label long, next_label long"))
    last = walk.filter("frame = 40").orderBy("label").collect()
    assert [r.track for r in last] == ["Cell_0" + "_0" * 39 + end for end in ("_0", "_1")] and last[0].path < last[1].path
    assert all(len(r.path) < len(r.track) for r in last)
    wide = spark.range(1, 10_003).selectExpr("0L AS frame", "1L AS label", "id AS next_label")
    cells = wide.selectExpr("1L AS frame", "next_label AS label").unionByName(wide.select("frame", "label").distinct())
    rows = tracking.virtual_rows(tracking.lineages(cells, wide)).filter("frame = 1")
    assert rows.filter("row <> label").count() == 0 and rows.count() == 10_002


def test_moments_at_a_tie_are_the_same_for_any_order(spark):
    """32 pixels: vy and vx are 2943/1024 and vxy is -1/1024, all ending in 5 at the tenth digit. The axes lie at -45 degrees, wherever the cell is and however its rows come."""
    cell = [(y, x) for y in range(6) for x in range(6) if (y, x) not in ((0, 1), (1, 4), (4, 0), (4, 4))]
    rows = [(0, k, 7 * k + y, 13 * k + x) for k in range(1, 41) for y, x in cell]
    for seed in range(3):
        p = spark.createDataFrame(rows, "frame long, label long, y long, x long").orderBy(F.rand(seed)).repartition(seed + 2)
        got = labels.moment_ellipse(p).select("label", *[F.round(c, 5).alias(c) for c in ("major", "minor", "angle")]).collect()
        assert {r.label for r in got} == set(range(1, 41)) and {tuple(r)[1:] for r in got} == {(6.78233, 6.78003, -45.0)}
        assert {r.angle for r in labels.tracked_shapes(p).collect()} == {135.0}


def test_moments_of_odd_places(spark):
    """One pixel, rows without a coordinate, negative and very large ones, an upright cell (90 degrees, not -90), integers of 32 bits and places between pixels."""
    far = 2_000_000_000
    rows = [(1, 5, 5), *[(2, -y, 3) for y in range(4)], *[(3, far + y, far - x) for y in range(3) for x in range(9)], (4, None, 1), (4, 2, None), (5, 0, 0), (5, 2, 2), (5, None, 9), (6, None, None)]
    p = spark.createDataFrame(rows, "label int, y int, x int").withColumn("frame", F.lit(0))
    want = {1: (0.0, 0.0, 0.0), 2: (4.47214, 0.0, 90.0), 3: (10.32796, 3.26599, 0.0), 4: (None, 0.0, None), 6: (None, 0.0, None)}
    shapes = lambda p: {r.label: tuple(r)[1:] for r in labels.moment_ellipse(p).select("label", *[F.round(c, 5).alias(c) for c in ("major", "minor", "angle")]).collect()}
    got = shapes(p)
    assert {k: got[k] for k in want} == want
    half = p.filter("label in (1, 2, 3)").withColumn("y", F.col("y") / 2).withColumn("x", F.col("x") / 2)
    assert shapes(half)[2] == (2.23607, 0.0, 90.0)


def test_interiors_of_speckled_cells(monkeypatch):
    """Parts without room for an outline of the least area are not walked around, and what is found stays the same."""
    import numpy as np

    rng, walks, trace = np.random.default_rng(8), [], geometry.trace
    monkeypatch.setattr(geometry, "trace", lambda mask: walks.append(mask) or trace(mask))

    def plain(mask, values):
        n, inside = int(mask.sum()), values[mask]
        eight = np.where(mask, (np.clip((values - inside.min()) / (inside.max() - inside.min()), 0, 1) * 255).astype(np.int64), -1)

        def found(t):
            out, outlines = np.zeros_like(mask), [c for c in map(trace, geometry.components(mask & (eight >= t))) if int(n * 0.2) <= geometry.shoelace(c) <= n]
            for c in outlines:
                out |= geometry.filled(c, mask.shape)
            return out, outlines, len(geometry.components(mask & (eight >= t)))

        t, all_ = float(geometry.otsu_of(eight[mask])), 0
        out, outlines, parts_ = found(t)
        all_ += parts_
        while not outlines and t >= 1:
            t *= 0.8
            out, outlines, parts_ = found(t)
            all_ += parts_
        return (out, outlines, all_) if outlines else (*found(float(eight[mask].mean()))[:2], all_)

    seen = 0
    for k in range(40):
        side = int(rng.integers(4, 30))
        mask = np.zeros((side + 2, side + 2), bool)
        mask[1:-1, 1:-1] = rng.random((side, side)) < (0.5, 0.8, 1.0)[k % 3]
        mask[1, 1:3] = True
        if k % 5 == 0:
            mask[2:] = False  # a line
        values = np.where(mask, rng.random(mask.shape) * 9 + np.arange(side + 2), 0.0)
        out, outlines, parts_ = plain(mask, values)
        got, lines = geometry.interior_of(mask, values)
        seen += parts_
        assert (got == out).all() and [c.tolist() for c in lines] == [c.tolist() for c in outlines]
    assert len(walks) < seen / 4
    flat = np.pad(np.ones((3, 3), bool), 1)
    assert geometry.interior_of(flat, flat * 2.0)[1] == [] and not geometry.interior_of(flat & False, flat * 2.0)[0].any()


def test_cells_over_batches(spark):
    """Cells that reach over batches, rows that come twice, labels that are null, and no rows at all."""
    p = drawn(spark)
    odd = p.unionByName(p.filter("y % 5 = 0")).unionByName(p.limit(9).withColumn("label", F.lit(None).cast("long")))
    flat = lambda x: sorted(map(repr, x.collect()))
    want, wide = flat(measure.shapes(odd)), flat(geometry.contours(odd))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert flat(measure.shapes(odd)) == want and flat(geometry.contours(odd)) == wide
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(want) == len(wide) == 9
    assert measure.shapes(p.limit(0)).count() == 0
    one = measure.shapes(spark.createDataFrame([(0, 5, 6, 1, 3.0)], "frame int, y int, x int, label int, ac double")).first()
    assert (one.major, one.minor, one.ar, one.interior_area, one.interior_mean, one.contour_mean) == (1.0, 1.0, 1.0, 0, None, 3.0)
    assert [tuple(q) for q in one.total] == [(6, 5), (6, 5)] and one.interior == []
