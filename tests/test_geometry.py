"""Overlap, neighbours, suppression, assignment and sampling against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.functions.overlap import corners, overlap_area
from voxelmill.operators import joins as jn
from voxelmill.operators import matching as mt
from voxelmill.operators import metrics as mx
from voxelmill.operators import raster as rs
from voxelmill.operators import sampling as sm
from voxelmill.operators import sparse
from voxelmill.operators import suppress as sp
from voxelmill.plans import catalog

c = F.col


def clip_area(a, b):
    """Sutherland-Hodgman clip of one polygon by another, shoelace area."""
    poly = list(map(tuple, a))
    for (x1, y1), (x2, y2) in zip(b, np.roll(b, -1, axis=0)):
        out = []
        side = lambda p: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)
        for p, q in zip(poly, poly[1:] + poly[:1]):
            sp_, sq = side(p), side(q)
            if sp_ >= 0:
                out.append(p)
            if sp_ * sq < 0:
                t = sp_ / (sp_ - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        poly = out
        if not poly:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1]))) / 2


def test_overlap_area_matches_clipping():
    rng = np.random.default_rng(0)
    n = 500
    a = [rng.uniform(-2, 2, n), rng.uniform(-2, 2, n), rng.uniform(1, 4, n), rng.uniform(1, 4, n), rng.uniform(-4, 4, n)]
    b = [rng.uniform(-2, 2, n), rng.uniform(-2, 2, n), rng.uniform(1, 4, n), rng.uniform(1, 4, n), rng.uniform(-4, 4, n)]
    want = [clip_area(p, q) for p, q in zip(corners(*a), corners(*b))]
    assert np.allclose(overlap_area(*a, *b), want, atol=1e-9)


@pytest.mark.parametrize("yaw", [0.0, math.pi / 2, 0.3])
def test_overlap_of_equal_touching_and_nested(yaw):
    one = lambda *v: [np.array([float(x)]) for x in v]
    assert overlap_area(*one(1, 2, 4, 2, yaw), *one(1, 2, 4, 2, yaw))[0] == pytest.approx(8)
    assert overlap_area(*one(0, 0, 4, 4, yaw), *one(0, 0, 2, 2, yaw))[0] == pytest.approx(4)
    side = (4 * math.cos(yaw), -4 * math.sin(yaw))
    assert overlap_area(*one(0, 0, 4, 2, yaw), *one(*side, 4, 2, yaw))[0] == pytest.approx(0, abs=1e-9)


def random_dets(n, frames, seed, copies=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "frame_id": rng.integers(0, frames, n), "x": rng.uniform(0, 20, n), "y": rng.uniform(0, 20, n), "z": 0.0,
        "dx": rng.uniform(2, 4, n), "dy": rng.uniform(1, 3, n), "dz": 2.0, "yaw": rng.uniform(-3, 3, n),
        "score": rng.random(n).round(2), "name": rng.choice(["a", "b"], n)})
    if copies:
        pdf = pd.concat([pdf, pd.concat([pdf.iloc[:1]] * copies).assign(score=rng.random(copies).round(2))], ignore_index=True)
    return pdf.assign(det_id=np.arange(len(pdf)))


def brute_nms(pdf, keys, hit):
    kept = []
    for _, g in pdf.sort_values(["score", "det_id"], ascending=[False, True]).groupby(keys):
        chosen = []
        for row in g.itertuples():
            if not any(hit(k, row) for k in chosen):
                chosen.append(row)
        kept += [r.det_id for r in chosen]
    return sorted(kept)


def iou_rot(a, b):
    arr = lambda r: [np.array([getattr(r, k)]) for k in ("x", "y", "dx", "dy", "yaw")]
    area = overlap_area(*arr(a), *arr(b))[0]
    return area / (a.dx * a.dy + b.dx * b.dy - area)


@pytest.mark.parametrize("crowd", [1, 32])
def test_suppression_with_and_without_leader_piles(spark, crowd):
    """One frame with most rows, many of them copies of one box; several keys; ties."""
    pdf = random_dets(120, 2, 3, copies=60)
    df = spark.createDataFrame(pdf)
    got = sp.suppress(df, ["frame_id"], "det_id", sp.rotated(0.2), crowd=crowd)
    assert sorted(r.det_id for r in got.collect()) == brute_nms(pdf, ["frame_id"], lambda k, r: iou_rot(k, r) > 0.2)
    got = sp.suppress(df, ["frame_id", "name"], "det_id", sp.circle(9.0), crowd=crowd)
    circle = lambda k, r: (k.x - r.x) ** 2 + (k.y - r.y) ** 2 <= 9.0
    assert sorted(r.det_id for r in got.collect()) == brute_nms(pdf, ["frame_id", "name"], circle)
    assert got.columns == df.columns


def test_suppression_along_a_chain_and_of_nothing(spark):
    """Every box overlaps the next one only, best first: every second one stays."""
    pdf = random_dets(40, 1, 1).assign(y=0.0, yaw=0.0, dx=2.0, dy=2.0)
    pdf = pdf.assign(x=pdf.det_id * 1.2, score=1.0 - pdf.det_id / 100)
    df = spark.createDataFrame(pdf)
    got = sp.suppress(df, ["frame_id"], "det_id", sp.axis_aligned(0.2))
    assert sorted(r.det_id for r in got.collect()) == list(range(0, 40, 2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # chains that no batch holds whole
    try:
        got = sp.suppress(df, ["frame_id"], "det_id", sp.axis_aligned(0.2))
        assert sorted(r.det_id for r in got.collect()) == list(range(0, 40, 2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sp.suppress(df.where("score > 2"), ["frame_id"], "det_id", sp.axis_aligned(0.2)).count() == 0


def cloud(spark, n=600, seed=5, copies=200):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"frame_id": 0, "x": rng.uniform(0, 40, n), "y": rng.uniform(-20, 20, n), "z": rng.uniform(-1, 1, n), "intensity": rng.random(n)})
    pdf = pd.concat([pdf, *[pdf.iloc[:1]] * copies], ignore_index=True)
    return pdf.assign(point_id=np.arange(len(pdf)))


def brute_knn(pdf, ctr, k):
    out = {}
    for row in ctr.itertuples():
        part = pdf[pdf.frame_id == row.frame_id]
        d = (part.x - row.c_x) ** 2 + (part.y - row.c_y) ** 2 + (part.z - row.c_z) ** 2
        out[row.frame_id, row.centre_id] = part.assign(d=d).sort_values(["d", "point_id"]).point_id.head(k).tolist()
    return out


def found_knn(spark, pdf, ctr, k):
    got = {}
    for r in jn.knn(spark.createDataFrame(pdf), spark.createDataFrame(ctr), k).orderBy("rank").collect():
        got.setdefault((r.frame_id, r.centre_id), []).append(r.point_id)
    return got


def test_knn_in_one_crowded_frame(spark):
    """Copies, centres on points and outside the cloud, points far from all others, a frame without points."""
    pdf = cloud(spark, 1500)
    pdf.loc[5, ["x", "y", "z"]] = [1e12, 0.0, 0.0]
    pdf.loc[6, ["x", "y", "z"]] = [20.0, -1e9, 3.0]
    pdf = pd.concat([pdf, cloud(spark, 40, 6, 0).assign(frame_id=1)], ignore_index=True)
    ctr = pd.DataFrame({"frame_id": 0, "centre_id": range(60), "c_x": np.linspace(-5, 45, 60), "c_y": np.linspace(-25, 25, 60), "c_z": 0.0})
    ctr.loc[0, ["c_x", "c_y", "c_z"]] = pdf.loc[0, ["x", "y", "z"]].to_numpy()
    ctr.loc[1, ["c_x", "c_y", "c_z"]] = [4000.0, -900.0, 70.0]
    ctr.loc[2, ["c_x", "c_y", "c_z"]] = [9e11, 0.0, 0.0]
    ctr = pd.concat([ctr, ctr.head(9).assign(frame_id=1), ctr.head(2).assign(frame_id=2)], ignore_index=True)
    want = brute_knn(pdf, ctr, 7)
    got = found_knn(spark, pdf, ctr, 7)
    assert got == {key: ids for key, ids in want.items() if ids}


def test_far_centres_open_few_points(spark):
    """The candidates of a centre do not grow with the frame, wherever the centre lies."""
    pdf = cloud(spark, 20_000, 8, 0)
    ctr = pd.DataFrame({"frame_id": 0, "centre_id": range(4), "c_x": [20.0, 500.0, -80.0, 20.0], "c_y": [0.0, 3.0, 60.0, 1000.0], "c_z": 0.0})
    assert found_knn(spark, pdf, ctr, 5) == brute_knn(pdf, ctr, 5)
    kept = []
    whole = jn._within_bound
    try:
        jn._within_bound = lambda df, k: kept.append(whole(df, k)) or kept[-1]
        jn.knn(spark.createDataFrame(pdf), spark.createDataFrame(ctr), 5)
    finally:
        jn._within_bound = whole
    assert kept[-1].groupBy("centre_id").count().agg(F.max("count")).first()[0] <= 60


def test_knn_with_fewer_points_than_k(spark):
    pdf = cloud(spark, n=3, copies=0)
    ctr = pd.DataFrame({"frame_id": [0], "centre_id": [0], "c_x": [0.0], "c_y": [0.0], "c_z": [0.0]})
    assert jn.knn(spark.createDataFrame(pdf), spark.createDataFrame(ctr), 5).count() == 3


def test_ball_query_pads_with_first_hit_and_zero(spark):
    pts = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(5)], "frame_id bigint, point_id bigint, x double, y double, z double")
    ctr = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (0, 1, 90.0, 0.0, 0.0)], "frame_id bigint, centre_id bigint, c_x double, c_y double, c_z double")
    got = {(r.centre_id, r.slot): r.point_id for r in jn.ball_query(pts, ctr, 0.0, 1.5, 4).collect()}
    assert [got[(0, s)] for s in range(4)] == [0, 1, 2, 0]
    assert [got[(1, s)] for s in range(4)] == [0, 0, 0, 0]


@pytest.mark.parametrize("bits", [12, 3])
def test_farthest_points_with_fine_and_coarse_cells(spark, bits):
    """A crowded frame with copies, a small one and one with fewer points than picks; coarse cells need many passes."""
    parts = [cloud(spark, 900, 1, 80).assign(frame_id=1), cloud(spark, 60, 2, 0).assign(frame_id=2), cloud(spark, 3, 3, 0).assign(frame_id=3)]
    pdf = pd.concat(parts).round({"x": 1, "y": 1, "z": 1})  # ties
    got = sm.farthest_point_sample(spark.createDataFrame(pdf), 9, cell_bits=bits).toPandas()
    for frame, part in pdf.groupby("frame_id"):
        f = part[["x", "y", "z"]].to_numpy()
        idx, best = [0], np.full(len(f), np.inf)
        for _ in range(min(9, len(f)) - 1):
            best = np.minimum(best, ((f - f[idx[-1]]) ** 2).sum(1))
            idx.append(int(best.argmax()))
        want = part.point_id.to_numpy()[idx].tolist()
        assert got[got.frame_id == frame].sort_values("rank").point_id.tolist() == want


def test_farthest_features_of_nothing(spark):
    df = spark.createDataFrame(cloud(spark, 30, 4, 0))
    assert sm.farthest_point_sample(df.where("x > 100"), 4, ("x", "y", "z", "intensity")).count() == 0
    assert sm.farthest_point_sample(df, 4, ("x", "y", "z", "intensity")).count() == 4


def test_optimal_assignment_against_all_permutations():
    rng = np.random.default_rng(2)
    for _ in range(20):
        cost = rng.normal(size=(4, 6))
        got = mt.optimal_assignment(cost)
        best = min(itertools.permutations(range(6), 4), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))
        assert cost[range(4), got].sum() == pytest.approx(sum(cost[i, j] for i, j in enumerate(best)))
        assert len(set(got)) == 4


def test_assignment_of_a_large_frame_is_optimal(spark):
    """More predictions than a strip holds, and every truth box gets its own copy."""
    pdf = random_dets(700, 1, 4).rename(columns={"det_id": "pred_id"})
    gt = pdf.iloc[::9].rename(columns={"pred_id": "gt_id"})
    out = mt.hungarian_assign(spark.createDataFrame(pdf), spark.createDataFrame(gt), (20.0, 20.0)).toPandas()
    taken = out[out.gt_id >= 0]
    assert len(out) == 700 and len(taken) == len(gt) and taken.gt_id.is_unique


def _boxes(spark, n=80, seed=9, frames=4, spread=60.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"frame_id": rng.integers(0, frames, n), "box_id": range(n), "x": rng.uniform(0, spread, n), "y": rng.uniform(0, spread, n),
                        "z": 0.0, "dx": 3.0, "dy": 2.0, "dz": 2.0, "yaw": rng.uniform(-3, 3, n), "name": rng.choice(["a", "b"], n)})
    return pdf


def collisions(pdf):
    out = []
    for _, g in pdf.groupby("frame_id"):
        for a, b in itertools.combinations(g.itertuples(), 2):
            if iou_rot(a, b) > 1e-9:
                out.append((a, b))
    return out


def test_pasted_objects_are_free_and_within_quota(spark):
    pdf = _boxes(spark)
    scene, pool = pdf[pdf.box_id % 2 == 0], pdf[pdf.box_id % 2 == 1].rename(columns={"box_id": "object_id"})
    got = sm.paste_objects(spark.createDataFrame(scene), spark.createDataFrame(pool), {"a": 12, "b": 14}, 3)
    new = got.toPandas()
    assert len(new)
    total = pd.concat([scene, new])
    assert len(collisions(total)) == len(collisions(scene))
    for name, quota in (("a", 12), ("b", 14)):
        have = scene[scene.name == name].groupby("frame_id").size()
        add = new[new.name == name].groupby("frame_id").size()
        assert all(add[f] <= quota - have.get(f, 0) for f in add.index)


@pytest.mark.parametrize("bound", [1000, 0])
def test_moved_objects_do_not_collide(spark, bound):
    pdf = _boxes(spark, 60, 11, 2, 120.0)
    free = pdf.copy()
    moved = sm.object_noise(spark.createDataFrame(pdf), 8, 1.0, 0.3, 5, group_bound=bound).toPandas()
    assert sorted(moved.box_id) == sorted(pdf.box_id)
    out = moved.merge(free[["box_id", "dx", "dy"]], on="box_id")
    before = {frozenset((a.box_id, b.box_id)) for a, b in collisions(pdf)}
    after = {frozenset((a.box_id, b.box_id)) for a, b in collisions(out)}
    assert after <= before
    assert (moved.attempt >= 0).sum() > 40


def test_boundaries_of_the_in_box_test(spark):
    b = [("b_" + n, v) for n, v in zip(("x", "y", "z", "dx", "dy", "dz", "yaw"), (0.0, 0.0, 0.0, 2.0, 4.0, 2.0, 0.0))]
    rows = [(0.0, 0.0, 0.0), (0.0, 0.0, 2.0), (0.0, 0.0, 2.01), (0.99, 0.0, 1.0), (1.01, 0.0, 1.0), (0.0, 1.99, 1.0), (0.0, 2.01, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double").withColumns({n: F.lit(v) for n, v in b})
    got = [r.h for r in df.select(bx.point_in_box(c("x"), c("y"), c("z"), bx.box("b_")).alias("h")).collect()]
    assert got == [True, True, False, True, False, True, False]


@pytest.mark.parametrize("radius", [0, 1, 2, 17])
def test_cell_windows_across_words(spark, radius):
    
    rng = np.random.default_rng(radius)
    rows, cols = 40, 75
    full = np.ones((rows, cols), bool)
    full[rng.integers(0, rows, 3), rng.integers(0, cols, 3)] = False
    grids = {0: rng.random((rows, cols)) < 0.02, 1: full}

    def window(g, fn):
        return np.array([[fn(g[max(r - radius, 0) : r + radius + 1, max(q - radius, 0) : q + radius + 1]) for q in range(cols)] for r in range(rows)])

    cells = spark.createDataFrame([(k, int(r), int(q)) for k, g in grids.items() for r, q in zip(*np.nonzero(g))] * 2, "frame_id long, row long, col long")

    def cells_of(df):
        got = [tuple(x) for x in df.select("frame_id", "row", "col").collect()]
        assert len(got) == len(set(got))
        return set(got)

    def expected(fn):
        return {(k, int(r), int(q)) for k, g in grids.items() for r, q in zip(*np.nonzero(fn(g)))}

    assert cells_of(rs.dilate(cells, ["frame_id"], radius, rows, cols)) == expected(lambda g: window(g, np.any))
    assert cells_of(rs.erode(cells, ["frame_id"], radius, rows, cols)) == expected(lambda g: g & window(g, np.all))
    if radius == 1:
        assert cells_of(rs.cell_boundary(cells, ["frame_id"], rows, cols)) == expected(lambda g: g & ~window(g, np.all))


def test_cell_windows_send_words_not_cells(spark):
    
    cells = spark.range(0, 4000, 1, 2).select((c("id") / 4000).cast("long").alias("frame_id"), (c("id") / 100).cast("long").alias("row"), (c("id") % 100).alias("col"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (rs.dilate(cells, ["frame_id"], 1, 40, 100), rs.erode(cells, ["frame_id"], 1, 40, 100)):
            rows = out._jdf.queryExecution().executedPlan()
            out._jdf.queryExecution().toRdd().count()
            sent, todo = [], [rows]
            while todo:
                node = todo.pop()
                if node.nodeName() == "Exchange":
                    sent.append(node.metrics().apply("shuffleRecordsWritten").value())
                todo += [node.children().apply(i) for i in range(node.children().size())]
            assert sent and max(sent) < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rotated_rule_clips_only_pairs_that_touch(spark):
    pairs = spark.range(4).select(*[(c("id") * 10.0).alias(k) for k in ("x", "y")], *[F.lit(0.0).alias("k_" + k) for k in ("x", "y")],
                                  *[F.lit(2.0).alias(p + k) for p in ("", "k_") for k in ("z", "dx", "dy", "dz", "yaw")])
    hit = pairs.where(sp.rotated(0.2).test())
    lines = hit._jdf.queryExecution().sparkPlan().toString().split("\n")
    (at,) = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert any("Filter" in line for line in lines[at + 1 :]) and hit.count() == 1


def test_rows_are_dealt_before_they_are_sorted(spark):
    from voxelmill.operators import topk as tk

    scores = spark.range(0, 600, 1, 1).select((c("id") % 3).alias("frame_id"), c("id").alias("flat"), F.sin("id").alias("s"))
    top = tk.top_queries(scores, 4, 6)
    lines = top._jdf.queryExecution().sparkPlan().toString().split("\n")
    limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    assert any("Exchange" in line or "Repartition" in line for line in lines[max(limits):])
    want = scores.toPandas().sort_values(["frame_id", "s"], ascending=[True, False]).groupby("frame_id").head(4)
    assert {(r.frame_id, r.flat) for r in top.collect()} == set(zip(want.frame_id, want.flat))


def test_scenes_are_packed_into_few_files(spark, tmp_path):
    from voxelmill.sources import sinks as sk

    frames = spark.range(400).select(F.lit("train").alias("split"), (c("id") % 50).cast("string").alias("scene_id"), c("id").alias("frame_id"), F.lit(1).alias("point_count"))
    sk.write_dataset(frames.repartition(8), str(tmp_path))
    assert len(list(tmp_path.glob("frames/split=train/**/*.parquet"))) <= 8
    back = sk.read_dataset(spark, str(tmp_path))
    assert {tuple(r) for r in back.select("split", "scene_id", "frame_id").collect()} == {tuple(r) for r in frames.select("split", "scene_id", "frame_id").collect()}
    assert back.withColumn("f", F.input_file_name()).groupBy("scene_id").agg(F.countDistinct("f").alias("n")).where("n > 1").isEmpty()


def test_train_sweeps_are_ranked_in_one_pass(spark):
    sweeps = spark.range(40).select((c("id") % 4).alias("record_id"), F.expr("id div 4").alias("rank"))
    out = sm.choose_sweeps(sweeps, 3, True, 7)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["count"] for r in out.groupBy("record_id").count().collect()} == {3}


def _random_cells(spark, n=400, rows=12, cols=70, seed=5):
    rng = np.random.default_rng(seed)
    at = rng.choice(rows * cols, n, replace=False)
    pdf = pd.DataFrame({"frame_id": 0, "class_id": at % 2, "row": at // cols, "col": at % cols, "score": rng.integers(0, 9, n) / 10.0, "label": rng.integers(0, 2, n), "supervised": 1})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("tolerance", [0, 1, 2, 18])
def test_boundary_f1_against_sets(spark, tolerance):
    rows, cols = 12, 70
    grid = [(r, q) for r in range(rows) for q in range(cols)]
    rng = np.random.default_rng(tolerance)
    pred, true = ({g for g in grid if rng.random() < 0.6} for _ in range(2))
    mask = {g for g in grid if tolerance > 2 or rng.random() < 0.97}
    df = spark.createDataFrame([(0, 0, r, q, 0.9 if (r, q) in pred else 0.1, int((r, q) in true), int((r, q) in mask)) for r, q in grid],
                               "frame_id bigint, class_id int, row bigint, col bigint, score double, label int, supervised int")

    def window(g, k):
        return {(r, q) for r in range(max(g[0] - k, 0), min(g[0] + k, rows - 1) + 1) for q in range(max(g[1] - k, 0), min(g[1] + k, cols - 1) + 1)}

    core = {g for g in mask if window(g, tolerance) <= mask}
    p, t = ({g for g in s if not window(g, 1) <= s} & core for s in (pred, true))
    got = mx.boundary_f1(df, ["frame_id", "class_id"], rows, cols, tolerance).first()
    want = (len(p), sum(bool(window(g, tolerance) & t) for g in p), len(t), sum(bool(window(g, tolerance) & p) for g in t))
    assert (got.pred, got.pred_matched, got.truth, got.truth_matched) == want


def test_boundary_f1_works_on_words(spark):
    _, df = _random_cells(spark)
    plan = mx.boundary_f1(df, ["frame_id", "class_id"], 12, 70)._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan and "col#" not in plan  # no cell is shuffled after its word is made


def test_lattice_is_made_by_many_tasks(spark):
    frames = spark.range(50).select((c("id") % 5).alias("frame_id")).distinct()
    cells = rs.lattice(frames, 3, 4)
    assert cells.count() == 60
    assert cells.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_local_peaks_without_aggregate(spark):
    pdf, df = _random_cells(spark)
    found = rs.local_peaks(df, 2, 12, 70, single=(1,))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    cells = {(r.class_id, r.row, r.col): r.score for r in pdf.itertuples()}

    def peak(k, r, q, s):
        near = [v for (a, b, d), v in cells.items() if a == k and abs(b - r) <= 2 and abs(d - q) <= 2]
        return k == 1 or (2 <= r <= 9 and 2 <= q <= 67 and s == max(near))

    want = {(*key, s) for key, s in cells.items() if peak(*key, s)}
    got = [(r.class_id, r.row, r.col, r.score) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_label_edges_without_aggregate(spark):
    pdf, _ = _random_cells(spark, 600)
    px = spark.createDataFrame(pdf.rename(columns={"row": "v", "col": "u", "label": "semantic_id"})[["frame_id", "v", "u", "semantic_id"]])
    found = rs.semantic_boundary(px, 0, 12, 70)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    label = {(r.row, r.col): r.label for r in pdf.itertuples()}
    want = {(r, q) for (r, q), s in label.items() if any(label.get(n, s) != s for n in ((r - 1, q), (r + 1, q), (r, q - 1), (r, q + 1)))}
    got = [(r.row, r.col) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("kernel", [(3, 3, 3), (3, 1, 5), (2, 3, 4)])
def test_submanifold_pairs_by_words(spark, kernel):
    rng = np.random.default_rng(7)
    shape = (5, 6, 70)
    at = {tuple(int(rng.integers(0, n)) for n in shape) for _ in range(500)}
    vox = spark.createDataFrame([(0, *v, 0.5) for v in sorted(at)], "frame_id bigint, cx bigint, cy bigint, cz bigint, f double")
    found = sparse.submanifold_pairs(vox, shape, kernel)
    assert "_block" in found._jdf.queryExecution().optimizedPlan().toString()
    pad = kernel[0] // 2
    limit = [n + 2 * pad - k + 1 for n, k in zip(shape, kernel)]
    want = set()
    for v in at:
        for n, off in enumerate(itertools.product(*[range(k) for k in kernel])):
            o = tuple(a + pad - d for a, d in zip(v, off))
            if o in at and all(0 <= a < m for a, m in zip(o, limit)):
                want.add((*v, n, *o))
    got = [(r.cx, r.cy, r.cz, r.kernel, r.ox, r.oy, r.oz) for r in found.collect()]
    assert found.columns == [*vox.columns, "kernel", "ox", "oy", "oz"]
    assert len(got) == len(want) and set(got) == want


def test_assignment_of_many_frames_equals_that_of_each(spark):
    pdf = random_dets(300, 12, 8).rename(columns={"det_id": "pred_id"})
    gt = pdf[(pdf.pred_id % 3 == 0) & (pdf.frame_id != 5)].rename(columns={"pred_id": "gt_id"})  # frame 5 has no truth

    def run(p, g):
        found = mt.hungarian_assign(spark.createDataFrame(p), spark.createDataFrame(g), (20.0, 20.0))
        assert "FlatMapCoGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
        return {(r.frame_id, r.pred_id): (r.gt_id, r.cost) for r in found.collect()}

    whole = run(pdf, gt)
    assert len(whole) == 300 and all(whole[k][0] == -1 for k in whole if k[0] == 5)
    for f in (0, 7):
        part = run(pdf[pdf.frame_id == f], gt[gt.frame_id == f])
        assert part and all(whole[k] == v or (np.isnan(v[1]) and whole[k][0] == v[0]) for k, v in part.items())


def test_objects_of_many_frames_move_as_in_each(spark):
    pdf = _boxes(spark, 120, 3, 9, 12.0)

    def run(part):
        found = sm.object_noise(spark.createDataFrame(part), 6, 1.0, 0.3, 5)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
        return {tuple(r) for r in found.collect()}

    whole = run(pdf)
    assert len(whole) == 120 and len({r[2] for r in whole}) > 2  # some objects need several tries
    assert set.union(*[run(pdf[pdf.frame_id == f]) for f in (0, 4)]) == {r for r in whole if r[0] in (0, 4)}


def test_levels_of_neighbour_search_are_counted_where_points_meet(spark):
    points = spark.range(400).select((c("id") % 3).alias("frame_id"), c("id").alias("point_id"), *[F.rand(k).alias(a) for k, a in enumerate("xyz")])
    centres = spark.range(3).select(c("id").alias("frame_id"), c("id").alias("centre_id"), *[F.lit(0.5).alias("c_" + k) for k in "xyz"])
    plan = jn.knn(points, centres, 4)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert dealt and all("_p_q0" in line for line in dealt)
    assert "isnotnull(shiftright" not in plan  # the uses of a level would differ and each would count it again


@pytest.mark.parametrize("n", [200, 384, 385, 30_000])
def test_neighbours_carry_features_at_every_depth(spark, n):
    """Frames that need one level and three, each beside small frames, a point without a place and centres of far ids."""
    pdf = pd.concat([cloud(spark, n, 3, 0), cloud(spark, 30, 4, 0).assign(frame_id=1), cloud(spark, 2, 5, 0).assign(frame_id=2)], ignore_index=True)
    pdf.loc[7, "y"] = None
    ctr = pd.DataFrame({"centre_id": np.arange(12) * 5000, "c_x": np.linspace(-5, 60, 12), "c_y": np.linspace(25, -30, 12), "c_z": 0.5})
    ctr = pd.concat([ctr.assign(frame_id=f) for f in range(3)], ignore_index=True)
    points = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False, name=None)],
                                   "frame_id long, x double, y double, z double, intensity double, point_id long")
    found = jn.knn(points, spark.createDataFrame(ctr), 3, ["intensity"])
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault((r.frame_id, r.centre_id), []).append((r.point_id, r.intensity))
    value = dict(zip(zip(pdf.frame_id, pdf.point_id), pdf.intensity))
    assert got == {key: [(i, value[key[0], i]) for i in ids] for key, ids in brute_knn(pdf, ctr, 3).items()}


def test_interpolation_does_not_look_at_the_points_again(spark):
    """The features come with the neighbours: points are neither numbered nor joined another time, and the nodes of
    small frames meet all their centres at once."""
    plan = catalog.QUERIES["three_interpolate"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
    assert plan.count("Join") == 3  # nodes to blocks of centres, centres to nodes, cells to points
    assert plan.count("Window [") == 1  # the rank


@pytest.mark.parametrize("scene_turn", [(0.0, 0.0), (-0.4, 0.9)])
def test_moved_objects_take_their_points_along(spark, scene_turn):
    """Centres shift along all three axes, points in a box turn and shift with it, the first box of a point decides, all others stay."""
    pdf = pd.concat([_boxes(spark, 40, 5, 3, 30.0), _boxes(spark, 12, 6, 1, 7.0).assign(frame_id=7, box_id=range(100, 112))], ignore_index=True)
    rng = np.random.default_rng(2)
    pts = pd.DataFrame({"frame_id": rng.choice([0, 1, 2, 7, 8], 6000), "point_id": range(6000), "x": rng.uniform(-2, 32, 6000), "y": rng.uniform(-2, 32, 6000), "z": rng.uniform(-1, 3, 6000)})
    pts.loc[pts.frame_id == 7, ["x", "y"]] /= 4
    pts.loc[3, ["x", "y", "z"]] = [np.inf, 0.0, 0.0]
    moves = sm.object_moves(spark.createDataFrame(pdf), 20, (0.5, 0.25, 0.1), (-0.2, 0.6), 3, scene_turn).toPandas().sort_values(["frame_id", "box_id"])
    assert len(moves) == len(pdf) and (moves.attempt < 0).any() and (moves.attempt > 0).any()
    stayed = moves[moves.attempt < 0]
    assert (stayed[["x", "y", "z", "yaw"]].to_numpy() == stayed[["nx", "ny", "nz", "nyaw"]].to_numpy()).all()
    lifted = (moves.nz - moves.z)[moves.attempt >= 0]
    assert (lifted != 0).all() and 0.05 < lifted.std() < 0.2
    got = sm.moved_points(spark.createDataFrame(pts), spark.createDataFrame(moves)).toPandas().set_index("point_id")
    assert sorted(got.index) == list(range(6000))
    several = 0
    for p in pts.itertuples():
        inside = []
        for b in moves[moves.frame_id == p.frame_id].itertuples():
            u = (p.x - b.x) * np.cos(b.yaw) - (p.y - b.y) * np.sin(b.yaw) if np.isfinite(p.x) else np.inf
            v = (p.x - b.x) * np.sin(b.yaw) + (p.y - b.y) * np.cos(b.yaw)
            if abs(u) < b.dx / 2 and abs(v) < b.dy / 2 and b.z < p.z < b.z + b.dz:
                inside.append((b, u, v))
        several += len(inside) > 1
        row, want, box = got.loc[p.point_id], [p.x, p.y, p.z], None
        if inside:
            b, u, v = inside[0]
            box = b.box_id
            want = [b.nx + u * np.cos(b.nyaw) + v * np.sin(b.nyaw), b.ny - u * np.sin(b.nyaw) + v * np.cos(b.nyaw), p.z + b.nz - b.z]  # the same place in the box
        assert row.box_id == box if inside else pd.isna(row.box_id)
        assert np.allclose([row.x, row.y, row.z], want, atol=1e-9)
    assert several and got.box_id.notna().sum() > 100


@pytest.mark.parametrize("scene_turn", [(0.0, 0.0), (-0.3, 0.3)])
def test_regions_of_a_large_frame_move_as_the_whole_frame(spark, scene_turn):
    """Shifts are normal draws without a bound, and objects may be carried round: regions still hold all that can meet."""
    rng = np.random.default_rng(8)
    pdf = _boxes(spark, 150, 4, 1, 14.0)
    at, far = rng.uniform(0, 1.2, 150), rng.choice([20.0, 45.0, 200.0], 150) + rng.uniform(0, 14, 150)
    pdf[["x", "y"]] = np.stack([far * np.sin(at), far * np.cos(at)], axis=1) if scene_turn[1] else np.stack([far, pdf.y], axis=1)
    def run(bound):
        return sorted(tuple(r) for r in sm.object_noise(spark.createDataFrame(pdf), 12, 1.0, 0.3, 5, scene_turn, group_bound=bound).collect())
    whole = run(1000)
    assert whole == run(20) and len({r[2] for r in whole}) > 3
    moved = [r for r in whole if r[2] >= 0]
    if not scene_turn[1]:
        step = pd.DataFrame(moved, columns=["frame_id", "box_id", "attempt", "x", "y", "z", "yaw"]).merge(pdf, on="box_id", suffixes=("", "_o"))
        assert ((step.x - step.x_o).abs() > 1.0).mean() > 0.1  # a uniform shift would end at 1


def test_object_noise_returns_the_whole_cloud(spark):
    out = catalog.QUERIES["object_noise"](spark, SMALL)
    parts = {r.part: r for r in out.groupBy("part").agg(F.count("*").alias("n"), F.sum((c("attempt") >= 0).cast("int")).alias("moved")).collect()}
    assert parts["box"].n == spark.read.parquet(f"{SMALL}/part.parquet").count()
    assert parts["point"].n == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert parts["box"].moved > 0 and parts["point"].moved > 0
