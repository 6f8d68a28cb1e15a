"""Spatial joins inside frames.

Both sides get a ground-tile key, so every join is an equi join on (frame, tile) with the
geometric test as a residual. The side with extent is exploded to the tiles it touches;
a pair of two boxes is reported only in the tile of its first common corner, so no
distinct is needed. A crowded tile is split at run time by the adaptive skew join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.functions.overlap import rectangle_overlap_area
from voxelmill.operators import cells as cl
from voxelmill.session import cut_lineage
from voxelmill.skew import SALTS, shuffled_join

c = F.col
TILE = ["frame_id", "_tx", "_ty"]


def _tile(col: Column, size: float) -> Column:
    return F.floor(col / size)


def spread_tiles(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> DataFrame:
    """One row per ground tile between two corners."""
    return (df.withColumn("_tx", F.explode(F.sequence(_tile(x1, size), _tile(x2, size))))
            .withColumn("_ty", F.explode(F.sequence(_tile(y1, size), _tile(y2, size)))))


def point_tiles(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"_tx": _tile(c("x"), size), "_ty": _tile(c("y"), size)})


def box_tiles(boxes: DataFrame, size: float, prefix: str = "b_") -> DataFrame:
    """Boxes with prefixed columns and one row per touched tile."""
    named = boxes.select("frame_id", *[c(n).alias(prefix + n) for n in boxes.columns if n != "frame_id"])
    bounded = named.withColumn("_b", F.array(*bx.bev_bounds(bx.box(prefix))))
    return spread_tiles(bounded, c("_b")[0], c("_b")[1], c("_b")[2], c("_b")[3], size).drop("_b")


def join_points_boxes(points: DataFrame, boxes: DataFrame, test: Column, size: float, how: str = "inner") -> DataFrame:
    """Points (x, y, z) against boxes (prefix ``b_``) with a residual test."""
    left, right = point_tiles(points, size), box_tiles(boxes, size)
    on = (left.frame_id == right.frame_id) & (left._tx == right._tx) & (left._ty == right._ty) & test
    joined = shuffled_join(left, right, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_tx", "_ty")
    return joined.drop(right.frame_id).drop(left._tx).drop(left._ty).drop(right._tx).drop(right._ty)


def inside() -> Column:
    return bx.point_in_box(c("x"), c("y"), c("z"), bx.box("b_"))


def points_in_boxes_all(points: DataFrame, boxes: DataFrame, size: float = 8.0) -> DataFrame:
    """Every (box, point) pair with the point inside."""
    return join_points_boxes(points, boxes, inside(), size)


def points_in_boxes_first(points: DataFrame, boxes: DataFrame, size: float = 8.0) -> DataFrame:
    """Lowest box id per point, -1 for points outside all boxes."""
    pairs = join_points_boxes(points, boxes.select("frame_id", "box_id", "x", "y", "z", "dx", "dy", "dz", "yaw"),
                              inside(), size, "left")
    return pairs.groupBy("frame_id", "point_id").agg(
        F.coalesce(F.min("b_box_id"), F.lit(-1).cast("bigint")).alias("box_id"))


def strictly_inside() -> Column:
    """Inside all six faces, open on each."""
    b = bx.box("b_")
    lx, ly = bx.in_box_local(c("x"), c("y"), b)
    return ((c("z") > b.z) & (c("z") < b.z + b.dz) & (F.abs(lx) < b.dy / 2) & (F.abs(ly) < b.dx / 2))


def in_convex_polygon(px: Column, py: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Strictly on the inner side of every edge (corners in turning order)."""
    test = F.lit(True)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        test = test & ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) < 0)
    return test


def remove_points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 8.0) -> DataFrame:
    return join_points_boxes(points, boxes, inside(), size, "left_anti")


def background_filter(points: DataFrame, boxes: DataFrame, width: float, size: float = 8.0) -> DataFrame:
    """Drop points inside an enlarged box but inside no original box."""
    wide = bx.enlarge(bx.box(), width)
    enlarged = boxes.select(
        "frame_id", *[getattr(wide, n).alias(n) for n in ("x", "y", "z", "dx", "dy", "dz", "yaw")],
        *[c(n).alias("o" + n) for n in ("x", "y", "z", "dx", "dy", "dz", "yaw")])
    near = join_points_boxes(points, enlarged, inside(), size)
    original = bx.point_in_box(c("x"), c("y"), c("z"), bx.box("b_o"))
    flags = near.groupBy("frame_id", "point_id").agg(F.max(original.cast("int")).alias("_in"))
    return shuffled_join(points, flags.where(c("_in") == 0), ["frame_id", "point_id"], "left_anti")


# Neighbours -------------------------------------------------------------------------------

def _keep_first_copies(points: DataFrame, k: int) -> DataFrame:
    """At most the first ``k`` points of each exact position. Later copies can never be among
    the first or nearest ``k`` of any centre, so results stay whole."""
    w = Window.partitionBy("frame_id", "x", "y", "z").orderBy("point_id")
    return points.withColumn("_copy", F.row_number().over(w)).where(c("_copy") <= k).drop("_copy")


def _distance2(prefix: str = "c_") -> Column:
    return sum(((c(k) - c(prefix + k)) * (c(k) - c(prefix + k)) for k in "yz"),
               (c("x") - c(prefix + "x")) * (c("x") - c(prefix + "x")))


def radius_pairs(points: DataFrame, centres: DataFrame, rmax: float, rmin: float = 0.0) -> DataFrame:
    """Pairs at distance 0 or in ``[rmin, rmax)``; centres have ``centre_id, c_x, c_y, c_z``."""
    left = point_tiles(points, rmax)
    right = spread_tiles(centres, c("c_x") - rmax, c("c_y") - rmax, c("c_x") + rmax, c("c_y") + rmax, rmax)
    pairs = shuffled_join(left, right, TILE).drop("_tx", "_ty").withColumn("d2", _distance2())
    return pairs.where((c("d2") == 0) | ((c("d2") >= rmin * rmin) & (c("d2") < rmax * rmax)))


def ball_query(points: DataFrame, centres: DataFrame, rmin: float, rmax: float, nsample: int) -> DataFrame:
    """First ``nsample`` hits in index order per centre, padded with the first hit; index 0
    everywhere when there is no hit."""
    pairs = radius_pairs(_keep_first_copies(points.select("frame_id", "point_id", "x", "y", "z"), nsample),
                         centres, rmax, rmin)
    w = Window.partitionBy("frame_id", "centre_id").orderBy("point_id")
    hits = (pairs.withColumn("slot", F.row_number().over(w)).where(c("slot") <= nsample)
            .groupBy("frame_id", "centre_id")
            .agg(F.array_sort(F.collect_list("point_id")).alias("ids")))  # at most nsample ids
    padded = F.coalesce(F.get(c("ids"), F.col("slot")), F.get(c("ids"), F.lit(0)), F.lit(0).cast("bigint"))
    return (shuffled_join(centres.select("frame_id", "centre_id"), hits, ["frame_id", "centre_id"], "left")
            .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(nsample - 1))))
            .select("frame_id", "centre_id", "slot", padded.alias("point_id")))


def _within_bound(found: DataFrame, k: int) -> DataFrame:
    """Of the nodes listed for a centre those that can hold one of its ``k`` nearest points: not farther
    than a distance within which other nodes surely hold ``k``. That distance goes along as ``_bound``, null if there are fewer."""
    centre = Window.partitionBy("frame_id", "centre_id")
    upto = centre.orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("_held", F.sum("_n").over(upto))
    found = found.withColumn("_bound", F.min(F.when(c("_held") >= k, c("_far"))).over(centre))
    return found.where(_reaches("_near")).select("frame_id", "centre_id", "c_x", "c_y", "c_z", "_bound", *[f"_q{i}" for i in range(3)])


def _reaches(distance: str | Column) -> Column:
    distance = c(distance) if isinstance(distance, str) else distance
    return c("_bound").isNull() | (distance <= c("_bound"))


def _uppermost(place: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """As ``_within_bound`` for the few uppermost nodes of each frame, which travel as one list: a centre meets all of
    them in its own row, so nothing is sorted or shuffled by centre. Blocks of centres are dealt over join keys and a
    frame's list travels to those its centres have."""
    axes, cell = ["x", "y", "z"], [f"_q{i}" for i in range(3)]
    place = place.withColumn("_salt", F.pmod(F.xxhash64(F.shiftright("centre_id", 10)), F.lit(SALTS)).cast("int"))
    lists = nodes.groupBy("frame_id").agg(F.collect_list(F.struct(*cell, "_n", *[p + a for a in axes for p in ("_lo_", "_hi_")])).alias("_nodes"))
    lists = shuffled_join(lists, place.select("frame_id", "_salt").distinct(), "frame_id")
    seen = F.transform("_nodes", lambda m: F.struct(
        cl.farthest2(axes, "c_", m.__getitem__).alias("far"), m["_n"].alias("n"), cl.nearest2(axes, "c_", m.__getitem__).alias("near"), *[m[q].alias(q) for q in cell]))
    found = shuffled_join(place, lists, ["frame_id", "_salt"]).withColumn("_seen", F.array_sort(seen)).drop("_nodes", "_salt")
    none = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(None).cast("double").alias("bound"))
    found = found.withColumn("_bound", F.aggregate("_seen", none, lambda acc, m: F.struct(
        (acc["held"] + m["n"]).alias("held"), F.coalesce(acc["bound"], F.when(acc["held"] + m["n"] >= k, m["far"])).alias("bound")), lambda acc: acc["bound"]))
    found = found.withColumn("_node", F.explode(F.filter("_seen", lambda m: _reaches(m["near"]))))
    return found.select("frame_id", "centre_id", "c_x", "c_y", "c_z", "_bound", *[c("_node")[q].alias(q) for q in cell])


def knn(points: DataFrame, centres: DataFrame, k: int, carry: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest points of every centre by (distance, point id), exact, with the ``carry`` columns of the points.

    The finest cells of a frame are counted once and rolled up to an octree of counts whose depth
    follows from the points of the frames and whose cells follow their extent; where the largest frame is small, its
    uppermost level is all. Every centre walks down: of the nodes it has reached it keeps those no farther than a distance within which
    ``k`` points surely lie, and opens only these. The distance goes down with them, so that nodes and points beyond it
    drop out where they are joined and are not shuffled. A centre far from all points prunes like any other. Frames
    with fewer points give all of them.
    """
    axes = ["x", "y", "z"]
    cell = [f"_q{i}" for i in range(3)]
    pts = cut_lineage(_keep_first_copies(points.select("frame_id", "point_id", *axes, *[a for a in carry if a not in axes]), k))
    # a surface of n points fills about n / k cells of 2**bits squared; three steps go down to them. Small frames stop two bits
    # earlier, which one step does: their few nodes meet the centres at once, while every further level is shuffled by centre
    most = pts.groupBy("frame_id").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    depth, finer = (1, -1) if most <= 128 * k else (3, 1)
    step = F.greatest(F.lit(1), F.round((F.log2(c("_n") / float(k)) / 2 + finer) / depth)).cast("int")
    # a step that may be null would put other null filters under each use of the levels, and each would be counted anew
    pts = cut_lineage(cl.with_cells(pts, axes, step * depth).withColumn("_step", F.coalesce((c("_bits") / depth).cast("int"), F.lit(1))).drop("_bits"))
    # points meet under the parent of their cell, where the finer levels are counted and joined without moving again
    parent = ["_p" + q for q in cell]
    above = [F.expr(f"shiftright({q}, _step)").alias("_p" + q) for q in cell]
    met = pts.select("*", *above).repartition("frame_id", *parent)
    placed = F.count(c("x") + c("y") + c("z"))  # a point without a place is no near one
    levels = [met.groupBy("frame_id", "_step", *parent, *cell).agg(placed.alias("_n"), *cl.bounds(axes))]
    for _ in range(depth - 1):
        up = levels[-1].groupBy("frame_id", "_step", *parent).agg(F.sum("_n").alias("_n"), *cl.merged_bounds(axes))
        levels.append(up.withColumnsRenamed(dict(zip(parent, cell))).select("*", *above))
    levels = levels[::-1]
    near, far = cl.nearest2(axes, "c_"), cl.farthest2(axes, "c_")
    kept = _uppermost(centres.select("frame_id", "centre_id", "c_x", "c_y", "c_z"), levels[0], k)
    for nodes in levels[1:]:
        opened = shuffled_join(kept.withColumnsRenamed(dict(zip(cell, parent))), nodes.drop("_step"), ["frame_id", *parent])
        kept = _within_bound(opened.withColumns({"_near": near, "_far": far}).where(_reaches("_near")), k)
    pairs = shuffled_join(pts, kept, ["frame_id", *cell]).withColumn("d2", _distance2()).where(_reaches("d2"))
    w = Window.partitionBy("frame_id", "centre_id").orderBy(c("d2").asc_nulls_last(), "point_id")
    return (pairs.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)
            .select("frame_id", "centre_id", "rank", "point_id", "d2", *carry))


def gather(points: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``index`` with the listed point columns."""
    return shuffled_join(index, points.select("frame_id", "point_id", *columns), ["frame_id", "point_id"])


def query_and_group(points: DataFrame, centres: DataFrame, index: DataFrame, radius: float | None = None) -> DataFrame:
    """Neighbour offsets to their centre, optionally divided by the radius."""
    rows = shuffled_join(gather(points, index, ["x", "y", "z", "intensity"]), centres, ["frame_id", "centre_id"])
    scale = radius or 1.0
    return rows.withColumns({f"o{k}": (c(k) - c("c_" + k)) / scale for k in "xyz"})


def three_interpolate(neighbours: DataFrame, points: DataFrame, feature: str) -> DataFrame:
    """Inverse-distance weighted mean of the feature over each centre's neighbours. Neighbours that carry the
    feature (see ``knn``) need no second look at the points."""
    rows = neighbours if feature in neighbours.columns else gather(points, neighbours, [feature])
    rows = rows.withColumn("_w", 1.0 / (F.sqrt("d2") + 1e-8))
    return rows.groupBy("frame_id", "centre_id").agg((F.sum(c("_w") * c(feature)) / F.sum("_w")).alias(feature))


def pair_distance(features: DataFrame, pairs: DataFrame, key: str, vector: str, norm: bool = False) -> DataFrame:
    """Squared (or size-normalised) distance of listed pairs of feature vectors."""
    left = features.select(c(key).alias("left_id"), c(vector).alias("_a"))
    right = features.select(c(key).alias("right_id"), c(vector).alias("_b"))
    diff = F.zip_with("_a", "_b", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    total = F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v)
    total = F.sqrt(total) / F.size("_a") if norm else total
    return shuffled_join(shuffled_join(pairs, left, "left_id"), right, "right_id").withColumn("distance", total).drop("_a", "_b")


# Box pairs --------------------------------------------------------------------------------

def box_pairs(left: DataFrame, right: DataFrame, size: float = 8.0, extra: list[str] | None = None) -> DataFrame:
    """Pairs (prefixes ``a_`` and ``b_``) whose ground bounds meet, each pair once."""
    keys = ["frame_id", *(extra or [])]

    def named(df, prefix):
        out = df.select(*keys, *[c(n).alias(prefix + n) for n in df.columns if n not in keys])
        bounds = bx.bev_bounds(bx.box(prefix))
        return out.withColumn(f"_{prefix}", F.array(*bounds))

    a, b = named(left, "a_"), named(right, "b_")
    a = spread_tiles(a, c("_a_")[0], c("_a_")[1], c("_a_")[2], c("_a_")[3], size)
    b = spread_tiles(b, c("_b_")[0], c("_b_")[1], c("_b_")[2], c("_b_")[3], size)
    meet = shuffled_join(a, b, [*keys, "_tx", "_ty"])
    first_x, first_y = F.greatest(c("_a_")[0], c("_b_")[0]), F.greatest(c("_a_")[1], c("_b_")[1])
    return meet.where(
        (first_x <= F.least(c("_a_")[2], c("_b_")[2])) & (first_y <= F.least(c("_a_")[3], c("_b_")[3]))
        & (c("_tx") == _tile(first_x, size)) & (c("_ty") == _tile(first_y, size))
    ).drop("_tx", "_ty", "_a_", "_b_")


def rectangles_touch(a: bx.Box, b: bx.Box) -> Column:
    """Separating-axis test of two turned ground rectangles (open: shared edges do not count)."""
    ddx, ddy = b.x - a.x, b.y - a.y
    co, si = F.abs(F.cos(a.yaw - b.yaw)), F.abs(F.sin(a.yaw - b.yaw))
    test = F.lit(True)
    for own, other in ((a, b), (b, a)):
        ox, oy = ddx * F.cos(own.yaw) - ddy * F.sin(own.yaw), ddx * F.sin(own.yaw) + ddy * F.cos(own.yaw)
        test = test & (F.abs(ox) < own.dx / 2 + other.dx / 2 * co + other.dy / 2 * si)
        test = test & (F.abs(oy) < own.dy / 2 + other.dx / 2 * si + other.dy / 2 * co)
    return test


def aabb_iou(a: list[Column], b: list[Column], eps: float = 1e-6) -> tuple[Column, Column]:
    """IoU and GIoU of axis-aligned bounds given as lows then highs."""
    n = len(a) // 2
    zero = F.lit(0.0)

    def product(cols):
        out = cols[0]
        for col in cols[1:]:
            out = out * col
        return out

    inter = product([F.greatest(F.least(a[i + n], b[i + n]) - F.greatest(a[i], b[i]), zero) for i in range(n)])
    area = [product([m[i + n] - m[i] for i in range(n)]) for m in (a, b)]
    union = F.greatest(area[0] + area[1] - inter, F.lit(eps))
    hull = F.greatest(product([F.greatest(a[i + n], b[i + n]) - F.least(a[i], b[i]) for i in range(n)]), F.lit(eps))
    return inter / union, inter / union - (hull - union) / hull


def box_bounds_3d(b: bx.Box) -> list[Column]:
    """Axis-aligned bounds ignoring yaw."""
    return [b.x - b.dx / 2, b.y - b.dy / 2, b.z, b.x + b.dx / 2, b.y + b.dy / 2, b.z + b.dz]


def height_overlap(a: bx.Box, b: bx.Box, mode: str = "lidar") -> Column:
    bottom_a, top_a = bx.bottom_top(a, mode)
    bottom_b, top_b = bx.bottom_top(b, mode)
    if mode == "camera":
        return F.greatest(F.least(bottom_a, bottom_b) - F.greatest(top_a, top_b), F.lit(0.0))
    return F.greatest(F.least(top_a, top_b) - F.greatest(bottom_a, bottom_b), F.lit(0.0))


def with_rotated_iou(pairs: DataFrame) -> DataFrame:
    """Ground overlap, ground IoU, 3D IoU and 3D overlap over the first volume of box pairs.

    Pairs that cannot touch are dropped by column tests first; the polygon clip runs
    vectorised over Arrow batches of the rest.
    """
    a, b = bx.box("a_"), bx.box("b_")
    near = pairs.where(rectangles_touch(a, b))
    args = [col for m in (a, b) for col in (m.x, m.y, m.dx, m.dy, m.yaw)]
    area = near.withColumn("overlap", rectangle_overlap_area(*args))
    flat = c("overlap") / F.greatest(a.dx * a.dy + b.dx * b.dy - c("overlap"), F.lit(1e-8))
    solid = c("overlap") * height_overlap(a, b)
    return area.withColumns({
        "iou_bev": flat,
        "iou_3d": solid / F.greatest(bx.volume(a) + bx.volume(b) - solid, F.lit(1e-8)),
        "iof_3d": solid / F.greatest(bx.volume(a), F.lit(1e-8))})


# Pooling over boxes -----------------------------------------------------------------------

def roi_cells(pairs: DataFrame, out: tuple[int, int, int]) -> DataFrame:
    """Sub-cell of the box (prefix ``b_``) that each inside point falls into."""
    b = bx.box("b_")
    lx, ly = bx.in_box_local(c("x"), c("y"), b)
    raw = ((lx + b.dy / 2) / (b.dy / out[0]), (ly + b.dx / 2) / (b.dx / out[1]), (c("z") - b.z) / (b.dz / out[2]))
    return pairs.withColumns({
        f"s{k}": F.greatest(F.least(v.cast("bigint"), F.lit(n - 1)), F.lit(0)) for k, v, n in zip("xyz", raw, out)})


def roi_pool(points: DataFrame, boxes: DataFrame, out: tuple[int, int, int], max_points: int, feature: str,
             how: str) -> DataFrame:
    """Max or mean of the first ``max_points - 1`` points in each sub-cell of each box."""
    cells = roi_cells(points_in_boxes_all(points, boxes), out)
    key = ["frame_id", "b_box_id", "sx", "sy", "sz"]
    w = Window.partitionBy(*key).orderBy("point_id")
    kept = cells.withColumn("_r", F.row_number().over(w)).where(c("_r") <= max_points - 1)
    fn = F.max if how == "max" else F.avg
    return kept.groupBy(*key).agg(fn(feature).alias(feature)).withColumnRenamed("b_box_id", "box_id")


def object_database(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per object: number of points inside and the mean of their offsets to the box centre;
    empty objects are kept."""
    pairs = points_in_boxes_all(points, boxes).select(
        "frame_id", c("b_box_id").alias("box_id"),
        *[(c(k) - c("b_" + k)).alias("o" + k) for k in "xyz"])
    counted = pairs.groupBy("frame_id", "box_id").agg(
        F.count("*").alias("num_points"), *[F.avg("o" + k).alias("m" + k) for k in "xyz"])
    return shuffled_join(boxes.select("frame_id", "box_id", "name"), counted, ["frame_id", "box_id"], "left").withColumn(
        "num_points", F.coalesce("num_points", F.lit(0).cast("bigint")))


def object_points(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points of every object, relative to the box centre."""
    return points_in_boxes_all(points, boxes).select(
        "frame_id", c("b_box_id").alias("box_id"), "point_id", *[(c(k) - c("b_" + k)).alias(k) for k in "xyz"])


# Matching ---------------------------------------------------------------------------------

def heuristic_assign(truth: DataFrame, predictions: DataFrame, limit: float) -> DataFrame:
    """Nearest same-class prediction of each truth box within ``limit``; a prediction taken
    twice keeps the nearer truth box. Both choices are aggregates, not windows."""
    t = truth.select("frame_id", "name", "gt_id", c("x").alias("c_x"), c("y").alias("c_y"))
    t = spread_tiles(t, c("c_x") - limit, c("c_y") - limit, c("c_x") + limit, c("c_y") + limit, limit)
    p = point_tiles(predictions.select("frame_id", "name", "pred_id", "x", "y"), limit)
    pairs = shuffled_join(t, p, [*TILE, "name"]).withColumn(
        "distance", F.sqrt((c("x") - c("c_x")) * (c("x") - c("c_x")) + (c("y") - c("c_y")) * (c("y") - c("c_y"))))
    near = pairs.where(c("distance") <= limit).groupBy("frame_id", "gt_id").agg(
        F.min(F.struct("distance", "pred_id")).alias("_m"))
    return near.select("frame_id", "gt_id", c("_m.pred_id").alias("pred_id"), c("_m.distance").alias("distance")) \
        .groupBy("frame_id", "pred_id").agg(F.min(F.struct("distance", "gt_id")).alias("_m")) \
        .select("frame_id", "pred_id", c("_m.gt_id").alias("gt_id"), c("_m.distance").alias("distance"))


def mask_to_box(boxes: DataFrame, masks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best overlapping 2D mask of each object by bounds, valid above ``threshold``."""
    pairs = box_pairs(boxes, masks)
    a, b = (box_bounds_3d(bx.box(p)) for p in ("a_", "b_"))
    iou, _ = aabb_iou([a[0], a[1], a[3], a[4]], [b[0], b[1], b[3], b[4]])
    best = pairs.withColumn("_iou", iou).groupBy("frame_id", c("a_box_id").alias("box_id")).agg(
        F.max(F.struct(c("_iou"), (-c("b_det_id")).alias("_neg"))).alias("_m"))
    return best.select("frame_id", "box_id", (-c("_m._neg")).alias("mask_id"), c("_m._iou").alias("iou"),
                       (c("_m._iou") > threshold).alias("valid"))
