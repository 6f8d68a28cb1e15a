"""Top-k selections, image calibration and 2D re-projection of boxes.

Rank filters keep at most ``k`` rows per group; Spark drops the rest inside each input
task before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.functions.random import draw, uniform
from voxelmill.operators.points import lidar_to_camera

c = F.col


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(c(out) <= k)


def top_proposals(heat: DataFrame, k: int, rows: int, cols: int) -> DataFrame:
    """Top cells of a frame over all classes, with class and cell taken from the flat index."""
    flat = heat.select("frame_id", "score", ((c("class_id") * rows + c("row")) * cols + c("col")).cast("bigint").alias("flat"))
    top = top_per_group(flat, ["frame_id"], [c("score").desc(), c("flat")], k)
    return top.select("frame_id", F.floor(c("flat") / (rows * cols)).cast("int").alias("class_id"),
                      (c("flat") % (rows * cols)).alias("ind"), "rank")


def two_stage_topk(heat: DataFrame, k: int, cols: int) -> DataFrame:
    """Top ``k`` cells of each class, then of the frame; x and y are swapped on purpose."""
    cells = heat.select("frame_id", "class_id", "score", (c("row") * cols + c("col")).alias("ind"))
    per_class = top_per_group(cells, ["frame_id", "class_id"], [c("score").desc(), c("ind")], k)
    top = top_per_group(per_class, ["frame_id"], [c("score").desc(), c("class_id"), c("ind")], k)
    return top.withColumns({"xs": F.floor(c("ind") / cols), "ys": c("ind") % cols})


def top_queries(scores: DataFrame, k: int, classes: int) -> DataFrame:
    """Top flat scores per frame; label and query are the rest and quotient of the index. Scores may be exploded from a
    small file that one task reads: they are dealt over tasks before any of them sorts its rows."""
    dealt = scores.repartition("frame_id", F.pmod(F.xxhash64("flat"), F.lit(8)))
    top = top_per_group(dealt, ["frame_id"], [c("s").desc(), c("flat")], k)
    return top.withColumns({"label": c("flat") % classes, "query": F.floor(c("flat") / classes)})


def image_calibration(images: DataFrame, size: tuple[int, int], final: tuple[int, int], resize: tuple[float, float],
                      max_turn: float, seed: int) -> DataFrame:
    """2D matrix of a random resize, crop, flip and turn per image."""
    (h, w), (fh, fw) = size, final
    p = images.withColumns({
        "_s": F.lit(resize[0]) + (resize[1] - resize[0]) * uniform(seed, "record_id"),
        "_flip": draw(seed + 1, "record_id") % 2 == 0,
        "_th": (F.lit(-max_turn) + 2 * max_turn * uniform(seed + 2, "record_id")) / 180.0 * math.pi,
        "_cu": uniform(seed + 3, "record_id")})
    new_w, new_h = (c("_s") * w).cast("bigint"), (c("_s") * h).cast("bigint")
    p = p.withColumns({
        "_cw": (c("_cu") * F.greatest(new_w - fw, F.lit(0))).cast("bigint").cast("double"),
        "_ch": (new_h - fh).cast("double")})
    a = F.when(c("_flip"), -c("_s")).otherwise(c("_s"))
    tx = F.when(c("_flip"), c("_cw") + float(fw)).otherwise(-c("_cw"))
    p = p.withColumns({"_a": a, "_tx": tx, "_ty": -c("_ch"), "_co": F.cos("_th"), "_si": F.sin("_th")})
    mx, my = fw / 2, fh / 2
    return p.withColumns({
        "m00": c("_co") * c("_a"), "m01": c("_si") * c("_s"),
        "m10": -c("_si") * c("_a"), "m11": c("_co") * c("_s"),
        "m02": c("_co") * c("_tx") + c("_si") * c("_ty") + (c("_co") * -mx + c("_si") * -my + mx),
        "m12": -c("_si") * c("_tx") + c("_co") * c("_ty") + (-c("_si") * -mx + c("_co") * -my + my)})


def clipped_hulls(u: np.ndarray, v: np.ndarray, valid: np.ndarray, width: float, height: float) -> np.ndarray:
    """Bounds (x1, y1, x2, y2) of the part of each row's convex hull on the canvas, nan without one.

    Rows hold some points; ``valid`` says which count. The extreme places of hull and canvas are ends of
    segments between two points, cut at the canvas, and corners of the canvas inside the hull. All rows are
    cut at once, a segment and a border at a time.
    """
    low, high = np.full((len(u), 2), np.inf), np.full((len(u), 2), -np.inf)

    def reach(x, y, use):
        for k, at in enumerate((x, y)):
            low[:, k] = np.where(use, np.minimum(low[:, k], at), low[:, k])
            high[:, k] = np.where(use, np.maximum(high[:, k], at), high[:, k])

    sides = [(u, width - u), (v, height - v)]
    for i in range(u.shape[1]):
        for j in range(i, u.shape[1]):
            first, last, use = np.zeros(len(u)), np.ones(len(u)), valid[:, i] & valid[:, j]
            for side in (f for pair in sides for f in pair):
                f, g = side[:, i], side[:, j]
                t = f / np.where(f == g, 1.0, f - g)
                first = np.where(f < 0, np.maximum(first, t), first)
                last = np.where(g < 0, np.minimum(last, t), last)
                use = use & ~((f < 0) & (g < 0))
            use = use & (first <= last)
            for t in (first, last):
                reach(u[:, i] + t * (u[:, j] - u[:, i]), v[:, i] + t * (v[:, j] - v[:, i]), use)
    some = valid.any(1)
    for x in (0.0, width):
        for y in (0.0, height):
            turn = np.where(valid, np.arctan2(v - y, u - x), np.nan)
            turn = np.sort(np.where(valid, turn, np.nanmin(np.where(some[:, None], turn, 0.0), axis=1, keepdims=True)), axis=1)
            gap = np.maximum(np.diff(turn, axis=1).max(1, initial=0.0), 2 * math.pi - (turn[:, -1] - turn[:, 0]))
            reach(x, y, some & (gap < math.pi))
    out = np.concatenate([low, high], axis=1)
    out[~np.isfinite(out).all(1)] = np.nan
    return out


def clipped_bounds(corners: np.ndarray, width: float, height: float) -> list[float] | None:
    """``clipped_hulls`` of one set of points."""
    u, v = corners[None, :, 0], corners[None, :, 1]
    (row,) = clipped_hulls(u, v, np.ones(u.shape, bool), width, height)
    return None if np.isnan(row).any() else row.tolist()


def reproject_boxes(boxes: DataFrame, k, canvas: tuple[int, int], near: float = 0.0) -> DataFrame:
    """2D bounds of each LiDAR box on the canvas: the convex hull of the corners deeper than ``near``, cut at the
    canvas border, its area, and the projected centre (``centre_u``, ``centre_v``, ``depth``). Boxes without common
    area with the canvas or with their centre behind the camera are dropped."""
    width, height = float(canvas[0]), float(canvas[1])

    @F.pandas_udf("x1 double, y1 double, x2 double, y2 double")
    def bounds(xs: pd.Series, ys: pd.Series, ds: pd.Series) -> pd.DataFrame:
        x, y, d = (np.stack(s.to_numpy()) for s in (xs, ys, ds)) if len(xs) else [np.zeros((0, 8))] * 3
        valid = d > near
        div = np.where(valid, d, 1.0)
        return pd.DataFrame(clipped_hulls(x / div, y / div, valid, width, height), columns=["x1", "y1", "x2", "y2"])

    def plane(x, y, z):
        """Image coordinates before the division by depth, and the depth."""
        x, y, z = lidar_to_camera(x, y, z)
        return [x * row[0] + y * row[1] + z * row[2] for row in k]

    def part(i):
        return lambda p: plane(p.x, p.y, p.z)[i]

    pts = boxes.withColumn("_p", bx.corners_array(bx.box()))
    flat = pts.withColumns({f"_f{i}": F.transform("_p", part(i)) for i in range(3)})
    u, v, depth = plane(c("x"), c("y"), c("z") + c("dz") / 2)
    out = flat.withColumns({"_b": bounds("_f0", "_f1", "_f2"), "_u": u, "_v": v, "depth": depth}).where(c("depth") > near)
    out = out.withColumns({n: c("_b")[n] for n in ("x1", "y1", "x2", "y2")}).where(c("x1").isNotNull() & ~F.isnan("x1"))
    return out.withColumns({"area": (c("x2") - c("x1")) * (c("y2") - c("y1")), "centre_u": c("_u") / c("depth"), "centre_v": c("_v") / c("depth")}).drop(
        "_p", "_b", "_u", "_v", *[f"_f{i}" for i in range(3)])
