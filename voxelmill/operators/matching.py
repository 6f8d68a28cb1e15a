"""Match costs, optimal assignment per frame, sampling of negatives by overlap band."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions.overlap import overlap_area
from voxelmill.functions.random import draw, slice_of
from voxelmill.operators.batches import group_ids, map_groups
from voxelmill.skew import with_row_number

c = F.col
PAIRS = 1 << 16  # costs that are computed at once


def bev_l1_cost(extent: Sequence[float], weight: float) -> Column:
    """Distance of the centres along both axes after scaling by the range extent."""
    return (F.abs(c("a_x") - c("b_x")) / extent[0] + F.abs(c("a_y") - c("b_y")) / extent[1]) * weight


def box_l1_cost(weight: float) -> Column:
    total = None
    for n in ("x", "y", "z", "dx", "dy", "dz"):
        d = F.abs(c("a_" + n) - c("b_" + n))
        total = d if total is None else total + d
    return total * weight


def optimal_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row (rows <= columns) with the least total cost: shortest augmenting
    paths with dual prices, each path step vectorised over the columns."""
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of, col_of = np.full(m, -1), np.full(n, -1)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, reached = start, 0.0
        while True:
            path = reached + cost[row] - row_price[row] - col_price
            better = ~done & (path < dist)
            dist[better] = path[better]
            via[better] = row
            col = int(np.argmin(np.where(done, np.inf, dist)))
            reached = dist[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        row_price[start] += reached
        settled = done & (row_of >= 0)
        row_price[row_of[settled]] += reached - dist[settled]
        col_price[done] -= reached - dist[done]
        while True:  # flip the path back to the start row
            row = via[col]
            col_of[row], col = col, col_of[row]
            row_of[col_of[row]] = row
            if row == start:
                break
    return col_of


def hungarian_assign(predictions: DataFrame, truth: DataFrame, extent: Sequence[float],
                     weights: Sequence[float] = (0.15, 0.25, 0.25)) -> DataFrame:
    """Optimal prediction-to-truth assignment per frame; unmatched predictions get gt_id -1.

    Cost = weighted class cost + scaled ground L1 + (negative) 3D IoU. An optimal assignment
    needs all costs of a frame at once, so a frame is one group whatever its size. Costs of many frames
    are computed together, those of a large frame in strips of predictions. Frames run in parallel.
    """
    w_cls, w_l1, w_iou = weights
    ex, ey = extent
    shape = ["x", "y", "z", "dx", "dy", "dz", "yaw"]

    def costs(rows: dict[str, np.ndarray], pred: np.ndarray, gt: np.ndarray) -> np.ndarray:
        """Cost of each pair of row numbers."""
        p, g = ({k: v[at] for k, v in rows.items()} for at in (pred, gt))
        area = overlap_area(*[side[k] for side in (p, g) for k in ("x", "y", "dx", "dy", "yaw")])
        high = np.maximum(np.minimum(p["z"] + p["dz"], g["z"] + g["dz"]) - np.maximum(p["z"], g["z"]), 0.0)
        inter = area * high
        iou = inter / np.maximum(p["dx"] * p["dy"] * p["dz"] + g["dx"] * g["dy"] * g["dz"] - inter, 1e-8)
        cls = -np.where(p["name"] == g["name"], p["score"], (1 - p["score"]) / 5).astype(float)
        l1 = np.abs(p["x"] - g["x"]) / ex + np.abs(p["y"] - g["y"]) / ey
        return w_cls * cls + w_l1 * l1 - w_iou * iou

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {k: pdf[k].to_numpy(float) for k in (*shape, "score")} | {"name": pdf["name"].to_numpy()}
        ident = pdf["_id"].to_numpy()
        first = np.flatnonzero(np.diff(group_ids(pdf, ["frame_id"]), prepend=-1))
        last = np.append(first[1:], len(pdf))
        middle = first + np.add.reduceat((pdf["_side"] == 0).to_numpy().astype(int), first)  # truth boxes start here
        gt_id, cost = np.full(len(pdf), -1, np.int64), np.full(len(pdf), np.nan)
        pairs = (middle - first) * (last - middle)
        block = np.cumsum(pairs) // PAIRS  # frames whose costs are computed together
        for number in np.unique(block[pairs > 0]):
            frames = np.flatnonzero((block == number) & (pairs > 0))
            strips = [(np.arange(first[f], middle[f]), np.arange(middle[f], last[f])) for f in frames]
            if len(frames) == 1:  # a frame of any size
                (pred, gt), step = strips[0], max(PAIRS // len(strips[0][1]), 1)
                parts = [pred[k : k + step] for k in range(0, len(pred), step)]
                found = [np.concatenate([costs(rows, np.repeat(part, len(gt)), np.tile(gt, len(part))) for part in parts])]
            else:
                flat = costs(rows, *(np.concatenate(side) for side in zip(*[(np.repeat(p, len(g)), np.tile(g, len(p))) for p, g in strips])))
                found = np.split(flat, np.cumsum(pairs[frames])[:-1])
            for (pred, gt), table in zip(strips, found):
                table = table.reshape(len(pred), len(gt))
                if len(pred) >= len(gt):
                    left, right = optimal_assignment(table.T), np.arange(len(gt))
                else:
                    left, right = np.arange(len(pred)), optimal_assignment(table)
                gt_id[pred[left]], cost[pred[left]] = ident[gt[right]], table[left, right]
        out = pd.DataFrame({"frame_id": pdf["frame_id"], "pred_id": ident, "gt_id": gt_id, "cost": cost})
        return out[(pdf["_side"] == 0).to_numpy()]

    left = predictions.select("frame_id", F.lit(0).alias("_side"), c("pred_id").alias("_id"), "score", "name", *shape)
    right = truth.select("frame_id", F.lit(1).alias("_side"), c("gt_id").alias("_id"), F.lit(0.0).alias("score"), "name", *shape)
    return map_groups(left.unionByName(right), ["frame_id"], [c("_side"), c("_id")], assign,
                      "frame_id bigint, pred_id bigint, gt_id bigint, cost double")


def negative_piecewise_sample(negatives: DataFrame, expected: int, edges: Sequence[float],
                              fractions: Sequence[float], seed: int) -> DataFrame:
    """Negatives drawn by descending overlap bands; a band's shortfall moves to the next.

    ``edges`` are the upper band limits, highest first. Quotas per frame come from band
    counts (one row per frame and band), then every band keeps its lowest draws.
    """
    bands = len(fractions)
    lows = [*edges[1:], 0.0]
    band = None
    for i in range(bands):
        test = (c("overlap") >= lows[i]) & (c("overlap") < edges[i])
        band = F.when(test, i) if band is None else band.when(test, i)
    rows = negatives.withColumn("band", band)
    counts = rows.groupBy("frame_id").agg(
        F.count("*").alias("_all"), *[F.sum((c("band") == i).cast("int")).alias(f"_n{i}") for i in range(bands)])
    # shortfall is carried on; the last band takes what is still missing
    extra, taken = F.lit(0), F.lit(0)
    for i in range(bands):
        want = F.lit(expected) - taken if i == bands - 1 else F.lit(int(expected * fractions[i])) + extra
        counts = counts.withColumn(f"_w{i}", want.cast("int"))
        short = c(f"_n{i}") < c(f"_w{i}")
        counts = counts.withColumn(f"_t{i}", F.when(short, c(f"_n{i}")).otherwise(c(f"_w{i}")).cast("int"))
        counts = counts.withColumn(f"_e{i}", F.when(short, (extra if i else F.lit(0)) + c(f"_w{i}") - c(f"_n{i}")).otherwise(0).cast("int"))
        extra, taken = c(f"_e{i}"), taken + c(f"_t{i}")
    quota = counts.select("frame_id", "_all", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), c(f"_t{i}").alias("quota")) for i in range(bands)])).alias("_q"))
    quota = quota.select("frame_id", "_all", "_q.band", "_q.quota")
    rows = rows.withColumn("_draw", draw(seed, "neg_id", "frame_id"))
    ranked = with_row_number(rows.where(c("band").isNotNull()), ["frame_id", "band"], [c("_draw"), c("neg_id")],
                             slice_of(c("_draw"), 64), "_rank")
    picked = ranked.join(quota, ["frame_id", "band"]).where((c("_rank") <= c("quota")) & (c("_all") > expected))
    # small frames keep every negative, whatever its band
    small = rows.join(counts.select("frame_id", "_all"), "frame_id").where(c("_all") <= expected)
    return picked.select("frame_id", "neg_id", "overlap").unionByName(small.select("frame_id", "neg_id", "overlap"))
