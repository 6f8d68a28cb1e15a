"""Greedy suppression of overlapping detections.

The result equals the sequential rule "take the best remaining detection, drop everything
it suppresses" with ties broken by id. All groups run together, by priority:

* where tiles are crowded, every tile leader drops its own pile: a detection that is the best
  of all its tiles cannot be suppressed, and the others are compared with these leaders only,
  one or few a tile, so a pile of copies goes in one linear step;
* the overlap graph of the rest links each detection to the better ones it overlaps;
* in every round the detections without a better undecided neighbour are kept, and what they
  overlap is dropped, until no link is left. A task runs the rounds on the links of each batch as
  far as these allow; what depends on other batches waits for the next pass.

Nothing is gathered by group, so a group of any size is treated alike. Passes are cut by
reliable checkpoints, so a lost executor repeats one of them at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.functions.overlap import rectangle_overlap_area
from voxelmill.operators import joins as jn
from voxelmill.operators.topk import top_per_group
from voxelmill.session import cut_lineage
from voxelmill.skew import shuffled_join

c = F.col
CELL = 64.0  # side of the ground cells whose links a task decides together
GEOMETRY = ["x", "y", "z", "dx", "dy", "dz", "yaw"]


@dataclass(frozen=True)
class Rule:
    """When a kept detection suppresses another one: reach on the ground (column bounds of the
    tiles), and the test as a column on ``k_`` (the kept one) and plain names."""

    bounds: Callable[[], list[Column]]
    test: Callable[[], Column]


def rotated(threshold: float) -> Rule:
    """Ground IoU of turned rectangles above the threshold (0 or more)."""

    def test():
        cols = ("x", "y", "dx", "dy", "yaw")
        area = rectangle_overlap_area(*[c("k_" + k) for k in cols], *[c(k) for k in cols])
        total = c("k_dx") * c("k_dy") + c("dx") * c("dy")
        # the column test drops most pairs of a tile before any is clipped
        return jn.rectangles_touch(bx.box("k_"), bx.box()) & (area / F.greatest(total - area, F.lit(1e-8)) > threshold)

    return Rule(lambda: bx.bev_bounds(bx.box()), test)


def _axis_bounds() -> list[Column]:
    b = jn.box_bounds_3d(bx.box())
    return [b[0], b[1], b[3], b[4]]


def axis_aligned(threshold: float) -> Rule:
    """Ground IoU of the unrotated rectangles above the threshold."""

    def test():
        a, b = jn.box_bounds_3d(bx.box("k_")), jn.box_bounds_3d(bx.box())
        iou, _ = jn.aabb_iou([a[0], a[1], a[3], a[4]], [b[0], b[1], b[3], b[4]], 1e-8)
        return iou > threshold

    return Rule(_axis_bounds, test)


def aligned_3d(threshold: float) -> Rule:
    """3D IoU of axis-aligned boxes above the threshold; classes are separated by the key."""

    def test():
        iou, _ = jn.aabb_iou(jn.box_bounds_3d(bx.box("k_")), jn.box_bounds_3d(bx.box()), 0.0)
        return iou > threshold

    return Rule(_axis_bounds, test)


def circle(threshold: float) -> Rule:
    """Squared centre distance at most ``threshold``."""
    half = math.sqrt(threshold) / 2 + 1e-9

    def test():
        dx, dy = c("k_x") - c("x"), c("k_y") - c("y")
        return dx * dx + dy * dy <= threshold

    return Rule(lambda: [c("x") - half, c("y") - half, c("x") + half, c("y") + half], test)


def suppress(dets: DataFrame, keys: Sequence[str], ident: str, rule: Rule, tile: float = 4.0, crowd: int = 32) -> DataFrame:
    """Kept detections of every group, with all their columns. While the tiles hold more than ``crowd``
    pairs a detection, leaders thin them out first; ``tile`` and ``crowd`` only tune the cost."""
    keys = list(keys)
    row = [*keys, ident]
    named = cut_lineage(dets.withColumn("_b", F.array(*rule.bounds())))
    rest, gone = named.select(*row, "score", *GEOMETRY, "_b"), []
    while _crowded(rest, keys, tile, crowd):
        leaders, lost = _leader_piles(rest, keys, ident, rule, tile)
        marked = shuffled_join(rest, leaders.unionByName(lost), row, "left")
        marked = cut_lineage(marked)
        gone.append(marked.where("_lost").select(*row))
        rest = marked.where("_lost IS NULL").drop("_lost")
    links = cut_lineage(_links(rest, keys, ident, rule, tile))
    while True:
        links = cut_lineage(_decide(links, keys))
        lost, links = links.where("w IS NULL").select(*keys, "l"), links.where("w IS NOT NULL").select(*keys, "l", "w", "_cell")
        gone.append(lost.withColumnRenamed("l", ident))
        if links.isEmpty():
            break
        for end in ("l", "w"):
            links = shuffled_join(links, lost.withColumnRenamed("l", end), [*keys, end], "left_anti")
    for lost in gone:
        named = shuffled_join(named, lost, row, "left_anti")
    return named.select(*dets.columns)


def _tiles(rows: DataFrame, tile: float) -> DataFrame:
    return jn.spread_tiles(rows, c("_b")[0], c("_b")[1], c("_b")[2], c("_b")[3], tile)


def _crowded(rest: DataFrame, keys: list[str], tile: float, crowd: int) -> bool:
    """Whether pairing the rows of each tile would list more than ``crowd`` pairs a row."""
    sizes = _tiles(rest, tile).groupBy(*keys, "_tx", "_ty").agg(F.count("*").cast("double").alias("n"))
    pairs = sizes.agg(F.sum(c("n") * (c("n") - 1) / 2).alias("pairs"), F.sum("n").alias("rows")).first()
    return bool(pairs.pairs and pairs.pairs > crowd * pairs.rows)


def _leader_piles(rest: DataFrame, keys: list[str], ident: str, rule: Rule, tile: float) -> tuple[DataFrame, DataFrame]:
    """Rows that lead all their tiles, and the rows that these suppress, with the flag ``_lost``."""
    row, at = [*keys, ident], [*keys, "_tx", "_ty"]
    listed = _tiles(rest, tile)
    best = listed.groupBy(*at).agg(F.max(F.struct(c("score"), (-c(ident)).alias("_neg"))).alias("_top"))
    ahead = shuffled_join(listed, best, at).groupBy(*row).agg(F.min((-c("_top._neg") == c(ident)).cast("int")).alias("_wins"))
    won = cut_lineage(shuffled_join(rest, ahead.where(c("_wins") == 1).select(*row), row, "left_semi"))
    near = _tiles(won, tile).select(*at, c(ident).alias("k_id"), *[c(g).alias("k_" + g) for g in GEOMETRY])
    lost = shuffled_join(listed.select(*row, "_tx", "_ty", *GEOMETRY), near, at).where(c("k_id") != c(ident)).where(rule.test())
    return won.select(*row, F.lit(False).alias("_lost")), lost.select(*row).distinct().withColumn("_lost", F.lit(True))


def _links(rest: DataFrame, keys: list[str], ident: str, rule: Rule, tile: float) -> DataFrame:
    """(keys, l, w, _cell): l, which lies in a ground cell, is suppressed if w is kept. A pair is listed in the tile of
    its first common corner."""
    at = [*keys, "_tx", "_ty"]
    better = _tiles(rest, tile).select(*at, c(ident).alias("w"), c("score").alias("k_score"), c("_b").alias("k_b"), *[c(g).alias("k_" + g) for g in GEOMETRY])
    pairs = shuffled_join(_tiles(rest, tile).withColumnRenamed(ident, "l"), better, at)
    ahead = (c("k_score") > c("score")) | ((c("k_score") == c("score")) & (c("w") < c("l")))
    first = [F.floor(F.greatest(c("_b")[i], c("k_b")[i]) / tile) for i in (0, 1)]
    return pairs.where(ahead & (c("_tx") == first[0]) & (c("_ty") == first[1])).where(rule.test()).select(
        *keys, "l", "w", F.struct(F.floor(c("x") / CELL).alias("x"), F.floor(c("y") / CELL).alias("y")).alias("_cell"))


def _decide(links: DataFrame, keys: list[str]) -> DataFrame:
    """Priority rounds inside the Arrow batches of the links, which lie together by ground cell.

    A batch knows which winners are no losers anywhere (these are kept) and how many links each loser has,
    so whatever part of the graph it holds, it decides only what it can be sure of. Dropped rows come back
    without ``w``, links between rows that are still undecided stay for the next pass.
    """
    losers = links.select(*keys, c("l").alias("w")).distinct().withColumn("_doubt", F.lit(True))
    known = shuffled_join(links.withColumn("_all", F.count("*").over(Window.partitionBy(*keys, "l"))), losers, [*keys, "w"], "left")
    known = known.select(*keys, "l", "w", "_cell", c("_doubt").isNull().alias("_free"), "_all")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            ends = pd.DataFrame({"g": np.tile(group, 2), "i": np.concatenate([pdf.l.to_numpy(), pdf.w.to_numpy()])})
            node = ends.groupby(["g", "i"], sort=False).ngroup().to_numpy()
            lose, win = node[: len(pdf)], node[len(pdf) :]
            count = node.max(initial=-1) + 1
            kept, lost = np.zeros(count, bool), np.zeros(count, bool)
            kept[win[pdf._free.to_numpy()]] = True
            links_of = np.zeros(count, np.int64)
            links_of[lose] = pdf._all.to_numpy()
            before = -1
            while before != kept.sum() + lost.sum():
                before = kept.sum() + lost.sum()
                lost[lose[kept[win]]] = True
                beaten = np.bincount(lose[lost[win]], minlength=count)
                kept |= (links_of > 0) & (beaten == links_of) & ~lost
            first = ~pd.Series(lose).duplicated().to_numpy() & lost[lose]
            open_ = ~lost[lose] & ~kept[lose] & ~lost[win]
            pdf = pdf[[*keys, "l", "w", "_cell"]].astype({"w": "Int64"})
            yield pd.concat([pdf[first].assign(w=pd.NA).astype({"w": "Int64"}), pdf[open_]])

    near = known.repartition(*keys, "_cell").sortWithinPartitions(*keys, "_cell")
    return near.mapInPandas(decide, links.select(*keys, "l", "w", "_cell").schema)


def nms(dets: DataFrame, keys: Sequence[str], ident: str, rule: Rule, pre_max: int | None = None,
        post_max: int | None = None, **kw) -> DataFrame:
    """Suppression with the detector's limits before and after."""
    order = [c("score").desc(), c(ident)]
    if pre_max is not None:
        dets = top_per_group(dets, keys, order, pre_max, "_r").drop("_r")
    kept = suppress(dets, keys, ident, rule, **kw)
    return top_per_group(kept, keys, order, post_max, "_r").drop("_r") if post_max is not None else kept


def multiclass_nms(dets: DataFrame, ident: str, rule: Rule, score_threshold: float, max_num: int, **kw) -> DataFrame:
    """Suppression per class above a score, then the best ``max_num`` of the frame."""
    kept = suppress(dets.where(c("score") > score_threshold), ["frame_id", "name"], ident, rule, **kw)
    return top_per_group(kept, ["frame_id"], [c("score").desc(), c(ident)], max_num, "_r").drop("_r")


def task_nms(dets: DataFrame, ident: str, tasks: Sequence[dict], post_max: int = 83, **kw) -> DataFrame:
    """Class groups with their own centre radius; a group without radius keeps everything.
    ``scale`` optionally enlarges the boxes of a class for the test only."""
    out = None
    for number, task in enumerate(tasks):
        part = dets.where(c("name").isin(*task["classes"])).withColumn("task", F.lit(number))
        radius = task.get("radius")
        if radius is not None and radius > 0:
            part = nms(part, ["frame_id", "task"], ident, circle(radius), post_max=post_max, **kw)
        out = part if out is None else out.unionByName(part)
    return out


def combine_scores(heat: Column, query_score: Column, label: Column, own: Column) -> Column:
    """Sigmoid of the class logit times the query score, only for the query's own class."""
    return F.when(label == own, 1.0 / (1.0 + F.exp(-heat)) * query_score).otherwise(F.lit(0.0))
