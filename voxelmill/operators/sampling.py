"""Seeded sampling of points, frames and objects.

Ranks by draw use draw ranges as slices, so a frame with any number of points is ranked
by many tasks. Limits here are the sampling feature itself; nothing else is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.functions.random import array_normal, array_uniform, draw, key_words, slice_of, uniform
from voxelmill.operators import cells as cl
from voxelmill.operators import joins as jn
from voxelmill.operators import voxels as vx
from voxelmill.operators.batches import group_ids, map_groups
from voxelmill.operators.topk import top_per_group
from voxelmill.session import cut_lineage
from voxelmill.skew import exact_quantiles, shuffled_join, split_by_group_size, spread_join, value_slices, with_lag, with_row_number, with_running

c = F.col


def ranked_by_draw(df: DataFrame, keys: Sequence[str], ident: str, seed: int, out: str = "rank",
                   slices: int = 64) -> DataFrame:
    """1-based position of each row in a seeded random order per key."""
    df = df.withColumn("_draw", draw(seed, ident, *keys))
    return with_row_number(df, keys, [c("_draw"), c(ident)], slice_of(c("_draw"), slices), out).drop("_draw")


def point_shuffle(points: DataFrame, seed: int) -> DataFrame:
    """New point ids in random order."""
    return ranked_by_draw(points, ["frame_id"], "point_id", seed, "_r").withColumn("new_id", c("_r") - 1).drop("_r")


def pad_or_drop(points: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows per frame: a random subset, or all rows plus zero rows with mask 0."""
    counts = points.groupBy("frame_id").agg(F.count("*").alias("_n"))
    kept = (ranked_by_draw(points, ["frame_id"], "point_id", seed).where(c("rank") <= n)
            .select("frame_id", c("point_id"), "x", "y", F.lit(1).alias("mask")))
    pads = counts.where(c("_n") < n).select("frame_id", F.explode(F.sequence(c("_n"), F.lit(n - 1))).alias("point_id"))
    return kept.unionByName(pads.select("frame_id", "point_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("mask")))


def point_sample(points: DataFrame, n: int, seed: int, far: Column | None = None) -> DataFrame:
    """``n`` points per frame: without replacement when there are enough (far points first
    if asked), else with replacement by hashed row position."""
    counts = points.groupBy("frame_id").agg(F.count("*").alias("_n"))
    first = F.when(far, 0).otherwise(1) if far is not None else F.lit(0)
    drawn = points.withColumns({"_f": first, "_draw": draw(seed, "point_id", "frame_id")})
    ranked = with_row_number(drawn, ["frame_id"], [c("_f"), c("_draw"), c("point_id")],
                             c("_f") * 64 + slice_of(c("_draw"), 64), "_rank")
    enough = (ranked.join(counts.where(c("_n") >= n), "frame_id").where(c("_rank") <= n)
              .select("frame_id", (c("_rank") - 1).alias("slot"), "point_id"))
    wanted = (counts.where(c("_n") < n)
              .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
              .withColumn("point_id", draw(seed + 1, "slot", "frame_id") % c("_n")))
    refill = wanted.join(points.select("frame_id", "point_id"), ["frame_id", "point_id"])
    return enough.unionByName(refill.select("frame_id", "slot", "point_id"))


def shift_height(points: DataFrame) -> DataFrame:
    """Height above the frame's floor, the 0.99-th percentile of z."""
    floor = exact_quantiles(points, ["frame_id"], "z", [0.0099], ["_floor"])
    return points.join(floor, "frame_id").withColumn("height", c("z") - c("_floor")).drop("_floor")


def choose_sweeps(sweeps: DataFrame, n: int, train: bool, seed: int) -> DataFrame:
    """All sweeps when there are at most ``n``; else the nearest (test) or random (train) ones.
    Chains are at most 10 long, so the rank works on tiny groups."""
    if not train:
        return sweeps.where(c("rank") < n)
    drawn = sweeps.withColumn("_draw", draw(seed, "rank", "record_id"))
    return top_per_group(drawn, ["record_id"], [c("_draw"), c("rank")], n, "_r").drop("_r", "_draw")


def frame_dropout(points: DataFrame, prob: float, seed: int) -> DataFrame:
    """Drop whole sweeps with probability ``prob``; the keyframe (time 0) always stays. The
    draw depends only on (frame, sweep), so no join is needed."""
    step = F.round(c("time") * 1000).cast("bigint")
    return points.where((c("time") == 0) | (uniform(seed, "frame_id", step) >= prob))


def unique_resample(index: DataFrame, n: int) -> DataFrame:
    """Each group's distinct members, then repeats by hashed position up to ``n`` slots.
    Groups come from a neighbour query with a fixed sample number, so the array is small."""
    groups = index.groupBy("frame_id", "centre_id").agg(F.array_sort(F.collect_set("point_id")).alias("ids"))
    groups = groups.withColumn("unique_count", F.size("ids")).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.when(c("slot") < c("unique_count"), c("slot")).otherwise((c("slot") * 31 + c("centre_id")) % c("unique_count"))
    return groups.select("frame_id", "centre_id", "slot", F.get(c("ids"), at.cast("int")).alias("point_id"), "unique_count")


def assign_scores(index: DataFrame, points: DataFrame, feature: str, scores: Column, kernels: int) -> DataFrame:
    """Sum over neighbours of score times (neighbour minus centre feature), one column per kernel."""
    near = jn.gather(points, index, [feature])
    centre = points.select("frame_id", c("point_id").alias("centre_id"), c(feature).alias("_centre"))
    rows = shuffled_join(near, centre, ["frame_id", "centre_id"]).withColumn("_s", scores)
    diff = c(feature) - c("_centre")
    return rows.groupBy("frame_id", "centre_id").agg(*[F.sum(c("_s")[k] * diff).alias(f"k{k}") for k in range(kernels)])


def class_balanced_sample(frame_classes: DataFrame, classes: int, seed: int) -> DataFrame:
    """Frames drawn with replacement so that every class gets an equal share.

    ``frame_classes`` has distinct (frame_id, name). Classes without a frame do not occur
    and draw nothing. Frames are numbered per class in slices, drawn positions join back.
    """
    counts = frame_classes.groupBy("name").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    quota = counts.withColumn("_total", total).withColumn(
        "_draws", F.floor(c("_n") * ((F.lit(1.0) / classes) / (c("_n") / c("_total")))))
    numbered = with_row_number(frame_classes, ["name"], [c("frame_id")], F.expr("frame_id div 65536"), "_pos")
    key = F.conv(F.substring(F.md5("name"), 1, 7), 16, 10).cast("bigint")
    # draws are generated in blocks so that one class never expands in a single row
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(_draws - 1) div 4096")))
    drawn = (quota.where(c("_draws") > 0).withColumn("_b", block)
             .withColumn("draw_id", F.explode(F.sequence(c("_b") * 4096, F.least(c("_b") * 4096 + 4095, c("_draws") - 1))))
             .withColumn("_pos", draw(seed, "draw_id", key) % c("_n") + 1))
    return drawn.join(numbered, ["name", "_pos"]).select("name", "draw_id", "frame_id")


def batch_order(objects: DataFrame, ident: str, group: str, cycle: int, seed: int) -> DataFrame:
    """Position of every object of a class in the shuffle of one cycle (no repeats per cycle)."""
    return ranked_by_draw(objects, [group], ident, seed + cycle, "_r").withColumn("pos", c("_r") - 1).drop("_r")


def batches(objects: DataFrame, ident: str, group: str, size: int, cycles: int, seed: int) -> DataFrame:
    """Batches of a class over several shuffled cycles; the last batch of a cycle may be short."""
    out = None
    for k in range(cycles):
        part = batch_order(objects, ident, group, k, seed).withColumns(
            {"cycle": F.lit(k), "batch": F.expr(f"pos div {size}")})
        out = part if out is None else out.unionByName(part)
    return out


def replace_invalid_frames(frames: DataFrame, valid: DataFrame, groups: int, seed: int) -> DataFrame:
    """Frames rejected by the filters are replaced by a random valid frame of the same group."""
    grouped = valid.select("frame_id").distinct().withColumn("grp", F.pmod(c("frame_id"), F.lit(groups)))
    numbered = with_row_number(grouped, ["grp"], [c("frame_id")], F.expr("frame_id div 65536"), "_pos")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("_n"))
    keep = frames.join(valid.select("frame_id").distinct(), "frame_id", "left_semi").withColumn("used", c("frame_id"))
    lost = (frames.join(valid.select("frame_id").distinct(), "frame_id", "left_anti")
            .withColumn("grp", F.pmod(c("frame_id"), F.lit(groups))).join(sizes, "grp")
            .withColumn("_pos", draw(seed, "frame_id") % c("_n") + 1)
            .join(numbered.withColumnRenamed("frame_id", "used"), ["grp", "_pos"]))
    return keep.select("frame_id", "used").unionByName(lost.select("frame_id", "used"))


def voxel_point_sample(points: DataFrame, g: vx.VoxelGrid, max_points: int, max_voxels: int, seed: int) -> DataFrame:
    """Per frame a fixed number of voxels of the current and of the earlier sweeps, padded
    with the first voxel; frames without earlier sweeps use the current points twice.

    Points and picked voxels are read by several branches each, so both are written once."""
    points = cut_lineage(points.select("frame_id", "point_id", "x", "y", "z", "time"))
    now = points.where(c("time") == 0)
    old = points.where(c("time") != 0)
    alone = now.join(old.select("frame_id").distinct(), "frame_id", "left_anti")
    out = None
    for part, rows in (("current", now), ("previous", old.unionByName(alone))):
        mixed = point_shuffle(rows, seed).withColumns({"_old": c("point_id"), "point_id": c("new_id")})
        picked = cut_lineage(vx.hard_voxelize(mixed, g, max_points, max_voxels).select("frame_id", "voxel_id", "slot", "_old"))
        first = picked.where(c("voxel_id") == 0).select("frame_id", c("slot"), c("_old"))
        used = picked.groupBy("frame_id").agg((F.max("voxel_id") + 1).alias("_used"))
        pads = (used.where(c("_used") < max_voxels)
                .withColumn("voxel_id", F.explode(F.sequence(c("_used"), F.lit(max_voxels - 1).cast("bigint"))))
                .join(first, "frame_id"))
        both = picked.select("frame_id", "voxel_id", "slot", c("_old").alias("point_id")).unionByName(
            pads.select("frame_id", "voxel_id", "slot", c("_old").alias("point_id")))
        both = both.select(F.lit(part).alias("part"), "*")
        out = both if out is None else out.unionByName(both)
    return out


# Farthest point sampling ------------------------------------------------------------------

def farthest_point_sample(points: DataFrame, m: int, features: Sequence[str] = ("x", "y", "z"), cell_bits: int = 12) -> DataFrame:
    """``m`` points per frame, each the farthest from those already chosen, starting at the
    lowest point id; ties take the lowest id.

    The points of a frame lie in at most ``2**cell_bits`` cells, in one each where that many suffice; a cell is
    known by its farthest point and its bounds. A task picks from these as long as no cell can hide a farther point: what a new
    pick leaves of a cell is bounded by the pick's distance to the cell's far side. So one pass over the
    points gives many picks; only frames that need more get another one, in which points meet
    the new picks. Memory holds the cells of some frames, never their points.
    """
    features = list(features)
    axis_bits = F.when(c("_n") <= 1 << cell_bits, 0).otherwise(cell_bits // len(features))
    cell = ["_own", *[f"_q{i}" for i in range(len(features))]]
    state = cl.with_cells(cut_lineage(points.select("frame_id", "point_id", *features)), features, axis_bits)
    state = state.withColumn("_own", F.when(c("_bits") == 0, c("point_id"))).drop("_bits")
    state = cut_lineage(state.withColumns({"_d": F.lit(1e10), "_have": F.lit(0).cast("bigint")}))
    chosen = None
    while True:
        farthest = F.max(F.struct(c("_d"), (-c("point_id")).alias("_neg"), *[c(f) for f in features]))
        cells = state.groupBy("frame_id", *cell).agg(farthest.alias("_top"), F.count("*").alias("_n"), F.max("_have").alias("_have"), *cl.bounds(features))
        cells = cells.select("frame_id", "_n", "_have", c("_top._d").alias("_d"), (-c("_top._neg")).alias("point_id"), *[c(f"_top.{f}").alias(f) for f in features],
                             *["_lo_" + f for f in features], *["_hi_" + f for f in features])
        schema = "frame_id bigint, rank bigint, point_id bigint, " + ", ".join(f"{f} double" for f in features)
        picks = cut_lineage(map_groups(cells, ["frame_id"], [c("point_id")], lambda pdf: _pick_from_cells(pdf, m, features), schema))
        new = picks.where("rank >= 0")
        chosen = new if chosen is None else chosen.unionByName(new)
        more = picks.where("rank < 0")  # frames that are not done
        if more.isEmpty():
            return chosen.select("frame_id", "rank", "point_id")
        met = new.join(more.select("frame_id"), "frame_id", "left_semi").groupBy("frame_id").agg(
            F.collect_list(F.struct(*features)).alias("_new"), (F.max("rank") + 1).alias("_upto"))  # at most m picks
        state = spread_join(state, ["frame_id"], c("point_id"), met)

        def apart(p, q):
            return sum(((p[f] - q[f]) * (p[f] - q[f]) for f in features[1:]), (p[features[0]] - q[features[0]]) * (p[features[0]] - q[features[0]]))

        here = {f: c(f) for f in features}
        nearest = F.array_min(F.transform("_new", lambda q: apart(here, q)))
        state = cut_lineage(state.withColumns({"_d": F.least(c("_d"), nearest), "_have": c("_upto")}).drop("_new", "_upto"))


def _pick_from_cells(pdf: pd.DataFrame, m: int, features: list[str]) -> pd.DataFrame:
    """Picks of many frames at once from their cells, sorted by frame and point id; rank -1 marks a frame
    whose next pick needs a look at the points."""
    gid = group_ids(pdf, ["frame_id"])
    starts = np.searchsorted(gid, np.arange(gid[-1] + 1))
    feats, low, high = (pdf[[p + f for f in features]].to_numpy(float) for p in ("", "_lo_", "_hi_"))
    best, alone = pdf._d.to_numpy(float).copy(), pdf._n.to_numpy() == 1
    bound = best.copy()  # no point of the cell is farther than this
    have = pdf._have.to_numpy()[starts]
    want = np.minimum(m, np.add.reduceat(pdf._n.to_numpy(), starts))
    going = have < want
    out = []
    while going.any():
        most = np.maximum.reduceat(best, starts)
        hidden = np.maximum.reduceat(np.where(best < bound, bound, -1.0), starts)
        going &= most > hidden
        rows = np.flatnonzero((best == most[gid]) & going[gid])
        rows = rows[np.unique(gid[rows], return_index=True)[1]]
        if not len(rows):
            break
        frames = gid[rows]
        out.append((rows, have[frames].copy()))
        have[frames] += 1
        last = np.zeros(len(starts), np.int64)
        last[frames] = rows
        at = np.flatnonzero(going[gid])
        pick = feats[last[gid[at]]]
        gap, far = feats[at] - pick, np.maximum(np.abs(low[at] - pick), np.abs(high[at] - pick))
        best[at] = np.minimum(best[at], _sum_squares(gap))
        bound[at] = np.where(alone[at], best[at], np.minimum(bound[at], _sum_squares(far)))
        going &= have < want
    open_ = np.flatnonzero(have < want)
    rows = np.concatenate([r for r, _ in out] + [starts[open_]]).astype(np.int64)
    ranks = np.concatenate([k for _, k in out] + [np.full(len(open_), -1)]).astype(np.int64)
    done = pd.DataFrame({"frame_id": pdf.frame_id.to_numpy()[rows], "rank": ranks, "point_id": pdf.point_id.to_numpy()[rows]})
    return done.assign(**{f: feats[rows, i] for i, f in enumerate(features)})


def _sum_squares(gaps: np.ndarray) -> np.ndarray:
    """Summed axis after axis, as the column expressions do."""
    total = gaps[:, 0] * gaps[:, 0]
    for i in range(1, gaps.shape[1]):
        total = total + gaps[:, i] * gaps[:, i]
    return total


# Objects ----------------------------------------------------------------------------------

def paste_objects(scene: DataFrame, pool: DataFrame, quotas: dict[str, int], seed: int) -> DataFrame:
    """Database objects accepted into each frame.

    Per class, a frame draws its quota minus the objects it has. A draw is rejected when it
    collides with an object of the frame, with one accepted for an earlier class, or with a
    later draw of the same class (removing draws in order leaves exactly these). Frames pick
    from the shuffled pool by position, so nothing is paired across frames.
    """
    cols = ["x", "y", "z", "dx", "dy", "dz", "yaw"]
    frames = scene.select("frame_id").distinct()
    occupied = scene.select("frame_id", *cols, F.lit(-1).cast("bigint").alias("slot"))
    accepted = None
    for name, quota in quotas.items():
        shuffled = with_row_number(
            pool.where(c("name") == name).withColumn("_draw", draw(seed, "object_id")),
            [], [c("_draw"), c("object_id")], slice_of(c("_draw"), 256), "_pos")
        size = shuffled.agg(F.count("*").alias("_size")).scalar()
        have = scene.where(c("name") == name).groupBy("frame_id").agg(F.count("*").alias("_have"))
        slots = (frames.join(have, "frame_id", "left")
                 .withColumn("_need", F.lit(quota) - F.coalesce("_have", F.lit(0))).where(c("_need") > 0)
                 .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), c("_need") - 1)))
                 .withColumn("_size", size))
        slots = slots.where(c("_size") > 0).withColumn("_pos", (c("frame_id") * quota + c("slot")) % c("_size") + 1)
        cand = slots.join(shuffled.select("_pos", "object_id", "name", *cols), "_pos").select(
            "frame_id", "slot", "object_id", "name", *cols)
        # an object drawn twice keeps its first slot
        cand = cand.groupBy("frame_id", "object_id", "name", *cols).agg(F.min("slot").alias("slot"))
        touch = jn.rectangles_touch(bx.box("a_"), bx.box("b_"))
        hit_scene = jn.box_pairs(cand.select("frame_id", "slot", *cols), occupied).where(touch)
        later = jn.box_pairs(cand.select("frame_id", "slot", *cols), cand.select("frame_id", "slot", *cols)).where(
            touch & (c("b_slot") > c("a_slot")))
        blocked = hit_scene.select("frame_id", c("a_slot").alias("slot")).unionByName(
            later.select("frame_id", c("a_slot").alias("slot")))
        # later classes read the accepted objects again: keep their plan short
        good = cut_lineage(cand.join(blocked, ["frame_id", "slot"], "left_anti"))
        accepted = good if accepted is None else accepted.unionByName(good)
        occupied = occupied.unionByName(good.select("frame_id", *cols, "slot"))
    return accepted


def object_moves(boxes: DataFrame, tries: int, shift: float | Sequence[float], turn: float | Sequence[float], seed: int,
                 scene_turn: Sequence[float] = (0.0, 0.0), group_bound: int = 5000) -> DataFrame:
    """Every object with the pose ``nx, ny, nz, nyaw`` that the first of its seeded tries gives it which collides with no
    other object; ``attempt`` -1 and the old pose if there is none.

    A try shifts the centre by normal draws of standard deviation ``shift`` along x, y and z and turns the object by a
    uniform draw within ``turn`` (or plus and minus it). With a ``scene_turn`` of some width the object is first carried round the origin to a
    direction drawn in that range. Which try is free depends on the objects moved before, so
    each frame is one group; many groups are moved together, and tries are drawn as they are needed. Frames beyond the bound are cut into regions that are
    farther apart than any object can reach (see ``_regions``).
    """
    std = np.broadcast_to(np.asarray(shift, float), 3)
    low, high = (-turn, turn) if np.isscalar(turn) else turn
    around = abs(scene_turn[1] - scene_turn[0]) >= 1e-3
    cols = ["x", "y", "z", "dx", "dy", "dz", "yaw"]

    def words(pdf: pd.DataFrame) -> np.ndarray:
        return key_words(seed, pdf.frame_id.fillna(-1).to_numpy(np.int64), pdf.box_id.fillna(-1).to_numpy(np.int64))

    def tried(pose: np.ndarray, word: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Poses ``[objects, tries, 3]`` (x, y, yaw) after the numbered tries. Each try has eight draws: two for each axis, the turn, the direction."""
        n = t * 8
        x, y, yaw = (pose[:, i, None] for i in range(3))
        if around:
            old = np.arctan2(x, y)
            new = scene_turn[0] + array_uniform(word, n + 7) * (scene_turn[1] - scene_turn[0])
            radius = np.sqrt(x * x + y * y)
            x, y, yaw = radius * np.sin(new), radius * np.cos(new), yaw + (new - old)
        return np.stack([x + array_normal(word, n) * std[0], y + array_normal(word, n + 2) * std[1],
                         yaw + low + array_uniform(word, n + 6) * (high - low)], axis=2)

    def blocks(size: int = 8):
        """Numbers of the tries, some at a time: most objects are settled by the first."""
        return [np.arange(t, min(t + size, tries)) for t in range(0, tries, size)]

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        """The groups of a batch side by side: first object of each, second of each, and so on."""
        pos = pdf[["x", "y", "yaw"]].to_numpy(float).copy()
        dims = pdf[["dx", "dy"]].to_numpy(float)
        word = words(pdf)
        moved = np.full(len(pdf), -1, dtype=np.int64)
        first = np.flatnonzero(np.diff(group_ids(pdf, ["frame_id", "_region"]), prepend=-1))
        size = np.diff(np.append(first, len(pdf)))
        for i in range(size.max(initial=0)):
            start, n = first[size > i], size[size > i]
            for numbers in blocks():
                own = start + i
                cand = tried(pos[own], word[own], numbers)
                # every object of the group against the tries of this one, which does not hit itself
                run = np.repeat(np.arange(len(n)), n)
                begin = np.cumsum(n) - n
                other = start[run] + np.arange(n.sum()) - begin[run]
                hit = _touch_pairs(cand[run], dims[own][run], pos[other], dims[other]) & (other != own[run])[:, None]
                free = ~np.logical_or.reduceat(hit, begin, axis=0)
                some = free.any(axis=1)
                picked = free[some].argmax(axis=1)
                moved[own[some]] = numbers[picked]
                pos[own[some]] = cand[some, picked]
                start, n = start[~some], n[~some]
                if not len(n):
                    break
        z = pdf.z.to_numpy(float).copy()
        done = np.flatnonzero(moved >= 0)
        z[done] += array_normal(word[done], moved[done, None] * 8 + 4)[:, 0] * std[2]
        return pdf[["frame_id", "box_id", *cols]].assign(attempt=moved, nx=pos[:, 0], ny=pos[:, 1], nz=z, nyaw=pos[:, 2])

    def reaches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The stretch ``_lo`` to ``_hi`` that the object covers in its old pose and in all tries: of x, or of the distance from the origin if it is
        carried round."""
        for pdf in frames:
            pose, word = pdf[["x", "y", "yaw"]].to_numpy(float), words(pdf)
            half = np.sqrt(pdf.dx.to_numpy(float) ** 2 + pdf.dy.to_numpy(float) ** 2) / 2
            lo = hi = np.hypot(pose[:, 0], pose[:, 1]) if around else pose[:, 0]
            for numbers in blocks():
                at = tried(pose, word, numbers)
                at = np.hypot(at[..., 0], at[..., 1]) if around else at[..., 0]
                lo, hi = np.minimum(lo, at.min(axis=1)), np.maximum(hi, at.max(axis=1))
            yield pdf.assign(_lo=lo - half, _hi=hi + half)

    regions = _regions(boxes.select("frame_id", "box_id", *[c(k).cast("double") for k in cols]), group_bound, reaches)
    schema = ", ".join(["frame_id bigint", "box_id bigint", *[f"{k} double" for k in cols], "attempt bigint", *[f"n{k} double" for k in ("x", "y", "z", "yaw")]])
    return map_groups(regions, ["frame_id", "_region"], [c("box_id")], move, schema)


def object_noise(boxes: DataFrame, tries: int, shift: float | Sequence[float], turn: float | Sequence[float], seed: int,
                 scene_turn: Sequence[float] = (0.0, 0.0), group_bound: int = 5000) -> DataFrame:
    """The boxes after ``object_moves``."""
    return moved_boxes(object_moves(boxes, tries, shift, turn, seed, scene_turn, group_bound))


def moved_boxes(moves: DataFrame) -> DataFrame:
    return moves.select("frame_id", "box_id", "attempt", *[c("n" + k).alias(k) for k in ("x", "y", "z", "yaw")])


def moved_points(points: DataFrame, moves: DataFrame, size: float = 8.0) -> DataFrame:
    """All points; those strictly inside an object's old box turn about its centre and shift with it. A point in several boxes
    goes with the lowest id, also when that object stayed. ``box_id`` and ``attempt`` are null outside all boxes.

    A point has one ground tile, so what meets there also holds all boxes of a point and the choice takes no shuffle."""
    left, right = jn.point_tiles(points, size), jn.box_tiles(moves, size)
    on = (left.frame_id == right.frame_id) & (left._tx == right._tx) & (left._ty == right._ty) & jn.strictly_inside()
    met = shuffled_join(left, right, on, "left").drop(right.frame_id).drop(right._tx).drop(right._ty)
    named = ["box_id", "attempt", "x", "y", "z", "yaw", "nx", "ny", "nz", "nyaw"]
    first = met.groupBy(*points.columns, "_tx", "_ty").agg(F.min(F.struct(*[c("b_" + n).alias(n) for n in named])).alias("_b")).drop("_tx", "_ty")
    b = c("_b")
    ox, oy, angle = c("x") - b.x, c("y") - b.y, b.nyaw - b.yaw
    place = {"x": ox * F.cos(angle) + oy * F.sin(angle) + b.nx, "y": oy * F.cos(angle) - ox * F.sin(angle) + b.ny, "z": c("z") + (b.nz - b.z)}
    return first.select(*[F.when(b.attempt >= 0, place[k]).otherwise(c(k)).alias(k) if k in place else c(k) for k in points.columns],
                        b.box_id.alias("box_id"), b.attempt.alias("attempt"))


def _regions(boxes: DataFrame, bound: int, reaches: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Region 0 for frames up to ``bound`` objects. In larger frames gaps that no object's
    reach crosses separate regions, found by running maxima over slices."""
    small, big = split_by_group_size(boxes, ["frame_id"], bound)
    small = small.withColumn("_region", F.lit(0).cast("bigint"))
    big = big.mapInPandas(reaches, f"{', '.join(f'{n} {t}' for n, t in big.dtypes)}, _lo double, _hi double")
    sliced = value_slices(big, ["frame_id"], "_lo", max(bound, 1), "_vs")
    upto = with_running(sliced, ["frame_id"], ["_lo", "box_id"], c("_vs"), {"_far": ("max", "_hi")})
    gap = with_lag(upto, ["frame_id"], ["_lo", "box_id"], c("_vs"), {"_before": "_far"})
    gap = gap.withColumn("_new", F.coalesce((c("_lo") > c("_before")).cast("bigint"), F.lit(0).cast("bigint")))
    out = with_running(gap, ["frame_id"], ["_lo", "box_id"], c("_vs"), {"_region": ("sum", "_new")})
    return small.unionByName(out.drop("_vs", "_lo", "_hi", "_far", "_before", "_new"))


def _touch_pairs(cand: np.ndarray, dim: np.ndarray, pos: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Separating-axis test of the candidates of a box (``[pairs, tries, 3]``) with one other box each: ``[pairs, tries]``."""
    d = pos[:, None, :2] - cand[..., :2]
    ya, yb = cand[..., 2], pos[:, 2, None]
    co, si = np.abs(np.cos(ya - yb)), np.abs(np.sin(ya - yb))
    hit = np.ones(d.shape[:2], dtype=bool)
    own, oth = ((dim[:, 0, None] / 2, dim[:, 1, None] / 2), (dims[:, 0, None] / 2, dims[:, 1, None] / 2))
    for yaw, (w, h), (ow, oh) in ((ya, own, oth), (yb, oth, own)):
        u = d[..., 0] * np.cos(yaw) - d[..., 1] * np.sin(yaw)
        v = d[..., 0] * np.sin(yaw) + d[..., 1] * np.cos(yaw)
        hit &= (np.abs(u) < w + ow * co + oh * si) & (np.abs(v) < h + ow * si + oh * co)
    return hit
