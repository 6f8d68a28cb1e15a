"""Augmentation, degradation and sensor noise, seeded by row keys.

Everything random is a function of (seed, frame, point), so frames need no generator state
and a recomputed task repeats its rows exactly. Ranks inside a frame use draw slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.functions.random import draw, hash_normal, hash_uniform, normal, uniform
from voxelmill.operators.points import region_membership
from voxelmill.operators.sampling import ranked_by_draw
from voxelmill.session import cut_lineage
from voxelmill.skew import exact_quantiles

c = F.col


# Augmentation -----------------------------------------------------------------------------

def augmentation_parameters(rows: DataFrame, seed: int, turn: Sequence[float], scale: Sequence[float],
                            shift: float, epoch: int = 0) -> DataFrame:
    """The random turn, scale and shift of each row's frame. They depend on seed, epoch and
    frame alone, so points and boxes compute them row by row and nothing is joined."""
    s = seed + 1000 * epoch
    return rows.withColumns({
        "theta": F.lit(turn[0]) + (turn[1] - turn[0]) * uniform(s, "frame_id"),
        "factor": F.lit(scale[0]) + (scale[1] - scale[0]) * uniform(s + 1, "frame_id"),
        **{f"t{k}": normal(s + 2 + i, "frame_id") * shift for i, k in enumerate("xyz")}})


def rot_scale_trans_points(rows: DataFrame) -> DataFrame:
    """Turn points with parameters by -theta, shift, then scale (boxes turn by +theta, which is
    the same motion)."""
    x, y = bx.rotate_points(c("x"), c("y"), -c("theta"))
    return rows.withColumns({"x": (x + c("tx")) * c("factor"), "y": (y + c("ty")) * c("factor"),
                             "z": (c("z") + c("tz")) * c("factor")})


def rot_scale_trans_boxes(rows: DataFrame) -> DataFrame:
    moved = bx.scale(bx.translate(bx.rotate(bx.box(velocity=True), c("theta")), c("tx"), c("ty"), c("tz")), c("factor"))
    return rows.withColumns({n: getattr(moved, n) for n in ("x", "y", "z", "dx", "dy", "dz", "yaw", "vx", "vy")})


def flip_parameters(rows: DataFrame, seed: int) -> DataFrame:
    """Whether each row's frame is flipped, from seed and frame alone."""
    return rows.withColumns({"flip_h": draw(seed, "frame_id") % 2 == 1, "flip_v": draw(seed + 1, "frame_id") % 2 == 1})


def random_flip_points(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "y": F.when(c("flip_h"), -c("y")).otherwise(c("y")), "x": F.when(c("flip_v"), -c("x")).otherwise(c("x"))})


def random_flip_boxes(rows: DataFrame) -> DataFrame:
    for flag, direction in (("flip_h", "horizontal"), ("flip_v", "vertical")):
        f = bx.flip(bx.box(velocity=True), direction)
        rows = rows.withColumns({n: F.when(c(flag), getattr(f, n)).otherwise(c(n)) for n in ("x", "y", "yaw", "vx", "vy")})
    return rows


def radar_jitter(points: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Gaussian noise on radar positions."""
    return points.withColumns({k: c(k) + normal(seed + i, "point_id", "frame_id") * sigma for i, k in enumerate("xyz")})


# Degradation ------------------------------------------------------------------------------

def _keep_share(points: DataFrame, ratio: float, at_least: int, seed: int) -> DataFrame:
    counts = points.groupBy("frame_id").agg(F.count("*").alias("_n"))
    quota = F.greatest(F.bround(c("_n") * ratio, 0).cast("bigint"), F.lit(at_least))
    return (ranked_by_draw(points, ["frame_id"], "point_id", seed, "_k").join(counts, "frame_id")
            .where(c("_k") <= quota).drop("_k", "_n"))


def degrade_region(points: DataFrame, region: Sequence[float], ratio: float, seed: int) -> DataFrame:
    """Keep an exact rounded share of the points inside a closed rectangle, and all others."""
    inside = region_membership(c("x"), c("y"), region)
    return points.where(~inside).unionByName(_keep_share(points.where(inside), ratio, 0, seed))


def degrade_density(points: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Keep a share of every frame, at least one point."""
    if ratio >= 1.0:
        return points
    if ratio <= 0.0:
        return degrade_all(points)
    return _keep_share(points, ratio, 1, seed)


def degrade_drop(points: DataFrame, drop: float, seed: int) -> DataFrame:
    return degrade_density(points, 1.0 - drop, seed)


def degrade_all(points: DataFrame) -> DataFrame:
    """A genuinely empty cloud with the same columns."""
    return points.where(F.lit(False))


MODES = ("clean", "local", "global", "combined")


def random_degradation(points: DataFrame, bounds: Sequence[float], seed: int, probabilities=(0.3, 0.3, 0.2, 0.2),
                       size=(0.5, 1.2), drop=(0.1, 0.4), two_box: float = 0.2,
                       min_points: int = 128) -> tuple[DataFrame, DataFrame]:
    """Per frame: clean, local boxes around observed points, a global drop, or both.

    Frames left with fewer than ``min_points`` stay clean. Returns the kept points and one
    record per frame (mode, boxes, ratio, counts). Boxes are anchored at hashed positions;
    ``point_id`` must count from zero in each frame.
    """
    counts = points.groupBy("frame_id").agg(F.count("*").alias("original"))
    u, low, edge = uniform(seed, "frame_id"), 0.0, None
    for mode, p in zip(MODES, probabilities):
        low += p
        edge = F.when(u < low, mode) if edge is None else edge.when(u < low, mode)
    params = counts.withColumns({
        "mode": edge.otherwise(MODES[-1]), "ratio": F.lit(drop[0]) + (drop[1] - drop[0]) * uniform(seed + 1, "frame_id"),
        "n_boxes": F.when(uniform(seed + 2, "frame_id") < two_box, 2).otherwise(1)})
    local = params.where(c("mode").isin("local", "combined")).withColumn("b", F.explode(F.sequence(F.lit(1), c("n_boxes"))))
    span = size[1] - size[0]
    local = local.withColumns({
        "sx": F.lit(size[0]) + span * uniform(seed + 3, "frame_id", "b"), "sy": F.lit(size[0]) + span * uniform(seed + 4, "frame_id", "b"),
        "point_id": draw(seed + 5, "frame_id", "b") % c("original")})
    anchors = local.join(points.select("frame_id", "point_id", c("x").alias("ax"), c("y").alias("ay")), ["frame_id", "point_id"])
    centre = {k: F.greatest(F.least(c("a" + k), hi - c("s" + k) / 2), lo + c("s" + k) / 2)
              for k, lo, hi in (("x", F.lit(bounds[0]), F.lit(bounds[2])), ("y", F.lit(bounds[1]), F.lit(bounds[3])))}
    boxes = anchors.select("frame_id", F.struct(
        (centre["x"] - c("sx") / 2).alias("x0"), (centre["x"] + c("sx") / 2).alias("x1"),
        (centre["y"] - c("sy") / 2).alias("y0"), (centre["y"] + c("sy") / 2).alias("y1")).alias("box"))
    per_frame = boxes.groupBy("frame_id").agg(F.collect_list("box").alias("boxes"))  # one or two boxes
    params = params.join(per_frame, "frame_id", "left")
    rows = points.join(params, "frame_id")
    hit = F.coalesce(F.exists("boxes", lambda b: c("x").between(b.x0, b.x1) & c("y").between(b.y0, b.y1)), F.lit(False))
    rows = rows.withColumn("_open", ~hit)
    survivors = rows.where(c("_open")).groupBy("frame_id").agg(F.count("*").alias("_avail"))
    drops = c("mode").isin("global", "combined")
    quota = F.when(drops, F.greatest(F.bround(c("_avail") * (1.0 - c("ratio")), 0).cast("bigint"),
                                     F.least(F.lit(min_points).cast("bigint"), c("_avail")))).otherwise(c("_avail"))
    plan = params.join(survivors, "frame_id", "left").na.fill(0, ["_avail"]).withColumn("_quota", quota)
    plan = plan.withColumn("_fallback", c("_quota") < F.least(F.lit(min_points).cast("bigint"), c("original")))
    plan = plan.withColumns({
        "mode": F.when(c("_fallback"), "clean_fallback").otherwise(c("mode")),
        "retained": F.when(c("_fallback"), c("original")).otherwise(c("_quota")),
        "ratio": F.when(drops & ~c("_fallback"), c("ratio")).otherwise(F.lit(0.0))})
    kept = (ranked_by_draw(rows.where(c("_open")).select(*points.columns), ["frame_id"], "point_id", seed + 6, "_k")
            .join(plan.where(~c("_fallback")).select("frame_id", "_quota"), "frame_id")
            .where(c("_k") <= c("_quota")).select(*points.columns))
    whole = points.join(plan.where(c("_fallback")).select("frame_id"), "frame_id", "left_semi")
    record = plan.select("frame_id", "mode", c("ratio").alias("drop_ratio"), "original", "retained",
                         F.when(c("_fallback") | c("boxes").isNull(), F.lit(0)).otherwise(F.size("boxes")).alias("boxes"))
    return kept.unionByName(whole.select(*points.columns)), record


# Sensor noise -----------------------------------------------------------------------------

@dataclass(frozen=True)
class NoiseProfile:
    """Strength of the sensor noise model; lengths in metres, widths in degrees."""

    radial: tuple[float, float]
    lateral: tuple[float, float]
    dropout: tuple[float, float, float]
    dark_dropout: float
    intensity_std: float
    outliers: float
    sector: tuple[float, int, float]


# Fixed values of the three presets: (base, per metre), dropout with its maximum, sector (probability, count, width).
PROFILES = {
    "light": NoiseProfile((0.005, 0.001), (0.002, 0.0005), (0.03, 0.01, 0.15), 0.03, 0.03, 0.005, (0.10, 1, 5.0)),
    "mid": NoiseProfile((0.015, 0.003), (0.005, 0.001), (0.08, 0.025, 0.35), 0.08, 0.07, 0.02, (0.25, 1, 8.0)),
    "heavy": NoiseProfile((0.030, 0.006), (0.010, 0.002), (0.15, 0.05, 0.60), 0.15, 0.12, 0.05, (0.40, 2, 12.0)),
}


def sector_open(seed: int, sector: tuple[float, int, float]) -> Column:
    """False for points in the frame's dropped azimuth sectors; depends on the row only."""
    prob, count, width = sector
    angle, hit = F.atan2("y", "x"), F.lit(False)
    for k in range(count):
        centre = uniform(seed + 1 + k, "frame_id") * (2 * math.pi) - math.pi
        turn = angle - centre + math.pi
        away = F.abs(turn - F.floor(turn / (2 * math.pi)) * (2 * math.pi) - math.pi)
        hit = hit | (away <= math.radians(width) / 2)
    return ~(hit & (uniform(seed, "frame_id") < prob))


def apply_sector_dropout(points: DataFrame, sector: tuple[float, int, float], seed: int) -> DataFrame:
    return points.where(sector_open(seed, sector))


def noisy_columns(p: NoiseProfile, seed: int) -> dict[str, Column]:
    """Radial noise along the ray and tangent noise across it, both growing with range."""
    keys = ("point_id", "frame_id")
    r = F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z"))
    safe = F.greatest(r, F.lit(1e-6))
    unit = [c(k) / safe for k in "xyz"]
    raw = [hash_normal(seed + 10 + i, *keys) for i in range(3)]
    dot = raw[0] * unit[0] + raw[1] * unit[1] + raw[2] * unit[2]
    return {"_r": r, "_ux": unit[0], "_uy": unit[1], "_uz": unit[2],
            **{f"_t{k}": raw[i] - dot * unit[i] for i, k in enumerate("xyz")},
            "_rad": hash_normal(seed + 20, *keys) * (p.radial[0] + p.radial[1] * r),
            "_lat": hash_normal(seed + 21, *keys) * (p.lateral[0] + p.lateral[1] * r)}


def add_noise(points: DataFrame, p: NoiseProfile, seed: int, min_points: int = 16) -> DataFrame:
    """Noisy, dropped-out cloud with outliers; ``kind`` is ``kept`` or ``outlier``.

    Frames that keep too few points get their first points by draw back.
    """
    keys = ("point_id", "frame_id")
    rows = points.withColumns(noisy_columns(p, seed))
    norm = F.greatest(F.sqrt(c("_tx") * c("_tx") + c("_ty") * c("_ty") + c("_tz") * c("_tz")), F.lit(1e-6))
    rows = rows.withColumn("_norm", norm)
    rows = rows.withColumns({k: c(k) + c(f"_u{k}") * c("_rad") + c(f"_t{k}") / c("_norm") * c("_lat") for k in "xyz"})
    bright = F.greatest(F.least(c("intensity"), F.lit(1.0)), F.lit(0.0))
    chance = F.greatest(F.least(p.dropout[0] + p.dropout[1] * c("_r") + p.dark_dropout * (1.0 - bright), F.lit(p.dropout[2])), F.lit(0.0))
    keep = (hash_uniform(seed + 30, *keys) > chance) & sector_open(seed + 40, p.sector)
    # the noisy cloud feeds four branches, so it is written once
    rows = cut_lineage(rows.withColumn("_keep", keep).select(*points.columns, "_keep"))
    counts = rows.groupBy("frame_id").agg(F.count("*").alias("_n"), F.sum(c("_keep").cast("int")).alias("_kept"))
    target = F.least(F.lit(min_points).cast("bigint"), c("_n"))
    short = counts.where(c("_kept") < target).select("frame_id", target.alias("_target"))
    saved = (ranked_by_draw(rows.join(short, "frame_id"), ["frame_id"], "point_id", seed + 50, "_k")
             .where(c("_keep") | (c("_k") <= c("_target"))).select(*points.columns))
    fine = rows.where(c("_keep")).join(short.select("frame_id"), "frame_id", "left_anti").select(*points.columns)
    kept = fine.unionByName(saved)
    shade = c("intensity") + hash_normal(seed + 60, *keys) * p.intensity_std
    kept = kept.withColumn("intensity", F.greatest(F.least(shade, F.lit(1.0)), F.lit(0.0)))
    return kept.withColumn("kind", F.lit("kept")).unionByName(
        outliers(kept, p.outliers, seed + 70, points.columns).withColumn("kind", F.lit("outlier")))


def outliers(points: DataFrame, share: float, seed: int, columns: Sequence[str],
             bounds: Sequence[float] = (0.0, -51.2, -5.0, 51.2, 51.2, 3.0)) -> DataFrame:
    """``round(share * n)`` uniform points per frame with the frame's median time; generated in
    blocks so that no frame expands from a single row."""
    counts = points.groupBy("frame_id").agg(F.bround(F.count("*") * share, 0).cast("bigint").alias("_m"))
    median = exact_quantiles(points, ["frame_id"], "time", [0.5], ["time"])
    blocks = counts.where(c("_m") > 0).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(_m - 1) div 1024"))))
    rows = blocks.withColumn("_i", F.explode(F.sequence(c("_b") * 1024, F.least(c("_b") * 1024 + 1023, c("_m") - 1))))
    place = {k: F.lit(bounds[i]) + (bounds[i + 3] - bounds[i]) * uniform(seed + i, "_i", "frame_id") for i, k in enumerate("xyz")}
    rows = rows.withColumns({**place, "intensity": 0.25 * uniform(seed + 3, "_i", "frame_id"), "point_id": -1 - c("_i")})
    return rows.join(median, "frame_id").select(*columns)


def noise_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Input, kept, outlier and output points of every frame."""
    n = before.groupBy("frame_id").agg(F.count("*").alias("input"))
    out = after.groupBy("frame_id").agg(F.sum((c("kind") == "kept").cast("bigint")).alias("kept"),
                                        F.sum((c("kind") == "outlier").cast("bigint")).alias("outliers"), F.count("*").alias("output"))
    return n.join(out, "frame_id", "left").na.fill(0)
