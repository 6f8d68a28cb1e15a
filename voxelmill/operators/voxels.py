"""Voxel, pillar and grid-cell grouping of points.

All groupings are hash aggregates with map-side partials. "First come" limits are rank
filters ``row_number() <= k``; Spark prunes them per input task before the shuffle
(window group limit), so a crowded voxel ships at most ``k`` rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from voxelmill.skew import with_row_number

c = F.col
CELL = ["frame_id", "cx", "cy", "cz"]


@dataclass(frozen=True)
class VoxelGrid:
    """Range ``(x0, y0, z0, x1, y1, z1)`` and voxel size."""

    range: tuple[float, ...]
    size: tuple[float, float, float]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(round((self.range[i + 3] - self.range[i]) / self.size[i]) for i in range(3))

    def index(self, axis: int, value: Column) -> Column:
        return F.floor((value - self.range[axis]) / self.size[axis])


def voxel_columns(g: VoxelGrid) -> tuple[list[Column], Column]:
    idx = [g.index(i, c(k)) for i, k in enumerate("xyz")]
    inside = F.lit(True)
    for i, n in zip(idx, g.shape):
        inside = inside & (i >= 0) & (i < n)
    return idx, inside


def dynamic_voxelize(points: DataFrame, g: VoxelGrid) -> DataFrame:
    """Voxel coordinates of every point, -1 for points outside the range."""
    idx, inside = voxel_columns(g)
    return points.withColumns({
        name: F.when(inside, i).otherwise(F.lit(-1).cast("bigint")) for name, i in zip(CELL[1:], idx)})


def inside_voxels(points: DataFrame, g: VoxelGrid) -> DataFrame:
    """Points inside the range with their voxel coordinates."""
    idx, inside = voxel_columns(g)
    return points.where(inside).withColumns(dict(zip(CELL[1:], idx)))


def voxel_mean(points: DataFrame, g: VoxelGrid, features: Sequence[str]) -> DataFrame:
    return inside_voxels(points, g).groupBy(*CELL).agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])


def hard_voxelize(points: DataFrame, g: VoxelGrid, max_points: int, max_voxels: int) -> DataFrame:
    """First ``max_points`` rows of each of the first ``max_voxels`` voxels of a frame.

    Voxels are ordered by their first point; a voxel opened in time keeps accepting rows
    after the voxel budget is used up. Result: one row per kept point with ``voxel_id``
    and ``slot``.
    """
    cells = inside_voxels(points, g)
    opened = cells.groupBy(*CELL).agg(F.min("point_id").alias("first_point"))
    by_arrival = Window.partitionBy("frame_id").orderBy("first_point")
    # The filter is on the bare row number, so that Spark cuts each frame inside the input tasks.
    opened = (opened.withColumn("_rn", F.row_number().over(by_arrival)).where(c("_rn") <= max_voxels)
              .withColumn("voxel_id", c("_rn").cast("bigint") - 1).drop("first_point", "_rn"))
    in_voxel = Window.partitionBy(*CELL).orderBy("point_id")
    kept = (cells.withColumn("slot", F.row_number().over(in_voxel)).where(c("slot") <= max_points)
            .withColumn("slot", c("slot").cast("bigint") - 1))
    return kept.join(opened, CELL)


def voxel_arrival_rank(points: DataFrame, g: VoxelGrid, points_per_slice: int = 1 << 20) -> DataFrame:
    """Rank of each voxel in its frame by first point, in slices of the point number."""
    opened = inside_voxels(points, g).groupBy(*CELL).agg(
        F.min("point_id").alias("first_point"), F.count("*").alias("n"))
    ranked = with_row_number(opened, ["frame_id"], [c("first_point")], F.floor(c("first_point") / points_per_slice), "voxel_id")
    return ranked.select(*CELL, "first_point", "n", (c("voxel_id") - 1).alias("voxel_id"))


def dynamic_scatter(cells: DataFrame, features: Sequence[str], how: str) -> DataFrame:
    """Reduce features per voxel; rows with negative coordinates are dropped."""
    fn = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    return (cells.where((c("cx") >= 0) & (c("cy") >= 0) & (c("cz") >= 0))
            .groupBy(*CELL).agg(*[fn(f).alias(f) for f in features]))


def with_voxel_size(points: DataFrame, g: VoxelGrid) -> DataFrame:
    """Every point with the count of its voxel, long form (no list per voxel)."""
    cells = inside_voxels(points, g)
    sizes = cells.groupBy(*CELL).agg(F.count("*").alias("n"))
    return cells.join(sizes, CELL)


def bev_pool(points: DataFrame, g: VoxelGrid, features: Sequence[str]) -> DataFrame:
    """Sum per grid cell. Coordinates are truncated toward zero, so a value in (-1, 0) of a
    cell unit still lands in cell 0."""
    idx = [((c(k) - g.range[i]) / g.size[i]).cast("bigint") for i, k in enumerate("xyz")]
    inside = F.lit(True)
    for i, n in zip(idx, g.shape):
        inside = inside & (i >= 0) & (i < n)
    return (points.where(inside).withColumns(dict(zip(CELL[1:], idx)))
            .groupBy(*CELL).agg(*[F.sum(f).alias(f) for f in features]))


def collapse_z(pooled: DataFrame, feature: str, depth: int) -> DataFrame:
    """Height slices become columns ``z0 .. z{depth-1}``."""
    return pooled.groupBy("frame_id", "cx", "cy").agg(*[
        F.coalesce(F.sum(F.when(c("cz") == k, c(feature))), F.lit(0.0)).alias(f"z{k}") for k in range(depth)])


def frames_with_dummy(frames: DataFrame, voxels: DataFrame, features: Sequence[str]) -> DataFrame:
    """Frames with fewer than two voxels get zero voxels so that they survive batching."""
    counts = voxels.groupBy("frame_id").agg(F.count("*").alias("_n"))
    short = (frames.join(counts, "frame_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
             .where(c("_n") < 2)
             .select("frame_id", F.explode(F.sequence(c("_n"), F.lit(1))).alias("_k")))
    zero = F.lit(0).cast("bigint")
    dummy = short.select("frame_id", zero.alias("cx"), zero.alias("cy"), zero.alias("cz"),
                         *[F.lit(0.0).alias(f) for f in features])
    return voxels.select("frame_id", "cx", "cy", "cz", *features).unionByName(dummy)


def pillar_decorate(points: DataFrame, g: VoxelGrid) -> DataFrame:
    """Offsets to the pillar mean and to the pillar centre.

    The mean comes from an aggregate joined back, not from a window, so a crowded pillar
    is never sorted in one task.
    """
    cells = inside_voxels(points, g)
    means = cells.groupBy(*CELL).agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])
    centre = {f"p{k}": c(k) - ((c(f"c{k}") + 0.5) * g.size[i] + g.range[i]) for i, k in enumerate("xy")}
    return cells.join(means, CELL).withColumns(
        {**{f"f{k}": c(k) - c(f"m{k}") for k in "xyz"}, **centre})


def segment_sum(cells: DataFrame, value: str) -> DataFrame:
    """Sum of each run of equal cell rank; equal to a plain grouping."""
    return cells.groupBy(*CELL).agg(F.sum(value).alias(value))


def rank_of_cell(g: VoxelGrid) -> Column:
    """Row-major rank of a cell inside the grid."""
    nx, ny, nz = g.shape
    return (c("cx") * ny + c("cy")) * nz + c("cz")


def interval_runs(cells: DataFrame, g: VoxelGrid) -> DataFrame:
    """Start and length of each run of equal rank when a frame's rows are sorted by rank.

    Starts are running sums over runs, one row per cell, never over rows.
    """
    runs = cells.withColumn("rank", rank_of_cell(g)).groupBy("frame_id", "rank").agg(F.count("*").alias("length"))
    before = Window.partitionBy("frame_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint")))
