"""Grids that follow the points of each frame.

The range of a frame is taken between low and high percentiles of a sixteenth of its points, so that a
few far points cannot make all cells useless; points beyond it belong to the border cells. Cells
therefore carry the bounds of the points they hold, and searches use those, never the cell geometry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.skew import spread_join

c = F.col
def with_cells(points: DataFrame, axes: Sequence[str], bits: Column) -> DataFrame:
    """Points with the cell ``_q0 ..`` of their frame, 2**bits cells along each axis. ``bits`` may use ``_n``, the
    points of the frame, and is kept as ``_bits``."""
    drawn = F.pmod(F.xxhash64("point_id"), F.lit(16)) == 0  # only tunes the cost: every point gets a cell
    stats = [F.percentile_approx(F.when(drawn, c(a)), [0.02, 0.98], 200).alias(f"_r{i}") for i, a in enumerate(axes)]
    frames = points.groupBy("frame_id").agg(F.count("point_id").alias("_n"), *stats).withColumn("_bits", bits).drop("_n")
    found = spread_join(points, ["frame_id"], c("point_id"), frames)
    cells = F.pow(F.lit(2.0), c("_bits"))
    out = {}
    for i, a in enumerate(axes):
        low, high = c(f"_r{i}")[0], c(f"_r{i}")[1]
        place = F.floor((c(a) - low) / F.greatest(high - low, F.lit(1e-300)) * cells)
        out[f"_q{i}"] = F.coalesce(F.greatest(F.lit(0).cast("bigint"), F.least(place, (cells - 1).cast("bigint"))), F.lit(0).cast("bigint"))
    return found.withColumns(out).drop(*[f"_r{i}" for i in range(len(axes))])


def bounds(axes: Sequence[str]) -> list[Column]:
    """Aggregates: the smallest and largest value of each axis."""
    return [f(a).alias(p + a) for a in axes for p, f in (("_lo_", F.min), ("_hi_", F.max))]


def merged_bounds(axes: Sequence[str]) -> list[Column]:
    """The same from tables that have bounds already."""
    return [f(p + a).alias(p + a) for a in axes for p, f in (("_lo_", F.min), ("_hi_", F.max))]


def nearest2(axes: Sequence[str], prefix: str, of: Callable[[str], Column] = F.col) -> Column:
    """Least squared distance of a point (``prefix`` + axis) to the bounds, which ``of`` names. Computed like a distance to a point,
    so that rounding can never put it above the distance of a point inside."""
    gaps = [F.greatest(of("_lo_" + a) - c(prefix + a), c(prefix + a) - of("_hi_" + a), F.lit(0.0)) for a in axes]
    return _squares(gaps)


def farthest2(axes: Sequence[str], prefix: str, of: Callable[[str], Column] = F.col) -> Column:
    """Largest squared distance of a point to the bounds."""
    return _squares([F.greatest(F.abs(of("_lo_" + a) - c(prefix + a)), F.abs(of("_hi_" + a) - c(prefix + a))) for a in axes])


def _squares(gaps: list[Column]) -> Column:
    total = gaps[0] * gaps[0]
    for g in gaps[1:]:
        total = total + g * g
    return total
