"""Point and box predicates, point transforms, radar encodings, camera projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.schemas import Grid

c = F.col

# Fixed values of the 32-beam sensor: highest elevation, step, band offset, beams kept.
BEAM_TOP, BEAM_BOTTOM, BEAM_STEP, BEAM_SHIFT = 0.1862, -0.5353, 0.023275, 0.012
BEAMS_KEPT = {16: tuple(range(1, 32, 2)), 4: (7, 9, 11, 13), 1: (9,)}


def in_range_3d(x: Column, y: Column, z: Column, r: Sequence[float]) -> Column:
    """Strictly inside ``(x0, y0, z0, x1, y1, z1)``."""
    return ((x > r[0]) & (y > r[1]) & (z > r[2]) & (x < r[3]) & (y < r[4]) & (z < r[5]))


def in_range_bev(u: Column, v: Column, r: Sequence[float]) -> Column:
    """Strictly inside ``(u0, v0, u1, v1)`` on the ground plane."""
    return (u > r[0]) & (v > r[1]) & (u < r[2]) & (v < r[3])


def bev_axes(mode: str) -> tuple[str, str]:
    """Ground-plane axes of a coordinate mode."""
    return ("x", "z") if mode == "camera" else ("x", "y")


def remove_close(df: DataFrame, radius: float = 1.0) -> DataFrame:
    """Drop points in the square around the sensor."""
    return df.where(~((F.abs("x") < radius) & (F.abs("y") < radius)))


def beam_band(beam: int) -> tuple[float, float]:
    """Open elevation band of one beam of 32."""
    def edge(i):
        return BEAM_BOTTOM if i == 31 else BEAM_TOP - BEAM_STEP * i
    return edge(beam) - BEAM_SHIFT, edge(beam - 1) - BEAM_SHIFT


def reduce_beams(df: DataFrame, beams: int) -> DataFrame:
    """Keep the elevation bands of a sensor with fewer beams."""
    if beams == 32:
        return df
    theta = F.asin(c("z") / F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z")))
    test = F.lit(False)
    for beam in BEAMS_KEPT[beams]:
        lo, hi = beam_band(beam)
        test = test | ((theta > lo) & (theta < hi))
    return df.where(test)


def radar_states(df: DataFrame, invalid=(0,), dynamic=tuple(range(7)), ambiguous=(3,),
                 mode: str = "default") -> DataFrame:
    """Radar quality filter; ``none`` keeps every state."""
    if mode == "none":
        return df
    return df.where(c("invalid_state").isin(*invalid) & c("dynprop").isin(*dynamic)
                    & c("ambig_state").isin(*ambiguous))


def region_membership(x: Column, y: Column, r: Sequence[float]) -> Column:
    """Closed rectangle ``(x0, x1, y0, y1)``."""
    return x.between(r[0], r[1]) & y.between(r[2], r[3])


def project(x: Column, y: Column, z: Column, k, floor: float | None = None) -> tuple[Column, Column, Column]:
    """Perspective projection with a 3x3 literal matrix; depth may be floored before dividing."""
    u = x * k[0][0] + y * k[0][1] + z * k[0][2]
    v = x * k[1][0] + y * k[1][1] + z * k[1][2]
    d = x * k[2][0] + y * k[2][1] + z * k[2][2]
    div = F.greatest(d, F.lit(floor)) if floor is not None else d
    return u / div, v / div, d


def image_visible(u: Column, v: Column, depth: Column, height: int, width: int) -> Column:
    return (depth > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height)


def lidar_to_camera(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Default axis swap, LiDAR to camera."""
    return tuple(bx.convert_point(x, y, z, "lidar", "camera"))


def bev_cell(x: Column, y: Column, z: Column, g: Grid) -> tuple[Column, Column, Column]:
    """Row, column and validity; half-open in the plane, open in z, indices clamped."""
    row, col = F.floor((x - g.x0) / g.cell), F.floor((y - g.y0) / g.cell)
    valid = ((x >= g.x0) & (x < g.x1) & (y >= g.y0) & (y < g.y1) & (z > g.z0) & (z < g.z1))
    return (F.greatest(F.least(row, F.lit(g.rows - 1)), F.lit(0)),
            F.greatest(F.least(col, F.lit(g.cols - 1)), F.lit(0)), valid)


def one_hot(col: Column, values: Sequence[int], prefix: str) -> list[Column]:
    return [(col == v).cast("int").alias(f"{prefix}{v}") for v in values]


def normalise_feature(col: Column, mean: float, std: float) -> Column:
    return (col - mean) / std


def back_project(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float):
    """Pixel and depth to camera coordinates."""
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def camera_to_base(x: Column, y: Column, z: Column, pitch: float = 0.0, mount: Sequence[float] = (0, 0, 0)):
    """Optical axes (x right, y down, z forward) to base axes with a pitched mount."""
    cp, sp = math.cos(pitch), math.sin(pitch)
    fwd, left, up = z, -x, -y
    return fwd * cp + up * sp + mount[0], left + mount[1], up * cp - fwd * sp + mount[2]


def ray_exit(dx: Column, dy: Column, ox: Column, oy: Column, g: Grid) -> Column:
    """Distance along a ray from inside the grid until it leaves it."""
    def axis(d, o, lo, hi):
        return F.when(d > 0, (hi - o) / d).when(d < 0, (lo - o) / d)
    return F.least(axis(dx, ox, g.x0, g.x1), axis(dy, oy, g.y0, g.y1))
