"""3D boxes as column expressions: properties, moves, corners and axis conventions.

A box has columns x, y, z, dx, dy, dz, yaw and optionally vx, vy. The stored centre is the
middle of the bottom face. ``mode`` is ``lidar`` (z up), ``depth`` (z up, y forward) or
``camera`` (y down, z forward).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi

# Unit corners in storage order, as bits of (first, second, third axis).
CORNER_BITS = ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0))
ORIGIN = {"lidar": (0.5, 0.5, 0.0), "depth": (0.5, 0.5, 0.0), "camera": (0.5, 1.0, 0.5)}

# Default axis swaps between modes, and which source size becomes which.
BOX_AXES = {
    ("lidar", "camera"): ([[0, -1, 0], [0, 0, -1], [1, 0, 0]], (1, 2, 0)),
    ("camera", "lidar"): ([[0, 0, 1], [-1, 0, 0], [0, -1, 0]], (2, 0, 1)),
    ("depth", "camera"): ([[1, 0, 0], [0, 0, 1], [0, -1, 0]], (0, 2, 1)),
    ("camera", "depth"): ([[1, 0, 0], [0, 0, -1], [0, 1, 0]], (0, 2, 1)),
    ("lidar", "depth"): ([[0, -1, 0], [1, 0, 0], [0, 0, 1]], (1, 0, 2)),
    ("depth", "lidar"): ([[0, 1, 0], [-1, 0, 0], [0, 0, 1]], (1, 0, 2)),
}
# Points between depth and camera use the opposite matrices of the boxes.
POINT_AXES = {pair: axes for pair, (axes, _) in BOX_AXES.items()}
POINT_AXES[("depth", "camera")], POINT_AXES[("camera", "depth")] = (
    POINT_AXES[("camera", "depth")], POINT_AXES[("depth", "camera")])


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    z: Column
    dx: Column
    dy: Column
    dz: Column
    yaw: Column
    vx: Column | None = None
    vy: Column | None = None

    def columns(self, prefix: str = "") -> list[Column]:
        names = ["x", "y", "z", "dx", "dy", "dz", "yaw"] + (["vx", "vy"] if self.vx is not None else [])
        return [getattr(self, n).alias(prefix + n) for n in names]


def box(prefix: str = "", velocity: bool = False) -> Box:
    """The box stored in columns named with ``prefix``."""
    names = ["x", "y", "z", "dx", "dy", "dz", "yaw"] + (["vx", "vy"] if velocity else [])
    return Box(*[F.col(prefix + n) for n in names])


def limit_period(v: Column, offset: float = 0.5, period: float = PI) -> Column:
    return v - F.floor(v / period + offset) * period


def height(b: Box, mode: str = "lidar") -> Column:
    return b.dy if mode == "camera" else b.dz


def bottom_top(b: Box, mode: str = "lidar") -> tuple[Column, Column]:
    if mode == "camera":
        return b.y, b.y - b.dy
    return b.z, b.z + b.dz


def gravity_centre(b: Box, mode: str = "lidar") -> list[Column]:
    if mode == "camera":
        return [b.x, b.y - b.dy * 0.5, b.z]
    return [b.x, b.y, b.z + b.dz * 0.5]


def volume(b: Box) -> Column:
    return b.dx * b.dy * b.dz


def shift_origin(b: Box, src, dst) -> Box:
    """Move the stored centre from relative origin ``src`` to ``dst``."""
    return replace(
        b,
        x=b.x + b.dx * (dst[0] - src[0]), y=b.y + b.dy * (dst[1] - src[1]),
        z=b.z + b.dz * (dst[2] - src[2]))


def turn(u: Column, v: Column, angle: Column) -> tuple[Column, Column]:
    """Clockwise turn of a plane vector."""
    c, s = F.cos(angle), F.sin(angle)
    return u * c + v * s, v * c - u * s


def rotate_points(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Counter-clockwise turn about z, as points use it."""
    return turn(x, y, -angle)


def rotate(b: Box, angle: Column, mode: str = "lidar") -> Box:
    """Turn boxes about the vertical axis; yaw grows in LiDAR and camera axes and shrinks in depth axes."""
    if mode == "camera":
        x, z = turn(b.x, b.z, angle)
        return replace(b, x=x, z=z, yaw=b.yaw + angle)
    if mode == "depth":
        x, y = turn(b.x, b.y, -angle)
        return replace(b, x=x, y=y, yaw=b.yaw - angle)
    x, y = turn(b.x, b.y, angle)
    moved = replace(b, x=x, y=y, yaw=b.yaw + angle)
    if b.vx is not None:
        vx, vy = turn(b.vx, b.vy, angle)
        moved = replace(moved, vx=vx, vy=vy)
    return moved


def flip(b: Box, direction: str, mode: str = "lidar") -> Box:
    """Mirror boxes; which axis and which velocity part change depends on the mode."""
    horizontal = direction == "horizontal"
    if mode == "lidar":
        # the mirrored heading differs by axis: -yaw + pi across x-z, -yaw across y-z
        out = replace(b, y=-b.y, yaw=-b.yaw + PI) if horizontal else replace(b, x=-b.x, yaw=-b.yaw)
        if b.vx is not None:
            out = replace(out, vy=-b.vy) if horizontal else replace(out, vx=-b.vx)
        return out
    if horizontal:
        out = replace(b, x=-b.x, yaw=-b.yaw + PI)
        return replace(out, vx=-b.vx) if b.vx is not None else out
    if mode == "camera":
        return replace(b, z=-b.z, yaw=-b.yaw)
    out = replace(b, y=-b.y, yaw=-b.yaw)
    return replace(out, vy=-b.vy) if b.vx is not None else out


def scale(b: Box, factor: Column) -> Box:
    out = replace(b, x=b.x * factor, y=b.y * factor, z=b.z * factor,
                  dx=b.dx * factor, dy=b.dy * factor, dz=b.dz * factor)
    return replace(out, vx=b.vx * factor, vy=b.vy * factor) if b.vx is not None else out


def translate(b: Box, tx: Column, ty: Column, tz: Column) -> Box:
    return replace(b, x=b.x + tx, y=b.y + ty, z=b.z + tz)


def enlarge(b: Box, width: float) -> Box:
    return replace(b, dx=b.dx + 2 * width, dy=b.dy + 2 * width, dz=b.dz + 2 * width, z=b.z - width)


def corners(b: Box, mode: str = "lidar") -> list[tuple[Column, Column, Column]]:
    """The 8 corners in storage order."""
    out = []
    for bits in CORNER_BITS:
        off = [dim * (bit - org) for dim, bit, org in zip((b.dx, b.dy, b.dz), bits, ORIGIN[mode])]
        if mode == "camera":
            px, pz = turn(off[0], off[2], b.yaw)
            out.append((px + b.x, off[1] + b.y, pz + b.z))
        else:
            px, py = turn(off[0], off[1], b.yaw)
            out.append((px + b.x, py + b.y, off[2] + b.z))
    return out


def corners_array(b: Box, mode: str = "lidar") -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in corners(b, mode)])


def bev_columns(b: Box, mode: str = "lidar") -> list[Column]:
    """Centre, sides and yaw of the ground-plane rectangle."""
    return [b.x, b.z, b.dx, b.dz, b.yaw] if mode == "camera" else [b.x, b.y, b.dx, b.dy, b.yaw]


def bev_corners(b: Box, mode: str = "lidar") -> list[tuple[Column, Column]]:
    """The 4 ground corners in turning order."""
    cx, cy, w, h, yaw = bev_columns(b, mode)
    out = []
    for sx, sy in ((-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5)):
        px, py = turn(w * sx, h * sy, yaw)
        out.append((px + cx, py + cy))
    return out


def nearest_bev(b: Box, mode: str = "lidar") -> list[Column]:
    """x1, y1, x2, y2 of the unrotated rectangle; sides swap beyond 45 degrees."""
    cx, cy, w, h, yaw = bev_columns(b, mode)
    swap = F.abs(limit_period(yaw)) > PI / 4
    u, v = F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)
    return [cx - u / 2, cy - v / 2, cx + u / 2, cy + v / 2]


def xyxyr(b: Box, mode: str = "lidar") -> list[Column]:
    cx, cy, w, h, yaw = bev_columns(b, mode)
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, yaw]


def bev_bounds(b: Box, mode: str = "lidar") -> list[Column]:
    """Axis-aligned bounds of the rotated ground rectangle."""
    cx, cy, w, h, yaw = bev_columns(b, mode)
    co, si = F.abs(F.cos(yaw)), F.abs(F.sin(yaw))
    half_x, half_y = (w * co + h * si) / 2, (w * si + h * co) / 2
    return [cx - half_x, cy - half_y, cx + half_x, cy + half_y]


def convert_point(x: Column, y: Column, z: Column, src: str, dst: str, rt=None) -> list[Column]:
    """Axis swap of a point, or an explicit 3x3 / 3x4 literal matrix."""
    if src == dst:
        return [x, y, z]
    out = []
    for row in rt or POINT_AXES[(src, dst)]:
        v = x * float(row[0]) + y * float(row[1]) + z * float(row[2])
        out.append(v + float(row[3]) if len(row) > 3 else v)
    return out


def convert_box(b: Box, src: str, dst: str, rt=None) -> Box:
    if src == dst:
        return b
    axes, order = BOX_AXES[(src, dst)]
    x, y, z = convert_point(b.x, b.y, b.z, src, dst, rt or axes)
    dims = (b.dx, b.dy, b.dz)
    return replace(b, x=x, y=y, z=z, dx=dims[order[0]], dy=dims[order[1]], dz=dims[order[2]])


def in_box_local(px: Column, py: Column, b: Box) -> tuple[Column, Column]:
    """Point coordinates in the box frame, turned by ``yaw + pi/2``."""
    a = b.yaw + PI / 2
    c, s = F.cos(a), F.sin(a)
    sx, sy = px - b.x, py - b.y
    return sx * c - sy * s, sx * s + sy * c


def point_in_box(px: Column, py: Column, pz: Column, b: Box) -> Column:
    """Closed in z, open in the plane; the second side lies along local x."""
    lx, ly = in_box_local(px, py, b)
    return ((F.abs(pz - (b.z + b.dz / 2)) <= b.dz / 2)
            & (lx > -b.dy / 2) & (lx < b.dy / 2) & (ly > -b.dx / 2) & (ly < b.dx / 2))


def surface_centres(b: Box) -> list[tuple[Column, Column, Column]]:
    """Centres of the 6 faces (depth axes)."""
    units = ((0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0))
    return _offset_centres(b, units)


def line_centres(b: Box) -> list[tuple[Column, Column, Column]]:
    """Centres of the 12 edges (depth axes): four top, four bottom, four upright."""
    units = ((1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1), (1, 0, -1), (-1, 0, -1),
             (0, 1, -1), (0, -1, -1), (1, 1, 0), (1, -1, 0), (-1, 1, 0), (-1, -1, 0))
    return _offset_centres(b, units)


def _offset_centres(b: Box, units) -> list[tuple[Column, Column, Column]]:
    gx, gy, gz = gravity_centre(b)
    out = []
    for u in units:
        ox, oy, oz = b.dx * (u[0] / 2), b.dy * (u[1] / 2), b.dz * (u[2] / 2)
        px, py = turn(ox, oy, b.yaw)
        out.append((gx + px, gy + py, gz + oz))
    return out
