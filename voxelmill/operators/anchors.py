"""Anchors, box faces, camera matrices and label rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions.boxes import Box, box, corners_array
from voxelmill.operators.points import lidar_to_camera, project

c = F.col


def box_faces(b: Box) -> Column:
    """Outward plane (nx, ny, nz, d) of the 6 faces: -x, +x, -y, +y, bottom, top of the turned box."""
    co, si, zero = F.cos(b.yaw), F.sin(b.yaw), F.lit(0.0)
    planes = []
    for (ux, uy), half in (((co, -si), b.dx / 2), ((si, co), b.dy / 2)):
        for sign in (-1.0, 1.0):
            nx, ny = ux * sign, uy * sign
            offset = -(nx * b.x + ny * b.y + half)
            planes.append((nx, ny, zero, offset))
    planes.append((zero, zero, F.lit(-1.0), b.z))
    planes.append((zero, zero, F.lit(1.0), -(b.z + b.dz)))
    return F.array(*[F.struct(nx.alias("nx"), ny.alias("ny"), nz.alias("nz"), d.alias("d")) for nx, ny, nz, d in planes])


def attribute_rule(name: Column, vx: Column, vy: Column, moving: dict, still: dict, default: Column,
                   limit: float = 0.2) -> Column:
    """Attribute by class and speed; strictly faster than ``limit`` counts as moving."""
    def pick(table):
        value = None
        for k, attr in table.items():
            value = F.when(name == k, attr) if value is None else value.when(name == k, attr)
        return value.otherwise(default)

    speed = F.sqrt(vx * vx + vy * vy)
    return F.when(speed > limit, pick(moving)).otherwise(pick(still))


def anchor_grid(classes: DataFrame, x: tuple, y: tuple, rotations, aligned: bool) -> DataFrame:
    """Anchors of every class row over a lattice ``(low, high, steps)`` per axis.

    Unaligned anchors reach both ends of the range; aligned ones sit on cell centres.
    """
    def steps(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def place(index, axis):
        lo, hi, n = axis
        if aligned:
            return index * ((hi - lo) / n) + (lo + (hi - lo) / n / 2)
        return index * ((hi - lo) / max(n - 1, 1)) + lo

    return (classes.withColumn("ix", steps(x[2])).withColumn("iy", steps(y[2]))
            .withColumn("yaw", F.explode(F.array(*[F.lit(float(r)) for r in rotations])))
            .withColumn("x", place(c("ix"), x)).withColumn("y", place(c("iy"), y)))


def camera_intrinsics(width: int, height: int, hfov: Column) -> list[list[Column]]:
    """Pinhole matrix of a simulator camera: principal point at ``(size - 1) / 2``, square pixels."""
    f = width / (2 * F.tan(hfov / 2))
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[f, zero, F.lit((width - 1) / 2)], [zero, f, F.lit((height - 1) / 2)], [zero, zero, one]]


def image_bounds(df: DataFrame, k, near: float = 0.1) -> DataFrame:
    """2D bounds (u1, v1, u2, v2) of the projected corners of each LiDAR box.

    Only corners deeper than ``near`` in front of the camera have a place in the image; boxes without
    such a corner give no row. Corners stay one array column, so the projection is written once and not
    eight times.
    """
    def depth(p: Column) -> Column:
        x, y, z = lidar_to_camera(p.x, p.y, p.z)
        return x * k[2][0] + y * k[2][1] + z * k[2][2]

    pts = df.withColumn("_p", F.filter(corners_array(box()), lambda p: depth(p) > near)).where(F.size("_p") > 0)
    uvs = pts.withColumn("_q", F.transform("_p", lambda p: F.struct(*[
        e.alias(n) for e, n in zip(project(*lidar_to_camera(p.x, p.y, p.z), k), ("u", "v", "d"))])))
    us, vs = F.transform("_q", lambda q: q.u), F.transform("_q", lambda q: q.v)
    return uvs.withColumns({"u1": F.array_min(us), "v1": F.array_min(vs), "u2": F.array_max(us),
                            "v2": F.array_max(vs)}).drop("_p", "_q")
