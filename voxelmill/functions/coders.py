"""Box regression targets and their inverses, as columns of joined object rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelmill.functions.boxes import Box

PI = math.pi
BOX_NAMES = ("x", "y", "z", "dx", "dy", "dz", "yaw")


def delta_encode(anchor: Box, target: Box) -> dict[str, Column]:
    """Offsets scaled by the anchor's ground diagonal and height, log size ratios, yaw difference."""
    diag = F.sqrt(anchor.dx * anchor.dx + anchor.dy * anchor.dy)
    mid = lambda b: b.z + b.dz / 2
    out = {
        "tx": (target.x - anchor.x) / diag, "ty": (target.y - anchor.y) / diag,
        "tz": (mid(target) - mid(anchor)) / anchor.dz,
        "tdx": F.log(target.dx / anchor.dx), "tdy": F.log(target.dy / anchor.dy),
        "tdz": F.log(target.dz / anchor.dz), "tyaw": target.yaw - anchor.yaw,
    }
    if anchor.vx is not None:
        out.update(tvx=target.vx - anchor.vx, tvy=target.vy - anchor.vy)
    return out


def delta_decode(anchor: Box, prefix: str = "t") -> dict[str, Column]:
    t = lambda n: F.col(prefix + n)
    diag = F.sqrt(anchor.dx * anchor.dx + anchor.dy * anchor.dy)
    dz = F.exp(t("dz")) * anchor.dz
    out = {
        "x": t("x") * diag + anchor.x, "y": t("y") * diag + anchor.y,
        "z": t("z") * anchor.dz + anchor.z + anchor.dz / 2 - dz / 2,
        "dx": F.exp(t("dx")) * anchor.dx, "dy": F.exp(t("dy")) * anchor.dy, "dz": dz,
        "yaw": t("yaw") + anchor.yaw,
    }
    if anchor.vx is not None:
        out.update(vx=t("vx") + anchor.vx, vy=t("vy") + anchor.vy)
    return out


def centre_encode(b: Box, origin: Sequence[float], voxel: Sequence[float], stride: int) -> dict[str, Column]:
    """Cell coordinates, gravity height, log sizes, sine and cosine of yaw, velocity."""
    out = {
        "cu": (b.x - origin[0]) / (stride * voxel[0]), "cv": (b.y - origin[1]) / (stride * voxel[1]),
        "cz": b.z + b.dz * 0.5, "ldx": F.log(b.dx), "ldy": F.log(b.dy), "ldz": F.log(b.dz),
        "sin_yaw": F.sin(b.yaw), "cos_yaw": F.cos(b.yaw),
    }
    if b.vx is not None:
        out.update(vx=b.vx, vy=b.vy)
    return out


def centre_decode(origin: Sequence[float], voxel: Sequence[float], stride: int, gravity: bool) -> dict[str, Column]:
    """Inverse of ``centre_encode`` on its column names; ``gravity`` moves z back to the bottom."""
    c = F.col
    dz = F.exp("ldz")
    return {
        "x": c("cu") * stride * voxel[0] + origin[0], "y": c("cv") * stride * voxel[1] + origin[1],
        "z": c("cz") - dz * 0.5 if gravity else c("cz"),
        "dx": F.exp("ldx"), "dy": F.exp("ldy"), "dz": dz, "yaw": F.atan2("sin_yaw", "cos_yaw"),
    }


def angle_to_bin(angle: Column, bins: int) -> tuple[Column, Column]:
    """Bin whose centre is nearest, and the signed rest to that centre."""
    full, step = 2 * PI, 2 * PI / bins
    wrap = lambda v: v - F.floor(v / full) * full
    shifted = wrap(wrap(angle) + step / 2)
    index = F.floor(shifted / step)
    return index, shifted - (index * step + step / 2)


def bin_to_angle(index: Column, rest: Column, bins: int) -> Column:
    angle = index * (2 * PI / bins) + rest
    return F.when(angle > PI, angle - 2 * PI).otherwise(angle)


def size_residual(b: Box, label: Column, mean_sizes: Sequence[Sequence[float]]) -> list[Column]:
    """Sizes minus the mean sizes of the class; ``mean_sizes`` is a fixed literal table."""
    return [dim - F.array(*[F.lit(float(m[i])) for m in mean_sizes])[label]
            for i, dim in enumerate((b.dx, b.dy, b.dz))]


def normalise_box(b: Box) -> dict[str, Column]:
    out = {"cx": b.x, "cy": b.y, "lw": F.log(b.dx), "ll": F.log(b.dy), "cz": b.z, "lh": F.log(b.dz),
           "sin_yaw": F.sin(b.yaw), "cos_yaw": F.cos(b.yaw)}
    if b.vx is not None:
        out.update(vx=b.vx, vy=b.vy)
    return out


def denormalise_box() -> dict[str, Column]:
    c = F.col
    return {"x": c("cx"), "y": c("cy"), "z": c("cz"), "dx": F.exp("lw"), "dy": F.exp("ll"), "dz": F.exp("lh"),
            "yaw": F.atan2("sin_yaw", "cos_yaw")}


def gaussian_radius(length: Column, width: Column, overlap: float) -> Column:
    """Smallest of the larger roots of three quadratics for a wanted overlap."""
    total, area = length + width, length * width
    quads = (
        (1.0, total, area * (1 - overlap) / (1 + overlap)),
        (4.0, 2 * total, area * (1 - overlap)),
        (4 * overlap, total * (-2 * overlap), area * (overlap - 1)),
    )
    return F.least(*[(b + F.sqrt(b * b - 4 * a * q)) / 2 for a, b, q in quads])
