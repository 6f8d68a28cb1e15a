"""Overlap area of turned rectangles, vectorised over Arrow batches.

By Green's theorem the border of the common region consists of the parts of each
rectangle's edges that lie inside the other one. Every edge is clipped against four half
planes and the cross products of the remaining pieces are summed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-9


def corners(x, y, w, h, yaw):
    """``[n, 4, 2]`` corners in counter-clockwise order."""
    c, s = np.cos(yaw)[:, None], np.sin(yaw)[:, None]
    ux = np.array([-0.5, 0.5, 0.5, -0.5])[None, :] * w[:, None]
    uy = np.array([-0.5, -0.5, 0.5, 0.5])[None, :] * h[:, None]
    return np.stack([ux * c + uy * s + x[:, None], uy * c - ux * s + y[:, None]], axis=-1)


def _pieces(edges: np.ndarray, clip: np.ndarray, keep_shared: bool) -> np.ndarray:
    """Sum over the edges of the cross product of their part inside ``clip``."""
    p, q = edges, np.roll(edges, -1, axis=1)
    d = q - p
    lo, hi = np.zeros(p.shape[:2]), np.ones(p.shape[:2])
    for k in range(4):
        a, b = clip[:, None, k], clip[:, None, (k + 1) % 4]
        e = b - a
        length = np.sqrt((e * e).sum(-1))
        start = (e[..., 0] * (p[..., 1] - a[..., 1]) - e[..., 1] * (p[..., 0] - a[..., 0])) / length
        slope = (e[..., 0] * d[..., 1] - e[..., 1] * d[..., 0]) / length
        flat = np.abs(slope) < EPS
        with np.errstate(divide="ignore", invalid="ignore"):
            t = -start / slope
        lo = np.where(~flat & (slope > 0), np.maximum(lo, t), lo)
        hi = np.where(~flat & (slope < 0), np.minimum(hi, t), hi)
        # a shared border line counts once, and only if both interiors lie on the same side
        opposite = (e * d).sum(-1) < 0
        outside = (start < -EPS) | ((start < EPS) & opposite) if keep_shared else start < EPS
        hi = np.where(flat & outside, -1.0, hi)
    open_part = hi > lo
    s, t = p + d * lo[..., None], p + d * hi[..., None]
    cross = s[..., 0] * t[..., 1] - s[..., 1] * t[..., 0]
    return np.where(open_part, cross, 0.0).sum(axis=1)


def overlap_area(ax, ay, aw, ah, ayaw, bx, by, bw, bh, byaw) -> np.ndarray:
    # work relative to the first centre to keep the products small
    zero = np.zeros_like(ax)
    a = corners(zero, zero, aw, ah, ayaw)
    b = corners(bx - ax, by - ay, bw, bh, byaw)
    return np.maximum(0.5 * (_pieces(a, b, True) + _pieces(b, a, False)), 0.0)


@F.pandas_udf(T.DoubleType())
def rectangle_overlap_area(ax: pd.Series, ay: pd.Series, aw: pd.Series, ah: pd.Series, ayaw: pd.Series,
                           bx: pd.Series, by: pd.Series, bw: pd.Series, bh: pd.Series, byaw: pd.Series) -> pd.Series:
    args = [s.to_numpy(dtype=float) for s in (ax, ay, aw, ah, ayaw, bx, by, bw, bh, byaw)]
    return pd.Series(overlap_area(*args))
