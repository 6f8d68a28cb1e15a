"""Rotations, quaternions and rigid poses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mat = list[list[Column]]


def lit_matrix(rows) -> Mat:
    return [[F.lit(float(v)) for v in row] for row in rows]


def from_array(col: Column | str, n: int, m: int) -> Mat:
    """Elements of an ``array<array<double>>`` column."""
    col = F.col(col) if isinstance(col, str) else col
    return [[col[i][j] for j in range(m)] for i in range(n)]


def to_array(mat: Mat) -> Column:
    return F.array(*[F.array(*row) for row in mat])


def matmul(a: Mat, b: Mat) -> Mat:
    def cell(i, j):
        total = a[i][0] * b[0][j]
        for k in range(1, len(b)):
            total = total + a[i][k] * b[k][j]
        return total

    return [[cell(i, j) for j in range(len(b[0]))] for i in range(len(a))]


def transpose(a: Mat) -> Mat:
    return [list(col) for col in zip(*a)]


def apply_point(a: Mat, xyz: list[Column]) -> list[Column]:
    """``a @ [x y z 1]`` for a 3x4 or 4x4 matrix, ``a @ xyz`` for 3x3."""
    out = []
    for row in a[:3]:
        v = row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2]
        out.append(v + row[3] if len(row) > 3 else v)
    return out


def rigid_inverse(a: Mat, scale: Column | None = None) -> Mat:
    """Inverse of ``[sR | t]``: the transposed rotation (divided by s squared) and ``-R't``."""
    rt = transpose([row[:3] for row in a[:3]])
    if scale is not None:
        rt = [[v / (scale * scale) for v in row] for row in rt]
    t = [a[i][3] for i in range(3)]
    shift = [-(r[0] * t[0] + r[1] * t[1] + r[2] * t[2]) for r in rt]
    return [rt[i] + [shift[i]] for i in range(3)] + lit_matrix([[0, 0, 0, 1]])


def quat_to_matrix(w: Column, x: Column, y: Column, z: Column, normalise: bool = False) -> Mat:
    """Rotation of a unit quaternion; with ``normalise`` a zero quaternion is an error."""
    if normalise:
        norm = F.sqrt(w * w + x * x + y * y + z * z)
        norm = F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("zero quaternion")).cast("double"))
        w, x, y, z = w / norm, x / norm, y / norm, z / norm
    two = F.lit(2.0)
    one = F.lit(1.0)
    return [
        [one - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y)],
        [two * (x * y + w * z), one - two * (x * x + z * z), two * (y * z - w * x)],
        [two * (x * z - w * y), two * (y * z + w * x), one - two * (x * x + y * y)],
    ]


def with_quaternion(df: DataFrame, m: Mat, *names: str) -> DataFrame:
    """Add unit ``w, x, y, z`` (first non-zero component positive) of a rotation.

    The largest of the four squared components is solved for first, which keeps the
    divisor away from zero; the other three follow from the off-diagonal sums. The work is
    split into three projections so that shared terms are computed once.
    """
    one = F.lit(1.0)
    d = [m[0][0], m[1][1], m[2][2]]
    terms = {
        "ww": one + d[0] + d[1] + d[2], "xx": one + d[0] - d[1] - d[2],
        "yy": one - d[0] + d[1] - d[2], "zz": one - d[0] - d[1] + d[2],
        "wx": m[2][1] - m[1][2], "wy": m[0][2] - m[2][0], "wz": m[1][0] - m[0][1],
        "xy": m[0][1] + m[1][0], "xz": m[0][2] + m[2][0], "yz": m[1][2] + m[2][1],
    }
    c = lambda n: F.col(f"_q.{n}")
    rows = {"ww": ("ww", "wx", "wy", "wz"), "xx": ("wx", "xx", "xy", "xz"),
            "yy": ("wy", "xy", "yy", "yz"), "zz": ("wz", "xz", "yz", "zz")}
    df = df.withColumn("_q", F.struct(*[e.alias(n) for n, e in terms.items()]))
    df = df.withColumn("_best", F.greatest(*[c(n) for n in rows]))
    pick = None
    for lead, parts in rows.items():
        arr = F.array(*[c(n) for n in parts])
        pick = F.when(c(lead) == F.col("_best"), arr) if pick is None else pick.when(c(lead) == F.col("_best"), arr)
    df = df.withColumn("_v", pick)
    sign = F.when(F.filter("_v", lambda e: F.abs(e) > 1e-12)[0] < 0, -1.0).otherwise(1.0)
    df = df.withColumn("_s", sign / F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, e: acc + e * e)))
    return df.withColumns({n: F.col("_v")[i] * F.col("_s") for i, n in enumerate(names)}).drop("_q", "_best", "_v", "_s")


def yaw_pose(tx: Column, ty: Column, yaw: Column, tz: Column | float = 0.0) -> Mat:
    """4x4 pose of a planar robot."""
    c, s, o, one = F.cos(yaw), F.sin(yaw), F.lit(0.0), F.lit(1.0)
    z = F.lit(float(tz)) if not isinstance(tz, Column) else tz
    return [[c, -s, o, tx], [s, c, o, ty], [o, o, one, z], [o, o, o, one]]


def relative_pose(current: Mat, history: Mat) -> Mat:
    """Transform from the history frame to the current frame: ``inv(current) @ history``."""
    return matmul(rigid_inverse(current), history)


def euler_pose(t: list[Column], roll: Column, pitch: Column, yaw: Column) -> Mat:
    """4x4 pose that turns about x, then y, then z, and then shifts."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    turn = [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]
    return [[*row, v] for row, v in zip(turn, t)] + lit_matrix([[0, 0, 0, 1]])


def with_chain(df: DataFrame, poses: list[Mat], out: str) -> DataFrame:
    """Add the product of poses as ``array<array<double>>``; one projection a product, so that no term is
    computed twice."""
    df = df.withColumn(out, to_array(poses[0]))
    for pose in poses[1:]:
        df = df.withColumn("_next", to_array(pose)).withColumn(out, to_array(matmul(from_array(out, 4, 4), from_array("_next", 4, 4)))).drop("_next")
    return df
