"""Frame-order checks and frame records, built on skew-safe windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.functions import linalg as la
from voxelmill.operators import index as ix
from voxelmill.skew import with_lag, with_row_number, with_running

c = F.col


def every_nth(df: DataFrame, order: Sequence[str], bucket: Column, n: int) -> DataFrame:
    """Every n-th row of the whole table in the given order, starting with the first."""
    numbered = with_row_number(df, [], [c(o) for o in order], bucket, "_rn")
    return numbered.withColumn("pos", c("_rn") - 1).where(F.pmod(c("pos"), F.lit(n)) == 0).drop("_rn")


def _faults(df: DataFrame, *tests: tuple[Column, str, str]) -> DataFrame:
    """One row per failed test."""
    found = F.filter(F.array(*[
        F.when(test, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
        for test, field, message in tests]), lambda f: f.isNotNull())
    return (df.withColumn("_f", F.explode(found)).withColumns({"field": c("_f.field"), "message": c("_f.message")})
            .drop("_f"))


def sequence_check(frames: DataFrame) -> DataFrame:
    """First id 0, contiguous ids, strictly growing timestamps; one row per fault."""
    linked = with_lag(frames, ["scene_id"], ["frame_id"], F.expr("frame_id div 65536"),
                      {"_pf": "frame_id", "_pt": "timestamp"})
    return _faults(
        linked,
        (c("_pf").isNull() & (c("frame_id") != 0), "frame_id", "first frame id is not 0"),
        (c("_pf").isNotNull() & (c("frame_id") != c("_pf") + 1), "frame_id", "frame ids are not contiguous"),
        (c("timestamp") <= c("_pt"), "timestamp", "timestamp does not grow"),
    )


def append_order_check(frames: DataFrame, arrival: str) -> DataFrame:
    """Frames whose id is not the number of earlier arrivals or whose timestamp is not later."""
    bucket = F.expr(f"{arrival} div 1048576")
    numbered = with_row_number(frames, ["scene_id"], [c(arrival)], bucket, "_rn")
    linked = with_lag(numbered, ["scene_id"], [arrival], bucket, {"_pt": "timestamp"})
    return linked.withColumn("expected", c("_rn") - 1).where(
        (c("frame_id") != c("expected")) | (c("timestamp") <= c("_pt")))


def best_so_far(epochs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running best value and epochs since it was reached (no minimum improvement)."""
    best = with_running(epochs, keys, ["epoch"], F.expr("epoch div 4096"), {"best": ("max", "value")})
    best = best.withColumn("_hit", F.when(c("value") == c("best"), c("epoch")))
    last = with_running(best, keys, ["epoch"], F.expr("epoch div 4096"), {"_last": ("max", "_hit")})
    return last.withColumn("stale", c("epoch") - c("_last")).drop("_hit", "_last")


def radar_compensate(sweeps: DataFrame, mount_yaw: float) -> DataFrame:
    """Turn the velocity (``s_tx, s_ty``) of a sweep and move its position by velocity times lag."""
    vx, vy = bx.rotate_points(c("s_tx"), c("s_ty"), F.lit(mount_yaw))
    lag = (c("timestamp") - c("s_timestamp")) / 1e6
    return sweeps.withColumns({"vx": vx, "vy": vy, "lag": lag}).withColumn("x", c("s_yaw") + c("vx") * c("lag"))


# Fixed LiDAR mount of the planar fixture robot.
LIDAR_MOUNT = 0.5


CALIBRATION = ("ego2global", "lidar2ego", "camera2ego", "camera2lidar", "lidar2camera", "camera_intrinsics", "lidar2image")


def frame_calibration(df: DataFrame, ego2global: la.Mat, lidar2ego: la.Mat, camera2ego: la.Mat,
                      camera2lidar: la.Mat, intrinsics: la.Mat) -> DataFrame:
    """The seven 4x4 matrices of a camera row as ``array<array<double>>`` columns.

    ``camera2lidar`` is rigid and its inverse exact; the 3x3 ``intrinsics`` are padded with a one, and
    ``lidar2image`` gives depth-scaled pixels. Each product is a projection of its own.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    padded = [[*row, zero] for row in intrinsics] + [[zero, zero, zero, one]]
    given = {"ego2global": ego2global, "lidar2ego": lidar2ego, "camera2ego": camera2ego,
             "camera2lidar": camera2lidar, "camera_intrinsics": padded}
    df = df.withColumns({n: la.to_array(m) for n, m in given.items()})
    df = df.withColumn("lidar2camera", la.to_array(la.rigid_inverse(la.from_array("camera2lidar", 4, 4))))
    image = la.matmul(la.from_array("camera_intrinsics", 4, 4), la.from_array("lidar2camera", 4, 4))
    return df.withColumn("lidar2image", la.to_array(image))


def training_records(poses: DataFrame, max_sweeps: int) -> DataFrame:
    """Training record of every frame: ego quaternion and translation, camera to LiDAR, sweep
    count, empty annotation arrays."""
    pose = la.yaw_pose(c("tx"), c("ty"), c("yaw"))
    rec = la.with_quaternion(poses, [row[:3] for row in pose[:3]], "ego_qw", "ego_qx", "ego_qy", "ego_qz")
    sweeps = ix.earlier_records(poses, ["scene_id"], ["tx"], max_sweeps, pos="frame_id")
    counts = sweeps.groupBy("scene_id", "frame_id").agg(F.count("*").alias("sweeps"))
    cam2lidar = la.matmul(
        la.rigid_inverse(la.lit_matrix([[1, 0, 0, LIDAR_MOUNT], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])),
        la.lit_matrix([[1, 0, 0, 0.3], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]))
    return rec.join(counts, ["scene_id", "frame_id"], "left").withColumns({
        "sweeps": F.coalesce("sweeps", F.lit(0).cast("bigint")), "ego_x": c("tx"), "ego_y": c("ty"),
        "cam2lidar_x": cam2lidar[0][3], "n_boxes": F.size(F.array().cast("array<array<float>>"))})
