"""Fixed contract values and explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the canonical frame contract.
SCHEMA_VERSION = 4
MAP_CLASSES = ("floor", "carpet", "wall", "furniture", "door", "clutter")
XBOUND = (0.0, 3.0, 0.02)
YBOUND = (-1.5, 1.5, 0.02)
ZBOUND = (-2.0, 2.0)
BEV_SHAPE = (150, 150)
POINT_DIM = 5
SPLITS = ("train", "val", "test")
METRIC_THRESHOLDS = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65)


@dataclass(frozen=True)
class Grid:
    """A bird's-eye-view grid: half-open in x and y, open on both sides in z."""

    x0: float
    x1: float
    y0: float
    y1: float
    z0: float
    z1: float
    cell: float

    @property
    def rows(self) -> int:
        return round((self.x1 - self.x0) / self.cell)

    @property
    def cols(self) -> int:
        return round((self.y1 - self.y0) / self.cell)


CANONICAL_GRID = Grid(XBOUND[0], XBOUND[1], YBOUND[0], YBOUND[1], *ZBOUND, XBOUND[2])

_matrix = T.ArrayType(T.ArrayType(T.FloatType()))

FRAMES = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("scene_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("token", T.StringType()),
    T.StructField("prev_token", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("image_path", T.StringType()),
    T.StructField("lidar_path", T.StringType()),
    T.StructField("bev_mask_path", T.StringType()),
    T.StructField("bev_observed_mask_path", T.StringType()),
    T.StructField("bev_supervision_mask_path", T.StringType()),
    T.StructField("depth_path", T.StringType()),
    T.StructField("semantic_path", T.StringType()),
    T.StructField("class_validity", T.ArrayType(T.ByteType())),
    T.StructField("cam_intrinsic", _matrix),
    T.StructField("camera2base", _matrix),
    T.StructField("lidar2base", _matrix),
    T.StructField("T_map_base", _matrix),
    T.StructField("pose_valid", T.BooleanType()),
    T.StructField("point_count", T.LongType()),
    T.StructField("observed_sum", T.LongType()),
    T.StructField("per_class_sums", T.ArrayType(T.LongType())),
])

POINTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("point_id", T.LongType()),
    T.StructField("x", T.FloatType()),
    T.StructField("y", T.FloatType()),
    T.StructField("z", T.FloatType()),
    T.StructField("intensity", T.FloatType()),
    T.StructField("time", T.FloatType()),
])

VIOLATIONS = "dataset string, scene string, frame bigint, field string, message string"
