"""Data checks. Every check returns all faults as rows (scene_id, frame_id, field, message).

Checks are filters, aggregates, windows over slices and anti joins; ``strict`` turns a
non-empty table into an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions.text import normalize_relative_path

c = F.col
FAULT = ["scene_id", "frame_id", "field", "message"]


class DatasetFault(ValueError):
    """Raised by ``strict`` with the first fault as its message."""


def strict(faults: DataFrame) -> None:
    first = faults.first()
    if first is not None:
        raise DatasetFault(" ".join(f"{k}={first[k]}" for k in faults.columns))


def faults_where(df: DataFrame, test: Column, field: str, message: str, scene: str = "scene_id",
                 frame: str = "frame_id") -> DataFrame:
    """Rows that fail a test."""
    frame_col = c(frame) if frame in df.columns else F.lit(None).cast("bigint")
    scene_col = c(scene).cast("string") if scene in df.columns else F.lit(None).cast("string")
    return df.where(F.coalesce(test, F.lit(False))).select(
        scene_col.alias("scene_id"), frame_col.alias("frame_id"), F.lit(field).alias("field"), F.lit(message).alias("message"))


def union_faults(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Full outer, null-safe comparison: keys on one side only, and each differing field."""
    a = left.select(*keys, *[c(f).alias("l_" + f) for f in fields], F.lit(True).alias("_l"))
    b = right.select(*keys, *[c(f).alias("r_" + f) for f in fields], F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full")
    tests = [F.when(c("_r").isNull(), F.lit("missing right")), F.when(c("_l").isNull(), F.lit("missing left"))]
    tests += [F.when(c("_l") & c("_r") & ~c("l_" + f).eqNullSafe(c("r_" + f)), F.lit(f)) for f in fields]
    return both.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("field"))


def set_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    only_l = left.select(*keys).distinct().join(right, list(keys), "left_anti").withColumn("side", F.lit("left"))
    only_r = right.select(*keys).distinct().join(left, list(keys), "left_anti").withColumn("side", F.lit("right"))
    return only_l.unionByName(only_r)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(c("n") > 1)


def check_splits(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Unknown split names and scenes that occur in more than one split."""
    unknown = faults_where(rows.select("split").distinct(), ~c("split").isin(*names), "splits", "no such split")
    shared = rows.groupBy("scene_id").agg(F.countDistinct("split").alias("n"))
    return unknown.unionByName(faults_where(shared, c("n") > 1, "splits", "scene belongs to several splits"))


def split_disjoint(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scene_id").agg(F.countDistinct("split").alias("splits")).where(c("splits") > 1)


def check_paths(frames: DataFrame, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Paths that are missing, not canonical, leave the root, or do not exist."""
    norm = normalize_relative_path(c(path))
    out = union_faults(
        faults_where(frames, c(path).isNull(), path, "path is missing"),
        faults_where(frames, c(path).isNotNull() & norm.isNull(), path, "path leaves the dataset root"),
        faults_where(frames, norm.isNotNull() & (norm != c(path)), path, "path is not canonical"))
    if existing is not None:
        lost = frames.where(norm == c(path)).join(existing.select(c("path").alias(path)), path, "left_anti")
        out = out.unionByName(faults_where(lost, F.lit(True), path, "file does not exist"))
    return out


def check_intrinsics(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Focal lengths above zero, last row 0 0 1, principal point inside the image."""
    field = "cam_intrinsic"
    return union_faults(
        faults_where(frames, (F.abs(c("k20")) > 1e-6) | (F.abs(c("k21")) > 1e-6) | (F.abs(c("k22") - 1) > 1e-6), field, "last row is not 0 0 1"),
        faults_where(frames, (c("fx") <= 0) | (c("fy") <= 0), field, "focal length is not positive"),
        faults_where(frames, ~((c("cx") >= 0) & (c("cx") < width) & (c("cy") >= 0) & (c("cy") < height)), field, "principal point is outside the image"))


def check_transforms(frames: DataFrame, matrix: str, tolerance: float = 1e-3) -> DataFrame:
    """Last row, orthonormal rotation and determinant +1 of a 4x4 ``array<array<double>>``."""
    m = [[c(matrix)[i][j] for j in range(4)] for i in range(4)]
    bottom = F.lit(False)
    for j, want in enumerate((0.0, 0.0, 0.0, 1.0)):
        bottom = bottom | (F.abs(m[3][j] - want) > 1e-6)
    skewed = F.lit(False)
    for i in range(3):
        for j in range(i, 3):
            gram = m[0][i] * m[0][j] + m[1][i] * m[1][j] + m[2][i] * m[2][j]
            skewed = skewed | (F.abs(gram - (1.0 if i == j else 0.0)) > tolerance)
    det = (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
           + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))
    return union_faults(
        faults_where(frames, bottom, matrix, "last row is not 0 0 0 1"),
        faults_where(frames, skewed, matrix, "rotation is not orthonormal"),
        faults_where(frames, F.abs(det - 1.0) > tolerance, matrix, "determinant is not +1"))


def check_points(files: DataFrame, points: DataFrame, row_bytes: int = 20) -> DataFrame:
    """Byte length not a multiple of the row size; points with non-finite values."""
    finite = F.lit(True)
    for k in ("x", "y", "z", "intensity"):
        finite = finite & ~F.isnan(k) & (F.abs(c(k)) != float("inf"))
    broken = points.where(~finite).select("scene_id", "frame_id").distinct()
    return faults_where(files, c("length") % row_bytes != 0, "lidar_path", "byte length is not a multiple of the row size") \
        .unionByName(faults_where(broken, F.lit(True), "lidar_path", "points are not finite"))


def check_counts(manifest: DataFrame, actual: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Stored counts against recomputed ones."""
    return field_differences(manifest, actual, ["frame_id"], fields)


def check_binary_masks(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Frames with mask values other than 0/1 or cells outside the grid."""
    bad = cells.groupBy("frame_id").agg(
        F.max((~c("label").isin(0, 1)).cast("int")).alias("value"),
        F.max((~(c("row").between(0, rows - 1) & c("col").between(0, cols - 1))).cast("int")).alias("shape"))
    return faults_where(bad, c("value") == 1, "bev_mask_path", "mask value is not 0 or 1").unionByName(
        faults_where(bad, c("shape") == 1, "bev_mask_path", "cell is outside the mask"))


def check_labels_observed(cells: DataFrame) -> DataFrame:
    """Number of labelled cells per frame that no observation covers."""
    seen = cells.where(c("observed") == 1).select("frame_id", "row", "col")
    lost = cells.where(c("label") == 1).join(seen, ["frame_id", "row", "col"], "left_anti")
    return lost.groupBy("frame_id").agg(F.count("*").alias("cells"))


def check_semantic_map(mapping: DataFrame, ignored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Ids outside 16 bits, unknown classes, ids both mapped and ignored."""
    both = mapping.join(ignored, "semantic_id", "left_semi")
    parts = [(mapping.where(~c("semantic_id").between(0, 65535)), "id out of range"),
             (mapping.where(~c("class").isin(*classes)), "unknown class"), (both, "mapped and ignored")]
    out = None
    for df, message in parts:
        rows = df.select("semantic_id", F.lit(message).alias("message"))
        out = rows if out is None else out.unionByName(rows)
    return out


def json_type_faults(rows: DataFrame, text: str, field: str, pattern: str, message: str) -> DataFrame:
    """Raw JSON text whose field is not written as the wanted type."""
    good = c(text).rlike(rf'"{field}"\s*:\s*{pattern}\s*[,}}]')
    return faults_where(rows, ~good, field, message)


JSON_INTEGER = r"-?\d+"
JSON_TRUE = "true"
JSON_STRING = r'"[^"]*"'


def resume_guard(stored: DataFrame, current: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields of the stored contract that differ from the current one (null-safe)."""
    return field_differences(stored, current, keys, fields)


def validation_report(frames: DataFrame, warnings: DataFrame) -> DataFrame:
    counts = frames.groupBy("split").agg(F.count("*").alias("frames"))
    warned = warnings.groupBy("split").agg(F.count("*").alias("warnings"))
    return counts.join(warned, "split", "left").na.fill(0)
