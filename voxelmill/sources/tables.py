"""Text and JSON inputs parsed with explicit schemas; bad rows are kept with their fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

c = F.col


def parse_manifest(lines: DataFrame, schema: str | StructType) -> DataFrame:
    """JSON Lines in column ``value``: parsed ``record`` and ``fault`` for blank lines and
    anything that is not an object."""
    text = F.trim("value")
    fault = F.when(text == "", "blank line").when(~(text.startswith("{") & text.endswith("}")), "not an object")
    record = F.when(fault.isNull(), F.from_json("value", schema))
    return lines.withColumns({"record": record, "fault": fault})


def read_manifest(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return parse_manifest(spark.read.text(path), schema)


def read_sensor_log(spark: SparkSession, folder: str, schemas: dict[str, StructType | str]) -> dict[str, DataFrame]:
    """Raw log tables, one multi-line JSON file each."""
    return {name: spark.read.schema(s).json(f"{folder}/{name}.json", multiLine=True) for name, s in schemas.items()}


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """JSON object of split name to scene list, one row per (split, scene)."""
    raw = spark.read.text(path, wholetext=True)
    table = F.from_json("value", "map<string, array<string>>")
    return raw.select(F.explode(table).alias("split", "_s")).select("split", F.explode("_s").alias("scene_id"))


def assign_splits(scenes: DataFrame, splits: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Split of every scene (all ``train`` without a table) and the faults: unknown names in
    the table and scenes it misses."""
    if splits is None:
        none = scenes.limit(0).select("scene_id", F.lit("").alias("message"))
        return scenes.select("scene_id").distinct().withColumn("split", F.lit("train")), none
    known = scenes.select("scene_id").distinct()
    unknown = splits.join(known, "scene_id", "left_anti").select("scene_id", F.lit("unknown scene").alias("message"))
    missing = known.join(splits, "scene_id", "left_anti").withColumn("message", F.lit("scene has no split"))
    return known.join(splits, "scene_id"), unknown.unionByName(missing)


def parse_trajectory(lines: DataFrame, invert: bool = False) -> DataFrame:
    """``timestamp tx ty tz qx qy qz qw`` rows: raw id in millions of ticks and the pose with a
    unit quaternion; a zero quaternion or a wrong column count is a fault."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("_p", parts).withColumn("fault", F.when(F.size("_p") != 8, "expected 8 columns"))
    names = ("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    rows = rows.withColumns({n: F.get(c("_p"), F.lit(i)).try_cast("double") for i, n in enumerate(names)})
    norm = F.sqrt(sum((c(q) * c(q) for q in ("qy", "qz", "qw")), c("qx") * c("qx")))
    rows = rows.withColumn("_n", norm).withColumn("fault", F.coalesce(
        "fault", F.when(c("ts").isNull(), "not a number"), F.when(c("_n") == 0, "zero quaternion")))
    rows = rows.withColumns({q: c(q) / F.nullif(c("_n"), F.lit(0.0)) for q in ("qx", "qy", "qz", "qw")})
    rows = rows.withColumn("raw_id", F.rint(c("ts") / 1e6).cast("bigint")).drop("_p", "_n", "ts", "value")
    return invert_pose(rows) if invert else rows


def invert_pose(rows: DataFrame) -> DataFrame:
    """Inverse of translation plus unit quaternion columns."""
    x, y, z, w = -c("qx"), -c("qy"), -c("qz"), c("qw")
    tx, ty, tz = -c("tx"), -c("ty"), -c("tz")
    # rotate t by the conjugate quaternion: t + 2 w (q x t) + 2 q x (q x t)
    ux, uy, uz = y * tz - z * ty, z * tx - x * tz, x * ty - y * tx
    return rows.withColumns({
        "tx": tx + 2 * (w * ux + y * uz - z * uy), "ty": ty + 2 * (w * uy + z * ux - x * uz),
        "tz": tz + 2 * (w * uz + x * uy - y * ux), "qx": x, "qy": y, "qz": z})


def duplicate_ids(rows: DataFrame, key: str = "raw_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(c("n") > 1)


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_intrinsics(files: DataFrame) -> DataFrame:
    """Four numbers (an ``f`` suffix is allowed) per file: fx, fy, cx, cy or a fault."""
    nums = F.regexp_extract_all("value", F.lit(f"({_NUMBER})"), 1)
    rows = files.withColumn("_k", F.transform(nums, lambda t: t.cast("double")))
    rows = rows.withColumns({n: F.get(c("_k"), F.lit(i)) for i, n in enumerate(("fx", "fy", "cx", "cy"))})
    fault = F.when(F.size("_k") != 4, "expected 4 numbers").when((c("fx") <= 0) | (c("fy") <= 0), "focal length is not positive")
    return rows.withColumn("fault", fault).drop("_k", "value")


def parse_transform(files: DataFrame) -> DataFrame:
    """3x4 or 4x4 matrix text per file as ``array<array<double>>`` or a fault."""
    nums = F.filter(F.split(F.trim("value"), r"[\s,]+"), lambda t: t != "")
    rows = files.withColumn("_m", F.transform(nums, lambda t: t.try_cast("double")))
    full = F.when(F.size("_m") == 12, F.concat("_m", F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))).otherwise(c("_m"))
    rows = rows.withColumn("_m", full)
    bad = F.exists("_m", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fault = F.when(F.size("_m") != 16, "expected 12 or 16 numbers").when(bad, "not finite")
    matrix = F.array(*[F.slice("_m", 4 * i + 1, 4) for i in range(4)])
    return rows.withColumn("fault", fault).withColumn("matrix", F.when(fault.isNull(), matrix)).drop("_m", "value")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def calibration_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    return parse_intrinsics(_whole(spark, path))


def calibration_transforms(spark: SparkSession, path: str) -> DataFrame:
    return parse_transform(_whole(spark, path))


def read_trajectory(spark: SparkSession, path: str, invert: bool = False) -> DataFrame:
    return parse_trajectory(spark.read.text(path), invert)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, stem and length of the files below a folder; contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
             .load(folder).select("path", "length"))
    return files.withColumn("stem", file_stem(c("path")))
