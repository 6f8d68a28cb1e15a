"""Flat float files and .npy rasters as long tables.

Files are read with the ``binaryFile`` source (Spark plans and splits the listing) and
decoded inside tasks, one Arrow batch per file; only wanted columns leave Python. Files are made of
many frames at a time.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxelmill.operators.batches import group_ids, map_groups

c = F.col
POINT_NAMES = ("x", "y", "z", "intensity", "time")
PART = 1 << 16  # points in one file of a large cloud


def _matrix(content: bytes, load_dim: int, npy: bool) -> np.ndarray:
    flat = np.load(io.BytesIO(content)) if npy else np.frombuffer(content, dtype=np.float32)
    if flat.size % load_dim:
        raise ValueError(f"{flat.size} values do not divide into rows of {load_dim}")
    return flat.reshape(-1, load_dim)


def decode_points(files: DataFrame, load_dim: int = 5, use_dim: Sequence[int] = range(5),
                  names: Sequence[str] = POINT_NAMES, npy: bool = False) -> DataFrame:
    """Rows ``(path, point_id, <names>)`` of files with columns ``path`` and ``content``."""
    use, names = list(use_dim), list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                m = _matrix(content.as_py(), load_dim, npy)
                cols = [pa.array(np.full(len(m), path.as_py(), dtype=object), pa.string()), pa.array(np.arange(len(m), dtype=np.int64))]
                cols += [pa.array(np.ascontiguousarray(m[:, d], dtype=np.float32)) for d in use]
                yield pa.RecordBatch.from_arrays(cols, ["path", "point_id", *names[:len(use)]])

    schema = "path string, point_id bigint, " + ", ".join(f"{n} float" for n in names[:len(use)])
    return files.select("path", "content").mapInArrow(run, schema)


def read_points(spark: SparkSession, path: str, load_dim: int = 5, use_dim: Sequence[int] = range(5),
                names: Sequence[str] = POINT_NAMES, npy: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decode_points(files, load_dim, use_dim, names, npy)


def encode_points(points: DataFrame, names: Sequence[str] = POINT_NAMES) -> DataFrame:
    """Flat float contents, one per Arrow batch of the input (no grouping, no shuffle)."""
    names = list(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, pdf in enumerate(frames):
            yield pd.DataFrame({"path": [f"part-{n}.bin"], "content": [pdf[names].to_numpy(np.float32).tobytes()]})

    return points.select(*names).mapInPandas(run, "path string, content binary")


def encode_clouds(points: DataFrame, names: Sequence[str] = POINT_NAMES, part: int = PART) -> DataFrame:
    """Flat float files ``(frame_id, first, content)`` with the points of a frame in the order of ``point_id``,
    which counts from 0 without gaps. A file holds ``part`` points at most, ``first`` is the id of its first,
    so a task never meets a whole large cloud. Ranges of frames stay together for readers that skip."""
    names = list(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf[names].to_numpy(np.float32)
        start, stop = _runs(pdf, keys)
        content = [m[a:b].tobytes() for a, b in zip(start, stop)]
        return pd.DataFrame({"frame_id": pdf["frame_id"].to_numpy()[start], "first": pdf["first"].to_numpy()[start], "content": content})

    keys = ["frame_id", "first"]
    keyed = points.select("frame_id", "point_id", *names, (c("point_id") - c("point_id") % part).alias("first"))
    return map_groups(keyed, keys, [c("point_id")], run, "frame_id bigint, first bigint, content binary", ranged=True)


def _runs(pdf: pd.DataFrame, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the groups of a sorted frame."""
    ids = group_ids(pdf, keys)
    start = np.flatnonzero(np.diff(ids, prepend=-1))
    return start, np.append(start[1:], len(ids))


def write_files(files: DataFrame, folder: str) -> str:
    """Pack files, with their content and key columns, into Parquet: one listing of few large files, and a
    filter on the keys skips row groups without opening their contents."""
    files.write.mode("overwrite").parquet(folder)
    return folder


def read_clouds(spark: SparkSession, folder: str, load_dim: int = 5, use_dim: Sequence[int] = range(5),
                names: Sequence[str] = POINT_NAMES, where: Column | None = None) -> DataFrame:
    """Rows ``(path, frame_id, point_id, <names>)`` of packed clouds. ``where`` on ``frame_id`` or ``first``
    reaches the scan, and only the values of ``use_dim`` leave Python."""
    files = spark.read.parquet(folder)
    files = files if where is None else files.where(where)
    path = F.concat(c("frame_id").cast("string"), F.lit("/"), c("first").cast("string"), F.lit(".bin"))
    rows = decode_points(files.select(path.alias("path"), "content"), load_dim, use_dim, names)
    first = F.regexp_extract("path", r"/(\d+)\.bin$", 1).cast("bigint")
    return rows.select("path", F.split_part("path", F.lit("/"), F.lit(1)).cast("bigint").alias("frame_id"),
                       (first + c("point_id")).alias("point_id"), *rows.columns[2:])


def decode_masks(files: DataFrame, shape: Sequence[int] | None = None) -> DataFrame:
    """Set cells ``(path, class_id, row, col, value)`` of ``[C, H, W]`` or ``[H, W]`` arrays; another
    ``shape`` than the stated one is an error."""
    shape = None if shape is None else tuple(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                a = np.load(io.BytesIO(content.as_py()))
                if a.ndim not in (2, 3):
                    raise ValueError(f"{path.as_py()}: expected two or three dimensions, got {a.ndim}")
                if shape is not None and a.shape != shape:
                    raise ValueError(f"{path.as_py()}: expected shape {shape}, got {a.shape}")
                a = a[None] if a.ndim == 2 else a
                k, r, q = (i.astype(np.int64) for i in np.nonzero(a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()] * len(k), pa.string()), pa.array(k), pa.array(r), pa.array(q), pa.array(a[k, r, q].astype(np.int64))],
                    ["path", "class_id", "row", "col", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, class_id bigint, row bigint, col bigint, value bigint")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    return decode_masks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def encode_rasters(cells: DataFrame, rows: int, cols: int, classes: int = 1, value: str = "value",
                   dtype: str = "uint8") -> DataFrame:
    """One .npy content per frame. A raster holds at most ``classes * rows * cols`` cells, which
    bounds the group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = [pdf[k].to_numpy(int) for k in ("class_id", "row", "col")]
        values = pdf[value].to_numpy()
        start, stop = _runs(pdf, ["frame_id"])
        contents = []
        for a, b in zip(start, stop):
            raster = np.zeros((classes, rows, cols), dtype=dtype)
            raster[tuple(p[a:b] for p in place)] = values[a:b]
            out = io.BytesIO()
            np.save(out, raster[0] if classes == 1 else raster)
            contents.append(out.getvalue())
        return pd.DataFrame({"path": [str(f) for f in pdf["frame_id"].to_numpy()[start]], "content": contents})

    unique = cells.groupBy("frame_id", "class_id", "row", "col").agg(F.max(value).alias(value))
    return map_groups(unique, ["frame_id"], [], run, "path string, content binary")


def merge_painted(points: DataFrame, painted: DataFrame, virtual: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Real points carry flag 1, rows overwritten by painted ones flag 0, virtual ones -1."""
    new = painted.select("frame_id", "point_id", *[c(n).alias("_" + n) for n in columns], F.lit(True).alias("_hit"))
    rows = points.join(new, ["frame_id", "point_id"], "left")
    out = rows.select("frame_id", "point_id", *[F.when(c("_hit"), c("_" + n)).otherwise(c(n)).alias(n) for n in columns],
                      F.when(c("_hit"), 0).otherwise(1).alias("flag"))
    if virtual is None:
        return out
    return out.unionByName(virtual.select("frame_id", "point_id", *columns, F.lit(-1).alias("flag")))


class PointCloudSource(DataSource):
    """``spark.read.format("pointcloud").option("path", folder)``: one task per group of files.

    Options: ``load_dim`` (5), ``use_dim`` (``0,1,2,3,4``), ``files_per_task`` (64).
    """

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def _use(self) -> list[int]:
        return [int(d) for d in self.options.get("use_dim", "0,1,2,3,4").split(",")]

    def schema(self) -> str:
        return "path string, point_id bigint, " + ", ".join(f"{POINT_NAMES[d]} float" for d in self._use())

    def reader(self, schema) -> DataSourceReader:
        return PointCloudReader(self.options, self._use())


class FileGroup(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths[0] if paths else None)
        self.paths = paths


class PointCloudReader(DataSourceReader):
    def __init__(self, options, use: list[int]):
        self.root = options["path"]
        self.load_dim = int(options.get("load_dim", "5"))
        self.per_task = int(options.get("files_per_task", "64"))
        self.use = use

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        files = sorted(str(p) for p in Path(self.root).rglob("*.bin"))
        return [FileGroup(files[i:i + self.per_task]) for i in range(0, len(files), self.per_task)]

    def read(self, partition: FileGroup):
        names = ["path", "point_id", *[POINT_NAMES[d] for d in self.use]]
        for path in partition.paths:
            with open(path, "rb") as f:
                m = _matrix(f.read(), self.load_dim, False)
            cols = [pa.array([path] * len(m), pa.string()), pa.array(np.arange(len(m), dtype=np.int64))]
            cols += [pa.array(np.ascontiguousarray(m[:, d])) for d in self.use]
            yield pa.RecordBatch.from_arrays(cols, names)
