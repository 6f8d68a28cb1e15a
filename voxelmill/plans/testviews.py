"""Domain tables derived from the driver's parquet tables.

Frames are runs of neighbouring keys, so a frame keeps about 256 points and 8 boxes at
every scale and the number of frames grows with the data. ``SQL_VIEWS`` holds the same
definitions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.skew import with_row_number

c = F.col

SQL_VIEWS = {
    "rawpoints": """
SELECT l_orderkey // 64 AS frame_id, l_quantity AS x, l_extendedprice / 1000.0::DOUBLE - 50.0::DOUBLE AS y,
  l_discount * 50.0::DOUBLE - 2.5::DOUBLE AS z, l_tax * 10.0::DOUBLE AS intensity,
  CASE WHEN l_linestatus = 'O' THEN 0.0::DOUBLE ELSE 0.1::DOUBLE * l_linenumber END AS time,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus
FROM lineitem""",
    "points": """
SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y) - 1 AS BIGINT) AS point_id,
  x, y, z, intensity, time,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS semantic_id
FROM rawpoints""",
    "boxes": """
SELECT p_partkey // 8 AS frame_id, p_partkey % 8 AS box_id, CAST(p_size AS DOUBLE) AS x,
  CAST((p_partkey % 97) - 48 AS DOUBLE) AS y, -2.0::DOUBLE AS z, 4.0::DOUBLE AS dx,
  CAST(2 + p_size % 3 AS DOUBLE) AS dy, 3.0::DOUBLE AS dz, (p_partkey % 16) * pi() / 8.0::DOUBLE AS yaw,
  CAST(p_partkey % 7 - 3 AS DOUBLE) AS vx, CAST(p_partkey % 5 - 2 AS DOUBLE) AS vy,
  p_type AS name, CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS score
FROM part""",
    "detections": """
SELECT frame_id, box_id * 4 + k AS det_id, x + 0.5::DOUBLE * k AS x, y - 0.25::DOUBLE * k AS y, z + 0.125::DOUBLE * k AS z,
  dx, dy, dz, yaw, vx, vy, name,
  CAST(((frame_id * 8 + box_id) * 7919 + k * 4999) % 100003 AS DOUBLE) / 100003.0::DOUBLE AS score
FROM boxes CROSS JOIN (SELECT unnest([0, 1, 2, 3])::BIGINT AS k)""",
    "frames": """
SELECT user_id AS scene_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_id,
  epoch_us(ts) AS timestamp, event_id, event_type, value
FROM events""",
    "poses": """
SELECT scene_id, frame_id, timestamp, value / 100.0::DOUBLE AS tx, CAST(event_id % 1000 AS DOUBLE) * 0.1::DOUBLE AS ty,
  radians(CAST(event_id % 360 AS DOUBLE)) AS yaw
FROM frames""",
    "records": """
SELECT user_id AS scene_id, event_type AS channel, event_id AS record_id, epoch_us(ts) AS timestamp,
  value / 100.0::DOUBLE AS tx, CAST(event_id % 1000 AS DOUBLE) * 0.1::DOUBLE AS ty,
  radians(CAST(event_id % 360 AS DOUBLE)) AS yaw
FROM events""",
    "map_cells": """
SELECT frame_id, class_id, row, col, label, score, supervised, observed FROM (
  SELECT frame_id, class_id, row, col, label, CAST((frame_id * 31 + row * 17 + col * 7 + class_id * 13) % 100 AS DOUBLE) / 100.0::DOUBLE AS score,
    CASE WHEN (row + col) % 5 <> 0 THEN 1 ELSE 0 END AS supervised, CASE WHEN (row + 2 * col) % 7 <> 0 THEN 1 ELSE 0 END AS observed
  FROM (SELECT frame_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id,
      CAST(floor(x / 2.0) AS BIGINT) AS row, CAST(floor((y + 50.0) / 2.0) AS BIGINT) AS col,
      max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS label
    FROM rawpoints GROUP BY ALL))""",
    "pixels": """
SELECT l_orderkey // 64 AS frame_id, l_suppkey % 48 AS v, l_partkey % 64 AS u,
  CAST(min(floor(l_extendedprice / 10.0)) AS BIGINT) AS depth_mm, CAST(min(l_quantity) AS BIGINT) % 6 AS semantic_id
FROM lineitem GROUP BY ALL""",
    "epochs": """
SELECT epoch, metric, avg(value) / 1000.0::DOUBLE AS value FROM (
  SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS epoch, event_type AS metric, value FROM events)
GROUP BY ALL""",
}


class Views:
    """Lazy domain tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rawpoints(self) -> DataFrame:
        """Points without an arrival id; enough for filters and commutative aggregates."""
        return self.table("lineitem").select(
            F.expr("l_orderkey div 64").alias("frame_id"),
            c("l_quantity").alias("x"),
            (c("l_extendedprice") / 1000.0 - 50.0).alias("y"),
            (c("l_discount") * 50.0 - 2.5).alias("z"),
            (c("l_tax") * 10.0).alias("intensity"),
            F.when(c("l_linestatus") == "O", 0.0).otherwise(0.1 * c("l_linenumber")).alias("time"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        )

    def points(self) -> DataFrame:
        """Points with their arrival position inside the frame; slices are single order keys
        and ranges of eight lines, so a frame of any size is numbered by many tasks and slices are fewer than points."""
        raw = self.rawpoints()
        order_slice = (c("l_orderkey") % 64) * (1 << 32) + F.expr("l_linenumber div 8")
        order = [c(k) for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y")]
        return with_row_number(raw, ["frame_id"], order, order_slice, "rn").select(
            "frame_id", (c("rn") - 1).alias("point_id"), "x", "y", "z", "intensity", "time",
            F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
            .alias("semantic_id"),
        )

    def boxes(self) -> DataFrame:
        key = c("p_partkey")
        return self.table("part").select(
            F.expr("p_partkey div 8").alias("frame_id"), (key % 8).alias("box_id"),
            c("p_size").cast("double").alias("x"), ((key % 97) - 48).cast("double").alias("y"),
            F.lit(-2.0).alias("z"), F.lit(4.0).alias("dx"),
            (2 + c("p_size") % 3).cast("double").alias("dy"), F.lit(3.0).alias("dz"),
            ((key % 16) * F.pi() / 8.0).alias("yaw"),
            (key % 7 - 3).cast("double").alias("vx"), (key % 5 - 2).cast("double").alias("vy"),
            c("p_type").alias("name"), (((key * 7919) % 1000).cast("double") / 1000.0).alias("score"),
        )

    def detections(self) -> DataFrame:
        """Four shifted copies of every box with mixed scores."""
        k = c("k")
        return self.boxes().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
            "frame_id", (c("box_id") * 4 + k).alias("det_id"),
            (c("x") + 0.5 * k).alias("x"), (c("y") - 0.25 * k).alias("y"), (c("z") + 0.125 * k).alias("z"),
            "dx", "dy", "dz", "yaw", "vx", "vy", "name",
            ((((c("frame_id") * 8 + c("box_id")) * 7919 + k * 4999) % 100003).cast("double") / 100003.0)
            .alias("score"),
        )

    def events(self) -> DataFrame:
        """Events with integer microseconds, read off the wall clock without a time zone."""
        return self.table("events").withColumn("timestamp", F.expr(
            "unix_date(cast(ts AS date)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L"
            " + cast(extract(SECOND FROM ts) * 1000000 AS bigint)"))

    def frames(self) -> DataFrame:
        """Frames of a scene in time order, numbered from zero."""
        hour = F.expr("timestamp div 3600000000")
        numbered = with_row_number(self.events(), ["user_id"], [c("timestamp"), c("event_id")], hour, "rn")
        return numbered.select(c("user_id").alias("scene_id"), (c("rn") - 1).alias("frame_id"),
                               "timestamp", "event_id", "event_type", "value")

    @staticmethod
    def _pose_columns():
        return [(c("value") / 100.0).alias("tx"), ((c("event_id") % 1000).cast("double") * 0.1).alias("ty"),
                F.radians((c("event_id") % 360).cast("double")).alias("yaw")]

    def poses(self) -> DataFrame:
        return self.frames().select("scene_id", "frame_id", "timestamp", *self._pose_columns())

    def records(self) -> DataFrame:
        """Sensor records: one channel per event type, one pose per record."""
        return self.events().select(
            c("user_id").alias("scene_id"), c("event_type").alias("channel"),
            c("event_id").alias("record_id"), "timestamp", *self._pose_columns())

    def map_cells(self) -> DataFrame:
        """Grid cells with a truth label, a prediction score and two masks."""
        cells = self.rawpoints().groupBy(
            "frame_id",
            F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2).alias("class_id"),
            F.floor(c("x") / 2.0).alias("row"), F.floor((c("y") + 50.0) / 2.0).alias("col"),
        ).agg(F.max(F.when(c("l_linestatus") == "O", 1).otherwise(0)).alias("label"))
        mix = c("frame_id") * 31 + c("row") * 17 + c("col") * 7 + c("class_id") * 13
        return cells.select(
            "frame_id", "class_id", "row", "col", "label",
            ((mix % 100).cast("double") / 100.0).alias("score"),
            F.when((c("row") + c("col")) % 5 != 0, 1).otherwise(0).alias("supervised"),
            F.when((c("row") + 2 * c("col")) % 7 != 0, 1).otherwise(0).alias("observed"))

    def pixels(self) -> DataFrame:
        """Depth and semantic rasters: nearest depth and lowest label of a pixel."""
        return self.table("lineitem").groupBy(
            F.expr("l_orderkey div 64").alias("frame_id"), (c("l_suppkey") % 48).alias("v"),
            (c("l_partkey") % 64).alias("u"),
        ).agg(F.min(F.floor(c("l_extendedprice") / 10.0)).alias("depth_mm"),
              (F.min("l_quantity").cast("bigint") % 6).alias("semantic_id"))

    def epochs(self) -> DataFrame:
        day = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("bigint")
        return (self.table("events").groupBy(day.alias("epoch"), c("event_type").alias("metric"))
                .agg((F.avg("value") / 1000.0).alias("value")))
