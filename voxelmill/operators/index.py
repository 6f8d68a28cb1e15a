"""Frame index: record joins, sweep chains, relative poses, splits, annotation tables.

Chains of earlier records are equi joins on ``(chain, position - k)`` with a small fixed
``k``, so a chain of any length spreads over all tasks. No self-join ever pairs all
records of a scene.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions import linalg as la
from voxelmill.skew import with_lag, with_row_number, with_running

c = F.col
HOUR_US = 3_600_000_000


def hour_slice(col: str = "timestamp") -> Column:
    return F.expr(f"{col} div {HOUR_US}")


def number_chain(records: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """Position of each record in its chain, from 1, in time order."""
    return with_row_number(records, keys, [c(o) for o in order], hour_slice(order[0]), out)


def earlier_records(numbered: DataFrame, keys: Sequence[str], payload: Sequence[str], count: int,
                    include_current: bool = False, repeat_last: bool = False, pos: str = "pos") -> DataFrame:
    """Up to ``count`` records before each record (newest first) as rows with ``rank`` from 0.

    ``repeat_last`` fills a short chain with its oldest record, as radar chains do.
    Payload columns of the earlier record get the prefix ``s_``.
    """
    first = 0 if include_current else 1
    keys = list(keys)
    wanted = numbered.withColumn(
        "rank", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    target = c(pos) - c("rank") - first
    if repeat_last:
        target = F.greatest(target, F.lit(1))
    wanted = wanted.withColumn("_at", target.cast("bigint"))
    source = numbered.select(*keys, c(pos).alias("_at"), *[c(p).alias("s_" + p) for p in payload])
    return wanted.join(source, keys + ["_at"]).drop("_at")


def relative_planar(df: DataFrame) -> DataFrame:
    """Pose of the earlier record (``s_tx, s_ty, s_yaw``) seen from the current one."""
    rel = la.relative_pose(la.yaw_pose(c("tx"), c("ty"), c("yaw")),
                           la.yaw_pose(c("s_tx"), c("s_ty"), c("s_yaw")))
    return df.withColumns({"rel_x": rel[0][3], "rel_y": rel[1][3], "rel_cos": rel[0][0], "rel_sin": rel[1][0]})


def star_join(records: DataFrame, *dims: tuple[DataFrame, Column | str | list[str]]) -> DataFrame:
    """Join records to their dimension tables; Spark broadcasts a side only after measuring it."""
    for dim, on in dims:
        records = records.join(dim, on)
    return records


def previous_index(indexed: DataFrame) -> DataFrame:
    """Position of the previous frame in its split, -1 for the first; ``split_ok`` is false
    when the previous frame sits in another split."""
    prev = indexed.select(c("token").alias("prev_token"), c("idx").alias("prev_idx"), c("split").alias("prev_split"))
    return (indexed.join(prev, "prev_token", "left")
            .withColumn("prev", F.coalesce("prev_idx", F.lit(-1).cast("bigint")))
            .withColumn("split_ok", F.coalesce(c("prev_split") == c("split"), F.lit(True)))
            .drop("prev_idx", "prev_split"))


def with_prev_token(frames: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Token of the previous frame of the scene, empty for the first."""
    return (with_lag(frames, keys, ["timestamp", "frame_id"], hour_slice(), {"prev_token": "token"})
            .withColumn("prev_token", F.coalesce("prev_token", F.lit(""))))


def periodic_split(position: Column, cycle: int = 9, ratios: Sequence[int] = (7, 1, 1)) -> Column:
    """train / val / test by position modulo the cycle."""
    slot = (position % cycle) + 1
    return (F.when(slot <= ratios[0], "train").when(slot <= ratios[0] + ratios[1], "val").otherwise("test"))


def block_split(position: Column, total: Column, ratios: Sequence[int] = (7, 1, 1)) -> Column:
    """train / val / test as three consecutive blocks of a sequence."""
    whole = sum(ratios)
    first = F.floor(total * ratios[0] / whole)
    second = F.floor(total * (ratios[0] + ratios[1]) / whole)
    return F.when(position < first, "train").when(position < second, "val").otherwise("test")


def annotation_table(objects: DataFrame, classes: Sequence[str], use_valid_flag: bool) -> DataFrame:
    """Usable objects with class number (-1 for unknown names) and NaN velocity as zero."""
    table = F.create_map(*[t for i, n in enumerate(classes) for t in (F.lit(n), F.lit(i))])
    keep = c("valid_flag") if use_valid_flag else c("num_lidar_pts") > 0
    return objects.where(keep).withColumns({
        "label": F.coalesce(table[c("name")], F.lit(-1)),
        "vx": F.nanvl(c("vx"), F.lit(0.0)), "vy": F.nanvl(c("vy"), F.lit(0.0))})


def sweep_points(points: DataFrame, sweeps: DataFrame, key_points: DataFrame, close: float) -> DataFrame:
    """Keyframe points (time 0) plus the points of each chosen sweep moved to the key frame.

    ``sweeps`` has one row per (frame, source_frame) with ``rel_x, rel_y, rel_cos, rel_sin``
    and ``lag`` in seconds; the close-range square is tested in the sweep's own axes.
    """
    near = (F.abs("x") < close) & (F.abs("y") < close)
    source = points.where(~near).withColumnRenamed("frame_id", "source_frame")
    moved = source.join(sweeps, "source_frame").select(
        "frame_id", "point_id", "source_frame",
        (c("x") * c("rel_cos") - c("y") * c("rel_sin") + c("rel_x")).alias("x"),
        (c("x") * c("rel_sin") + c("y") * c("rel_cos") + c("rel_y")).alias("y"),
        "z", c("lag").alias("time"))
    return moved.unionByName(key_points.select(
        "frame_id", "point_id", c("frame_id").alias("source_frame"), "x", "y", "z", F.lit(0.0).alias("time")))


def even_subsample(points: DataFrame, at_most: int) -> DataFrame:
    """At most ``at_most`` rows per frame at evenly spaced positions, both ends included."""
    counts = points.groupBy("frame_id").agg(F.count("*").alias("_n"))
    gaps = c("_n") - 1
    nth = F.ceil(c("point_id") * (at_most - 1) / gaps)
    hit = F.floor(nth * gaps / F.lit(at_most - 1)) == c("point_id")
    return points.join(counts, "frame_id").where((c("_n") <= at_most) | hit).drop("_n")


def nearest_records(records: DataFrame, keys: Sequence[str], target: Column, sensor: Column, cols: Sequence[str]) -> DataFrame:
    """As-of join of two record streams: every row of ``target`` with the ``sensor`` row of its key that is nearest
    in time, its columns named ``s_``; of two equally near ones the earlier, and of records of one time the
    one next to the target in the order of (timestamp, id).

    Both streams run through one ordered pass in each direction that carries the last sensor row, in slices of
    an hour, so that a long key is no single task. Targets of keys without a sensor row are dropped.
    """
    rest = [n for n in cols if n not in ("timestamp", "record_id")]
    packed = F.when(sensor, F.struct("timestamp", "record_id", *rest))
    back = F.when(sensor, F.struct((-c("timestamp")).alias("_nt"), (-c("record_id")).alias("_nr"), *rest))
    both = records.where(target | sensor).withColumns({"_before": packed, "_after": back, "_nt": -c("timestamp"), "_nr": -c("record_id")})
    seen = with_running(both, keys, ["timestamp", "record_id"], F.floor(c("timestamp") / HOUR_US), {"_last": ("max", "_before")})
    seen = with_running(seen, keys, ["_nt", "_nr"], F.floor(c("_nt") / HOUR_US), {"_next": ("max", "_after")})
    late = (-c("_next._nt")) - c("timestamp")
    early = c("timestamp") - c("_last.timestamp")
    use_last = c("_next").isNull() | (early <= late)
    found = {"s_timestamp": F.when(use_last, c("_last.timestamp")).otherwise(-c("_next._nt")), "s_record_id": F.when(use_last, c("_last.record_id")).otherwise(-c("_next._nr"))}
    found |= {f"s_{n}": F.when(use_last, c(f"_last.{n}")).otherwise(c(f"_next.{n}")) for n in rest}
    matched = seen.where(target & (c("_last").isNotNull() | c("_next").isNotNull()))
    return matched.withColumns(found).drop("_before", "_after", "_last", "_next", "_nt", "_nr")


def sensor_to_lidar(pairs: DataFrame, mounts: dict[str, Sequence[float]], lidar: str, out: str = "pose") -> DataFrame:
    """Pose of a sensor in the LiDAR's frame: sensor to its ego, to the world, to the ego at the LiDAR's time, to
    the LiDAR. ``mounts``: for each channel x, y, z, roll, pitch, yaw on the vehicle; ego poses are the columns
    ``tx ty tz roll pitch yaw``, those of the sensor's time with ``s_``. Channels without a mount give null."""
    def mount(channel: Column) -> list[Column]:
        return [F.coalesce(*[F.when(channel == name, F.lit(float(m[i]))) for name, m in mounts.items()]) for i in range(6)]

    def ego(prefix: str) -> la.Mat:
        return la.euler_pose([c(prefix + n) for n in ("tx", "ty", "tz")], *[c(prefix + n) for n in ("roll", "pitch", "yaw")])

    on = mount(c("s_channel"))
    at = [F.lit(float(x)) for x in mounts[lidar]]
    return la.with_chain(pairs, [
        la.rigid_inverse(la.euler_pose(at[:3], *at[3:])), la.rigid_inverse(ego("")), ego("s_"), la.euler_pose(on[:3], *on[3:])], out)
