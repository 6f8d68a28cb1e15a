"""Structured Streaming jobs over an append-only frame stream.

Late frames (an id that is not next, a timestamp that is not later) go to the rejects.
State per scene is small: the last frame and the last N poses. A micro-batch is bounded by
the source's rate option (``maxFilesPerTrigger``), which also bounds the rows of one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

c = F.col


def stream_manifest(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """JSON Lines manifests as a stream; the checkpoint remembers the files already read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def _all(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")


def sequence_check(frames: DataFrame) -> DataFrame:
    """Accepted frames and rejects per scene: ids must count from 0, timestamps must grow."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_id, last_ts = state.get if state.exists else (-1, -(1 << 62))
        out = []
        for row in _all(batches, ["arrival"]).itertuples(index=False):
            fault = ""
            if row.frame_id != last_id + 1:
                fault = "frame id is not next"
            elif row.timestamp <= last_ts:
                fault = "timestamp is not later"
            else:
                last_id, last_ts = int(row.frame_id), int(row.timestamp)
            out.append((key[0], int(row.frame_id), int(row.timestamp), fault))
        state.update((last_id, last_ts))
        yield pd.DataFrame(out, columns=["scene_id", "frame_id", "timestamp", "fault"])

    return frames.groupBy("scene_id").applyInPandasWithState(
        step, "scene_id bigint, frame_id bigint, timestamp bigint, fault string", "last_id bigint, last_ts bigint",
        "append", GroupStateTimeout.NoTimeout)


def sweep_buffer(frames: DataFrame, sweeps: int, pose: tuple[str, str, str] | None = None) -> DataFrame:
    """Links of each new frame to the last ``sweeps`` frames of its scene, newest first.

    With the columns of a pose (x, y, yaw) each link also holds the pose of the older frame as the
    new one sees it: ``dx``, ``dy`` and ``dyaw``. The state is the ids and poses of the last
    ``sweeps`` frames. Frames of a batch are taken by id.
    """
    kept = ["frame_id", *(pose or ())]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Scenes are many and short: a table made and sorted for each takes longer than its rows.
        parts = list(batches)
        new = [np.concatenate([part[k].to_numpy() for part in parts]) for k in kept]
        order = np.argsort(new[0], kind="stable")
        old = state.get if state.exists else [[]] * len(kept)
        rows = [np.concatenate([np.asarray(o, n.dtype), n[order]]) for o, n in zip(old, new)]
        known, size = len(old[0]), len(rows[0])
        here = [np.arange(min(max(known, back), size), size) for back in range(1, sweeps + 1)]
        back = np.repeat(np.arange(1, sweeps + 1), [len(h) for h in here])
        here = np.concatenate(here)
        there = here - back
        out = {"scene_id": key[0], "frame_id": rows[0][here], "rank": (back - 1).astype("int32"), "source_frame": rows[0][there]}
        if pose:
            x, y, yaw = (values[there] - values[here] for values in rows[1:])
            cos, sin = np.cos(rows[3])[here], np.sin(rows[3])[here]
            out |= {"dx": cos * x + sin * y, "dy": cos * y - sin * x, "dyaw": yaw}
        state.update(tuple(values[-sweeps:].tolist() for values in rows))
        if len(here):
            yield pd.DataFrame(out)

    links = "scene_id bigint, frame_id bigint, rank int, source_frame bigint"
    poses = "".join(f", {p} array<double>" for p in pose or ())
    return frames.groupBy("scene_id").applyInPandasWithState(
        step, links + (", dx double, dy double, dyaw double" if pose else ""), "frame_id array<bigint>" + poses,
        "append", GroupStateTimeout.NoTimeout)


def early_stop(epochs: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """Best value, stale count and stop flag after every epoch of a run; missing values are
    ignored and the checkpoint replaces the state file."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, best_epoch, stale, stopped = state.get if state.exists else (None, -1, 0, False)
        out = []
        for row in _all(batches, ["epoch"]).itertuples(index=False):
            if stopped or pd.isna(row.value):
                continue
            if best is None or row.value > best + min_delta:
                best, best_epoch, stale = float(row.value), int(row.epoch), 0
            else:
                stale += 1
            stopped = stale >= patience
            out.append((key[0], int(row.epoch), best, best_epoch, stale, stopped))
        state.update((best, best_epoch, stale, stopped))
        yield pd.DataFrame(out, columns=["run", "epoch", "best", "best_epoch", "stale", "stop"])

    return epochs.groupBy("run").applyInPandasWithState(
        step, "run string, epoch bigint, best double, best_epoch bigint, stale int, stop boolean",
        "best double, best_epoch bigint, stale int, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def dedup_tokens(frames: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of every token within the watermark."""
    return frames.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["token"])


def scene_summary(frames: DataFrame) -> DataFrame:
    """Running counts, bounds and sums per scene (update or complete mode)."""
    return frames.groupBy("scene_id").agg(
        F.count("*").alias("frames"), F.min("points").alias("min_points"), F.max("points").alias("max_points"),
        F.sum("points").alias("points"))


def map_metrics(cells: DataFrame, thresholds) -> DataFrame:
    """Running confusion counts per class; scores are derived when the table is read."""
    label, score = c("label") == 1, c("score").cast("float")
    aggs = []
    for i, t in enumerate(thresholds):
        hit = score >= F.lit(t).cast("float")
        aggs += [F.sum((hit & label).cast("bigint")).alias(f"tp{i}"), F.sum((hit & ~label).cast("bigint")).alias(f"fp{i}"),
                 F.sum((~hit & label).cast("bigint")).alias(f"fn{i}")]
    return cells.groupBy("class_id").agg(*aggs)


def throughput(samples: DataFrame, ts: str, width: str, delay: str = "1 hour") -> DataFrame:
    """Samples and rate per tumbling window."""
    win = samples.withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(F.count("*").alias("samples"), F.sum("value").alias("value"))
    seconds = (c("window.end").cast("double") - c("window.start").cast("double"))
    return win.select(c("window.start").alias("start"), "samples", "value", (c("samples") / seconds).alias("per_second"))


def run_available(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Process everything available now and return what the stream wrote.

    ``append`` keeps all batches; ``complete`` keeps the last one. Each batch overwrites its
    own folder, so a repeated batch writes the same rows again.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        target = f"{folder}/data/batch={number}" if mode == "append" else f"{folder}/data"
        batch.write.mode("overwrite").parquet(target)

    query = (stream.writeStream.outputMode(mode).foreachBatch(save)
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/data")
    return out.select(*stream.columns)
