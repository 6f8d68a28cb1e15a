"""Files, custom source and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.sources import arrays as ar
from voxelmill.sources import tables as st
from voxelmill.streaming import jobs as sj

c = F.col


@pytest.fixture
def clouds(tmp_path):
    data = {}
    for n in range(3):
        data[f"{n}.bin"] = np.arange(5 * (n + 1), dtype=np.float32).reshape(-1, 5) + n
        data[f"{n}.bin"].tofile(tmp_path / f"{n}.bin")
    return tmp_path, data


def test_point_files(spark, clouds):
    folder, data = clouds
    rows = ar.read_points(spark, str(folder), 5, (0, 3), ("x", "intensity")).toPandas()
    for name, want in data.items():
        got = rows[rows.path.str.endswith(name)].sort_values("point_id")
        assert np.allclose(got[["x", "intensity"]], want[:, [0, 3]])


def test_point_source(spark, clouds):
    folder, data = clouds
    spark.dataSource.register(ar.PointCloudSource)
    df = spark.read.format("pointcloud").option("path", str(folder)).option("use_dim", "0,2").option("files_per_task", "2").load()
    assert df.columns == ["path", "point_id", "x", "z"]
    assert df.count() == sum(len(d) for d in data.values())
    assert df.agg(F.sum("z").alias("s")).first().s == pytest.approx(sum(d[:, 2].sum() for d in data.values()))


def test_wrong_size_is_an_error(spark, tmp_path):
    np.zeros(7, dtype=np.float32).tofile(tmp_path / "x.bin")
    with pytest.raises(Exception, match="do not divide"):
        ar.read_points(spark, str(tmp_path)).collect()


def test_mask_files(spark, tmp_path):
    a = np.zeros((2, 4, 4), dtype=np.uint8)
    a[1, 2, 3] = 1
    np.save(tmp_path / "m.npy", a)
    row = ar.read_masks(spark, str(tmp_path)).collect()
    assert [(r.class_id, r.row, r.col, r.value) for r in row] == [(1, 2, 3, 1)]


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_clouds_of_many_frames_in_one_call(spark, tmp_path):
    """Groups cost a Python call each; frames also cross the borders of Arrow batches here."""
    points = spark.range(30_000).select((c("id") % 7).alias("frame_id"), F.floor(c("id") / 7).alias("point_id"), *[(c("id") % (k + 9)).cast("double").alias(n) for k, n in enumerate(ar.POINT_NAMES)])
    files = ar.encode_clouds(points, part=1000)
    assert "FlatMapGroupsInPandas" not in _plan(files)
    rows = ar.read_clouds(spark, ar.write_files(files, str(tmp_path / "clouds")), use_dim=(2,), names=("z",))
    assert sorted(rows.drop("path").collect()) == sorted(points.select("frame_id", "point_id", c("z").cast("float")).collect())


def test_rasters_of_many_frames_in_one_call(spark):
    cells = spark.range(30_000).select(F.floor(c("id") / 6).alias("frame_id"), F.lit(0).alias("class_id"), (c("id") % 2).alias("row"), (c("id") % 3).alias("col"), (c("id") % 250 + 1).alias("value"))
    files = ar.encode_rasters(cells, 2, 3)
    assert "FlatMapGroupsInPandas" not in _plan(files)
    back = ar.decode_masks(files, (2, 3)).select(c("path").cast("bigint").alias("frame_id"), "row", "col", "value")
    assert sorted(back.collect()) == sorted(cells.select("frame_id", "row", "col", "value").collect())


def test_packed_clouds_keep_ids_and_skip_frames(spark, tmp_path):
    points = spark.range(250).select((c("id") % 2).alias("frame_id"), F.floor(c("id") / 2).alias("point_id"), *[(c("id") * k).cast("double").alias(n) for k, n in enumerate(ar.POINT_NAMES)])
    folder = ar.write_files(ar.encode_clouds(points, part=50), str(tmp_path / "clouds"))
    assert spark.read.parquet(folder).count() == 6  # 125 points a frame in files of 50
    rows = ar.read_clouds(spark, folder, use_dim=(1, 3), names=("y", "intensity"))
    want = points.select("frame_id", "point_id", c("y").cast("float"), c("intensity").cast("float"))
    assert sorted(rows.drop("path").collect()) == sorted(want.collect())
    one = ar.read_clouds(spark, folder, where=(c("frame_id") == 1) & (c("first") == 100))
    assert {r.path for r in one.collect()} == {"1/100.bin"} and one.count() == 25
    assert "PushedFilters: [IsNotNull(frame_id)" in one._jdf.queryExecution().toString()


def test_another_shape_is_an_error(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.ones((2, 4, 4), dtype=np.uint8))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert ar.decode_masks(files, (2, 4, 4)).count() == 32
    with pytest.raises(Exception, match="expected shape"):
        ar.decode_masks(files, (2, 4, 5)).collect()


def test_calibration_files(spark, tmp_path):
    (tmp_path / "k.txt").write_text("10f\n10f\n3.5f\n3.5f\n")
    r = st.calibration_intrinsics(spark, str(tmp_path / "k.txt")).first()
    assert (r.fx, r.fy, r.cx, r.cy, r.fault) == (10.0, 10.0, 3.5, 3.5, None)
    (tmp_path / "t.txt").write_text("1 0 0 2\n0 1 0 3\n0 0 1 4\n")
    m = st.calibration_transforms(spark, str(tmp_path / "t.txt")).first()
    assert m.matrix[0][3] == 2.0 and m.matrix[3] == [0.0, 0.0, 0.0, 1.0]


def test_trajectory(spark, tmp_path):
    (tmp_path / "t.txt").write_text("3000000 1 2 3 0 0 0 2\n4000000 1 2\n5000000 0 0 0 0 0 0 0\n")
    rows = {r.raw_id: r for r in st.read_trajectory(spark, str(tmp_path / "t.txt")).collect()}
    assert rows[3].qw == 1.0 and rows[3].tx == 1.0 and rows[3].fault is None
    assert rows[5].fault == "zero quaternion" and rows[4].fault == "expected 8 columns"


def test_no_split_file_means_train(spark):
    good, bad = st.assign_splits(spark.createDataFrame([("a",), ("b",)], "scene_id string"), None)
    assert {r.split for r in good.collect()} == {"train"} and bad.count() == 0


def frames(spark, folder, rows):
    spark.createDataFrame(rows, "scene_id bigint, frame_id bigint, timestamp bigint, arrival bigint").coalesce(1).write.mode("append").json(str(folder))


def test_sequence_stream_restarts_from_its_checkpoint(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    frames(spark, src, [(1, 0, 10, 0), (1, 1, 20, 1), (2, 1, 10, 2)])
    schema = "scene_id bigint, frame_id bigint, timestamp bigint, arrival bigint"
    first = sj.run_available(sj.sequence_check(sj.stream_manifest(spark, str(src), schema)), str(out), "append")
    assert {(r.scene_id, r.frame_id): r.fault for r in first.collect()} == {(1, 0): "", (1, 1): "", (2, 1): "frame id is not next"}
    frames(spark, src, [(1, 2, 15, 3), (1, 2, 30, 4), (2, 0, 5, 5)])
    both = sj.run_available(sj.sequence_check(sj.stream_manifest(spark, str(src), schema)), str(out), "append")
    got = sorted((r.scene_id, r.frame_id, r.timestamp, r.fault) for r in both.collect())
    assert (1, 2, 15, "timestamp is not later") in got and (1, 2, 30, "") in got and (2, 0, 5, "") in got
    assert len(got) == 6


def test_sweep_stream_keeps_last_frames(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "scene_id bigint, frame_id bigint, timestamp bigint, arrival bigint"
    frames(spark, src, [(1, k, k, k) for k in range(3)])
    sj.run_available(sj.sweep_buffer(sj.stream_manifest(spark, str(src), schema), 2), str(out), "append")
    frames(spark, src, [(1, 3, 3, 3)])
    rows = sj.run_available(sj.sweep_buffer(sj.stream_manifest(spark, str(src), schema), 2), str(out), "append").collect()
    assert {(r.rank, r.source_frame) for r in rows if r.frame_id == 3} == {(0, 2), (1, 1)}


def test_early_stop_example(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rows = [("r", 1, 0.10), ("r", 2, 0.12), ("r", 3, None), ("r", 4, 0.119), ("r", 5, 0.118), ("r", 6, 0.5)]
    spark.createDataFrame(rows, "run string, epoch bigint, value double").write.json(str(src))
    stream = spark.readStream.schema("run string, epoch bigint, value double").json(str(src))
    got = {r.epoch: r for r in sj.run_available(sj.early_stop(stream, 2, 0.001), str(out), "append").collect()}
    assert got[5].stop and got[5].best == 0.12 and got[5].best_epoch == 2 and 3 not in got and 6 not in got


def test_sweep_buffer_makes_one_table_for_a_scene():
    import pandas as pd

    class Frames:
        def groupBy(self, *keys):
            return self

        def applyInPandasWithState(self, step, *rest):
            return step

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    step, state = sj.sweep_buffer(Frames(), 2), State()
    first, second = ([pd.DataFrame({"scene_id": 5, "frame_id": ids})] for ids in ([2, 0, 1], [4, 3]))
    (links,) = step((5,), iter(first), state)
    assert sorted(zip(links.frame_id, links["rank"], links.source_frame)) == [(1, 0, 0), (2, 0, 1), (2, 1, 0)]
    (links,) = step((5,), iter(second), state)
    assert sorted(zip(links.frame_id, links["rank"], links.source_frame)) == [(3, 0, 2), (3, 1, 1), (4, 0, 3), (4, 1, 2)]
    assert state.get == ([3, 4],)


def test_voxel_point_sample_reads_its_points_once(spark):
    from voxelmill.operators import sampling as sm
    from voxelmill.operators import voxels as vx

    rows = spark.range(40).selectExpr("id div 20 AS frame_id", "id % 20 AS point_id", "cast(id % 7 AS double) AS x", "cast(id % 5 AS double) AS y",
                                      "0.0D AS z", "cast(id % 2 AS double) AS time")
    out = sm.voxel_point_sample(rows, vx.VoxelGrid((0.0, -51.2, -5.0, 51.2, 51.2, 3.0), (5.12, 5.12, 8.0)), 2, 4, 1)
    assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.groupBy("part", "frame_id").agg(F.countDistinct("voxel_id").alias("n")).where("n <> 4").isEmpty()
