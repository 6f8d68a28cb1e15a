"""Queries: sources, sinks and streams. Folders live below the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import linalg as la
from voxelmill.operators import points as pt
from voxelmill.operators import sampling as sm
from voxelmill.operators import topk as tk
from voxelmill.plans.q_quality import MANIFEST, manifest
from voxelmill.plans.q_index import tokens
from voxelmill.plans.q_points import K, _band_sql
from voxelmill.plans.q_raster import COLS, REPROJECT_SQL, ROWS
from voxelmill.plans.registry import query, r6, rd
from voxelmill.schemas import METRIC_THRESHOLDS
from voxelmill.session import scratch_folder
from voxelmill.sources import arrays as ar
from voxelmill.sources import sinks as sk
from voxelmill.sources import tables as st
from voxelmill.streaming import jobs as sj

c = F.col


def f4(e):
    return r6(f"CAST({e} AS FLOAT)", 3)


COLOURED = (*ar.POINT_NAMES, "red", "green", "blue")
COLOUR = {"red": "point_id % 251", "green": "point_id * 7 % 253", "blue": "point_id * 13 % 255"}
USED = {0: "x", 1: "y", 2: "z", 3: "intensity", 5: "red", 6: "green", 7: "blue"}


@query("read_points", f"""WITH stored AS (SELECT frame_id, point_id, {", ".join(f"CAST(CAST({k} AS FLOAT) AS DOUBLE) AS {k}" for k in ("x", "y", "z", "intensity"))}, {", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in COLOUR.items())} FROM points),
thinned AS (SELECT * FROM (SELECT *, asin(z / sqrt(x * x + y * y + z * z)) AS t FROM stored) WHERE {_band_sql(16)}),
floors AS (SELECT frame_id, quantile_cont(z, 0.0099) AS floor_z FROM thinned GROUP BY 1)
SELECT concat(frame_id, '/', point_id - point_id % {ar.PART}, '.bin') AS path, point_id, {", ".join(f"{r6(k, 3)} AS {k}" for k in USED.values())}, {r6('z - floor_z', 3)} AS height FROM thinned JOIN floors USING (frame_id)""")
def _(v):
    points = v.points().select("frame_id", "point_id", *ar.POINT_NAMES, *[F.expr(e).alias(k) for k, e in COLOUR.items()])
    folder = ar.write_files(ar.encode_clouds(points, COLOURED), scratch_folder(v.spark, "clouds"))
    rows = ar.read_clouds(v.spark, folder, len(COLOURED), tuple(USED), tuple(USED.values()))
    rows = rows.select("path", "frame_id", "point_id", *[c(k).cast("double").alias(k) for k in USED.values()])
    rows = sm.shift_height(pt.reduce_beams(rows, 16))
    return rows.select("path", "point_id", *[rd(k, 3).alias(k) for k in (*USED.values(), "height")])


@query("read_bev_masks", """SELECT CAST(frame_id AS VARCHAR) AS path, CAST(class_id AS BIGINT) AS class_id, row, col, CAST(CASE WHEN observed = 1 THEN 1 ELSE 0 END AS INTEGER) AS observed FROM map_cells WHERE label = 1""")
def _(v):
    cells = v.map_cells().withColumn("value", F.lit(1))
    layers = {}
    for name, chosen in (("label", cells.where(c("label") == 1)), ("observed", cells.where(c("observed") == 1))):
        files = ar.encode_rasters(chosen, ROWS, COLS, 3)
        folder = ar.write_files(files, scratch_folder(v.spark, f"masks-{name}"))
        layers[name] = ar.decode_masks(v.spark.read.parquet(folder), (3, ROWS, COLS)).drop("value")
    keys = ["path", "class_id", "row", "col"]
    seen = layers["observed"].withColumn("seen", F.lit(1))
    return layers["label"].join(seen, keys, "left").select(*keys, F.coalesce("seen", F.lit(0)).alias("observed"))


@query("read_depth_semantic", "SELECT CAST(frame_id AS VARCHAR) AS path, v AS row, u AS col, depth_mm, semantic_id FROM pixels WHERE depth_mm > 0")
def _(v):
    px = v.pixels().select("frame_id", F.lit(0).alias("class_id"), c("v").alias("row"), c("u").alias("col"), "depth_mm", "semantic_id")
    layers = {}
    for name, kind in (("depth_mm", "uint16"), ("semantic_id", "uint8")):
        folder = ar.write_files(ar.encode_rasters(px, 48, 64, 1, name, kind), scratch_folder(v.spark, f"pixels-{name}"))
        layers[name] = ar.decode_masks(v.spark.read.parquet(folder), (48, 64)).withColumnRenamed("value", name)
    keys = ["path", "row", "col"]
    meaning = layers["semantic_id"].select(*keys, "semantic_id")
    # class 0 is stored as 0, which has no row of its own
    return layers["depth_mm"].join(meaning, keys, "left").select(*keys, "depth_mm", F.coalesce("semantic_id", F.lit(0)).alias("semantic_id"))


@query("read_augmented_points", f"""SELECT frame_id, point_id, {r6("CASE WHEN point_id % 7 = 0 THEN intensity + 1 ELSE intensity END")} AS intensity, CAST(CASE WHEN point_id % 7 = 0 THEN 0 ELSE 1 END AS INTEGER) AS flag FROM points
UNION ALL SELECT frame_id, 1000000 + box_id, {r6('score')}, -1 FROM boxes""")
def _(v):
    pts = v.points().select("frame_id", "point_id", "intensity")
    painted = pts.where(c("point_id") % 7 == 0).withColumn("intensity", c("intensity") + 1)
    virtual = v.boxes().select("frame_id", (c("box_id") + 1000000).alias("point_id"), c("score").alias("intensity"))
    return ar.merge_painted(pts, painted, virtual, ["intensity"]).withColumn("intensity", rd("intensity"))


@query("read_trajectory", f"""SELECT CAST(event_id AS BIGINT) AS raw_id, {r6('-(cos(yaw) * tx + sin(yaw) * ty)', 4)} AS tx, {r6('sin(yaw) * tx - cos(yaw) * ty', 4)} AS ty, {r6('-sin(yaw / 2)', 4)} AS qz, {r6('cos(yaw / 2)', 4)} AS qw
FROM (SELECT event_id, value / 100.0 AS tx, (event_id % 1000) * 0.1 AS ty, radians(event_id % 360) AS yaw FROM events)""")
def _(v):
    yaw = F.radians(c("event_id") % 360)
    parts = [c("event_id") * 1000000, c("value") / 100.0, (c("event_id") % 1000) * 0.1, F.lit(0), F.lit(0), F.lit(0), F.sin(yaw / 2) * 2, F.cos(yaw / 2) * 2]
    lines = v.table("events").select(F.concat_ws("  ", *[p.cast("string") for p in parts]).alias("value"))
    rows = st.parse_trajectory(lines, invert=True).where(c("fault").isNull())
    return rows.select("raw_id", *[rd(k, 4).alias(k) for k in ("tx", "ty", "qz", "qw")])


@query("calibration_intrinsics", """SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'expected 4 numbers' WHEN s_suppkey % 7 = 0 THEN 'focal length is not positive' END AS fault,
CASE WHEN s_suppkey % 7 = 0 THEN -500.5 ELSE 500.5 + s_suppkey END AS fx FROM supplier""")
def _(v):
    fx = F.when(c("s_suppkey") % 7 == 0, F.lit(-500.5)).otherwise(c("s_suppkey") + 500.5)
    tail = F.when(c("s_suppkey") % 5 == 0, "").otherwise("239.5f")
    text = F.concat(fx.cast("string"), F.lit("f\n500.0f\n319.5f\n"), tail)
    files = v.table("supplier").select(c("s_suppkey").cast("string").alias("path"), text.alias("value"))
    return st.parse_intrinsics(files).select("path", "fault", "fx")


@query("calibration_transforms", """SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'expected 12 or 16 numbers' WHEN s_suppkey % 7 = 0 THEN 'not finite' END AS fault,
CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS DOUBLE) ELSE -1.0 END AS tx FROM supplier""")
def _(v):
    tx = F.when(c("s_suppkey") % 7 == 0, "nan").otherwise(c("s_suppkey").cast("string"))
    text = F.concat(F.lit("1 0 0 "), tx, F.lit("\n0 1 0 2\n0 0 1 3\n"), F.when(c("s_suppkey") % 5 == 0, "9").otherwise(""))
    files = v.table("supplier").select(c("s_suppkey").cast("string").alias("path"), text.alias("value"))
    return st.parse_transform(files).select("path", "fault", F.coalesce(c("matrix")[0][3], F.lit(-1.0)).alias("tx"))


@query("read_splits", "SELECT r_name AS split, n_name AS scene_id FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(v):
    joined = v.table("nation").join(v.table("region").select(c("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    folder = scratch_folder(v.spark, "splits")
    # the split file is one JSON object; nations and regions are fixed small dimensions
    per = joined.groupBy("r_name").agg(F.collect_list("n_name").alias("s"))
    one = per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "s")))).alias("value"))
    one.write.text(folder)
    return st.read_splits(v.spark, folder)


@query("read_split_file", """SELECT 'ok' AS kind, CAST(c_custkey AS VARCHAR) AS scene_id, c_mktsegment AS value FROM customer WHERE c_custkey IN (SELECT user_id FROM events)  AND c_custkey % 3 > 0
UNION ALL SELECT 'fault', CAST(c_custkey AS VARCHAR), 'unknown scene' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) AND c_custkey % 3 > 0
UNION ALL SELECT 'fault', CAST(user_id AS VARCHAR), 'scene has no split' FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)""")
def _(v):
    scenes = v.table("events").select(c("user_id").cast("string").alias("scene_id"))
    splits = v.table("customer").where(c("c_custkey") % 3 > 0).select(c("c_custkey").cast("string").alias("scene_id"), c("c_mktsegment").alias("split"))
    good, bad = st.assign_splits(scenes, splits)
    return good.select(F.lit("ok").alias("kind"), "scene_id", c("split").alias("value")).unionByName(
        bad.select(F.lit("fault").alias("kind"), "scene_id", c("message").alias("value")))


@query("read_sensor_log", "SELECT n_name AS scene, r_name AS log FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(v):
    folder = scratch_folder(v.spark, "log")
    schemas = {}
    for name in ("nation", "region"):  # log tables are one JSON array each
        df = v.table(name)
        schemas[name] = df.schema
        df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(f"{folder}/{name}.json")
    log = st.read_sensor_log(v.spark, folder, schemas)
    region = log["region"].select(c("r_regionkey").alias("n_regionkey"), c("r_name").alias("log"))
    return log["nation"].join(region, "n_regionkey").select(c("n_name").alias("scene"), "log")


@query("unlabeled_import", f"SELECT frame_id, point_id, {r6('z * 0.001')} AS x, {r6('-x * 0.001')} AS y, {r6('-y * 0.001')} AS z, CAST(0 AS INTEGER) AS boxes FROM points")
def _(v):
    rows = sk.unlabelled_records(v.points().select("frame_id", "point_id", "x", "y", "z"), 0.001, True)
    return rows.select("frame_id", "point_id", *[rd(k).alias(k) for k in "xyz"], F.size("gt_boxes").alias("boxes"))


@query("convert_legacy_index", f"""SELECT 'old:s' || scene_id || ':' || lpad(CAST(frame_id AS VARCHAR), 6, '0') AS token, CASE WHEN frame_id > 0 THEN 'old:s' || scene_id || ':' || lpad(CAST(frame_id - 1 AS VARCHAR), 6, '0') ELSE '' END AS prev_token,
{r6('-cos(yaw)', 5)} AS m11, {r6('sin(yaw)', 5)} AS m01 FROM poses""")
def _(v):
    path = F.format_string("old/s%d/rgb/%06d.png", "scene_id", "frame_id")
    index = v.poses().select(path.alias("path"), la.to_array(la.yaw_pose(c("tx"), c("ty"), c("yaw"))).alias("camera2base"))
    out = sk.convert_legacy(index, "path", "old")
    return out.select("token", "prev_token", rd(c("camera2base")[1][1], 5).alias("m11"), rd(c("camera2base")[0][1], 5).alias("m01"))


@query("clone_with_replacement", f"SELECT frame_id, point_id, {r6('x')} AS x FROM points WHERE frame_id % 4 <> 0 UNION ALL SELECT frame_id, point_id, {r6('x * 2')} FROM points WHERE frame_id % 4 = 0 AND point_id % 2 = 0")
def _(v):
    pts = v.points().select("frame_id", "point_id", "x")
    new = pts.where((c("frame_id") % 4 == 0) & (c("point_id") % 2 == 0)).withColumn("x", c("x") * 2)
    return sk.clone_with_replacement(pts, new, ["frame_id"]).withColumn("x", rd("x"))


@query("refresh_counts", "SELECT frame_id, CASE WHEN frame_id % 4 = 0 THEN count(*) FILTER (l_linenumber > 3) ELSE count(*) END AS point_count FROM rawpoints GROUP BY frame_id")
def _(v):
    pts = v.rawpoints()
    manifest_ = pts.groupBy("frame_id").agg(F.count("*").alias("point_count"))
    return sk.refresh_counts(manifest_, pts.where((c("frame_id") % 4 == 0) & (c("l_linenumber") > 3)))


@query("export_coco_2d", f"""WITH {REPROJECT_SQL} SELECT CAST(row_number() OVER (ORDER BY frame_id, box_id) - 1 AS BIGINT) AS id, frame_id AS image_id, CAST(CASE name WHEN 'SMALL' THEN 0 ELSE 1 END AS BIGINT) AS category_id,
 {r6('(x2 - x1) * (y2 - y1)', 3)} AS area, {r6('x1', 3)} AS x, {r6('y2 - y1', 3)} AS height FROM seen2d WHERE name IN ('SMALL', 'LARGE')""")
def _(v):
    boxes = tk.reproject_boxes(v.boxes(), K, (100, 80), near=0.1)
    folder = scratch_folder(v.spark, "coco")
    sk.export_coco(sk.coco_tables(boxes, v.boxes().select(c("frame_id").alias("id")).distinct(), ("SMALL", "LARGE")), folder)
    back = v.spark.read.schema("id bigint, image_id bigint, category_id bigint, area double, bbox array<double>").json(f"{folder}/annotations")
    return back.select("id", "image_id", "category_id", rd("area", 3).alias("area"), rd(c("bbox")[0], 3).alias("x"), rd(c("bbox")[3], 3).alias("height"))


@query("export_detections", f"SELECT frame_id, det_id, {r6('score', 5)} AS score, {r6('x', 5)} AS x, CASE WHEN sqrt(vx * vx + vy * vy) > 0.2 THEN 'moving' ELSE 'still' END AS attribute FROM detections")
def _(v):
    rule = F.when(F.sqrt(c("vx") * c("vx") + c("vy") * c("vy")) > 0.2, "moving").otherwise("still")
    folder = scratch_folder(v.spark, "detections")
    sk.export_detections(sk.detection_records(v.detections(), rule), folder)
    item = "frame_id bigint, det_id bigint, translation array<double>, detection_score double, attribute_name string"
    rows = v.spark.read.schema(item).json(folder)
    return rows.select("frame_id", "det_id", rd("detection_score", 5).alias("score"), rd(c("translation")[0], 5).alias("x"), c("attribute_name").alias("attribute"))


@query("write_dataset", f"WITH {MANIFEST} SELECT split, count(DISTINCT scene_id) AS scenes, count(*) AS frames FROM manifest GROUP BY split")
def _(v):
    folder = scratch_folder(v.spark, "dataset")
    sk.write_dataset(manifest(v), folder)
    return v.spark.read.parquet(f"{folder}/summary")


@query("write_index_splits", f"WITH {MANIFEST} SELECT split, scene_id, frame_id, timestamp FROM manifest")
def _(v):
    folder = scratch_folder(v.spark, "index")
    sk.write_index_splits(manifest(v).select("split", "scene_id", "frame_id", "timestamp"), folder)
    return v.spark.read.schema("scene_id string, frame_id bigint, timestamp bigint, split string").parquet(folder)


@query("write_metrics_jsonl", f"SELECT metric, epoch, {r6('value', 5)} AS value FROM epochs")
def _(v):
    folder = scratch_folder(v.spark, "metrics")
    sk.append_metrics(v.epochs().where(c("epoch") < 15), folder)
    sk.append_metrics(v.epochs().where(c("epoch") >= 15), folder)
    back = v.spark.read.schema("metric string, epoch bigint, value double").json(folder)
    return back.select("metric", "epoch", rd("value", 5).alias("value"))


# Streams ----------------------------------------------------------------------------------

def stream(v, name):
    schema = v.table(name).schema
    return v.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(v.sf_dir)


def run(v, df, mode):
    return sj.run_available(df, scratch_folder(v.spark, "stream"), mode)


MICROS = ("unix_date(cast(ts AS date)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L"
          " + cast(extract(SECOND FROM ts) * 1000000 AS bigint)")


@query("stream_scene_summary", "SELECT user_id AS scene_id, count(*) AS frames, CAST(min(floor(value)) AS BIGINT) AS min_points, CAST(max(floor(value)) AS BIGINT) AS max_points, CAST(sum(floor(value)) AS BIGINT) AS points FROM events GROUP BY 1")
def _(v):
    frames = stream(v, "events").select(c("user_id").alias("scene_id"), F.floor("value").alias("points"))
    return run(v, sj.scene_summary(frames), "complete")


_LAB = "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END"
_SCR = "CAST((l_partkey % 100) / 100.0::DOUBLE AS FLOAT)"


@query("stream_map_metrics", "SELECT l_returnflag AS class_id, " + ", ".join(
    f"CAST(sum(CASE WHEN {_SCR} >= CAST({t} AS FLOAT) AND {_LAB} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp{i}, CAST(sum(CASE WHEN {_SCR} >= CAST({t} AS FLOAT) AND {_LAB} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp{i}, "
    f"CAST(sum(CASE WHEN {_SCR} < CAST({t} AS FLOAT) AND {_LAB} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn{i}" for i, t in enumerate(METRIC_THRESHOLDS)) + " FROM lineitem GROUP BY 1")
def _(v):
    cells = stream(v, "lineitem").select(c("l_returnflag").alias("class_id"), F.when(c("l_linestatus") == "O", 1).otherwise(0).alias("label"),
                                         ((c("l_partkey") % 100) / 100.0).alias("score"))
    return run(v, sj.map_metrics(cells, METRIC_THRESHOLDS), "complete")


@query("stream_throughput", f"SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 86400000000 AS BIGINT) AS day, count(*) AS samples, {r6('sum(value)', 3)} AS value, {r6('count(*) / 86400.0', 6)} AS per_second FROM events GROUP BY 1")
def _(v):
    samples = stream(v, "events").select(F.timestamp_micros(F.expr(MICROS)).alias("at"), "value")
    out = run(v, sj.throughput(samples, "at", "1 day"), "complete")
    return out.select(F.floor(F.unix_micros("start") / 86400000000).alias("day"), "samples", rd("value", 3).alias("value"), rd("per_second").alias("per_second"))


@query("stream_dedup_tokens", "SELECT DISTINCT user_id || ':' || event_type AS token FROM events")
def _(v):
    frames = stream(v, "events").select(F.concat_ws(":", c("user_id").cast("string"), "event_type").alias("token"), F.timestamp_micros(F.expr(MICROS)).alias("at"))
    return run(v, sj.dedup_tokens(frames, "at", "60 days"), "append").select("token")


def run_in_parts(v, frames, job):
    """Early, middle and late frames reach the stream one after the other; the job is started anew for
    each, so that scenes go on from the state that the checkpoint holds."""
    whole, arrived, target = (scratch_folder(v.spark, name) for name in ("frames", "arrived", "stream"))
    frames.write.parquet(whole)
    frames = v.spark.read.schema(frames.schema).parquet(whole)
    first, second = frames.agg(F.percentile_approx("frame_id", [0.33, 0.67])).first()[0] or (0, 0)
    part = F.when(c("frame_id") <= first, 0).when(c("frame_id") <= second, 1).otherwise(2)
    for number in range(3):
        frames.where(part == number).write.mode("append").parquet(arrived)
        out = sj.run_available(job(v.spark.readStream.schema(frames.schema).parquet(arrived)), target, "append")
    return out


@query("stream_sequence_check", """SELECT scene_id, frame_id, CASE WHEN frame_id > first_bad THEN 'frame id is not next' WHEN frame_id = first_bad THEN 'timestamp is not later' ELSE '' END AS fault
FROM frames LEFT JOIN (SELECT scene_id, min(frame_id) AS first_bad FROM frames WHERE event_id % 211 = 0 AND frame_id > 0 GROUP BY 1) USING (scene_id)""")
def _(v):
    rows = tokens(v).select("scene_id", "frame_id", "timestamp", c("event_id").alias("arrival"))
    # an early timestamp rejects its frame, and with it every later id of the scene
    late = (c("arrival") % 211 == 0) & (c("frame_id") > 0)
    rows = rows.withColumn("timestamp", F.when(late, F.lit(0)).otherwise(c("timestamp")))
    return run_in_parts(v, rows, sj.sequence_check).select("scene_id", "frame_id", "fault")


@query("stream_sweep_buffer", f"""SELECT a.scene_id, a.frame_id, CAST(a.frame_id - b.frame_id - 1 AS INTEGER) AS rank, b.frame_id AS source_frame,
{r6("cos(a.yaw) * (b.tx - a.tx) + sin(a.yaw) * (b.ty - a.ty)", 5)} AS dx, {r6("cos(a.yaw) * (b.ty - a.ty) - sin(a.yaw) * (b.tx - a.tx)", 5)} AS dy, {r6("b.yaw - a.yaw", 5)} AS dyaw
FROM poses a JOIN poses b ON a.scene_id = b.scene_id AND b.frame_id BETWEEN a.frame_id - 3 AND a.frame_id - 1""")
def _(v):
    links = run_in_parts(v, v.poses(), lambda frames: sj.sweep_buffer(frames, 3, ("tx", "ty", "yaw")))
    return links.select("scene_id", "frame_id", "rank", "source_frame", *(rd(k, 5).alias(k) for k in ("dx", "dy", "dyaw")))


@query("stream_early_stop")
def _(v):
    folder = scratch_folder(v.spark, "epochs")
    v.epochs().select(c("metric").alias("run"), "epoch", "value").write.parquet(folder)
    rows = v.spark.readStream.schema("run string, epoch bigint, value double").parquet(folder)
    out = run(v, sj.early_stop(rows, 5, 0.001), "append")
    return out.withColumn("best", rd("best", 5))


@query("stream_manifest", "SELECT user_id AS scene_id, event_id AS frame_id FROM events")
def _(v):
    folder = scratch_folder(v.spark, "manifest")
    v.table("events").select(c("user_id").alias("scene_id"), c("event_id").alias("frame_id")).write.json(folder)
    return run(v, sj.stream_manifest(v.spark, folder, "scene_id bigint, frame_id bigint"), "append")
