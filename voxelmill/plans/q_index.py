"""Queries: record index, sweeps, frame windows, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import linalg as la
from voxelmill.operators import index as ix
from voxelmill.operators import windows as wn
from voxelmill.plans.registry import query, r6, rd
from voxelmill.skew import with_row_number

c = F.col
TOKEN_SQL = "'ev:' || scene_id || ':' || lpad(CAST(frame_id AS VARCHAR), 6, '0')"


def tokens(v):
    return v.frames().withColumn("token", F.format_string("ev:%d:%06d", "scene_id", "frame_id"))


@query("sensor_log_star_join", """SELECT event_id, event_type, c_mktsegment, n_name, r_name FROM events
JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(v):
    cust, nat, reg = v.table("customer"), v.table("nation"), v.table("region")
    return ix.star_join(
        v.table("events").select("event_id", "event_type", c("user_id").alias("c_custkey")),
        (cust.select("c_custkey", c("c_nationkey").alias("n_nationkey"), "c_mktsegment"), "c_custkey"),
        (nat.select("n_nationkey", "n_name", c("n_regionkey").alias("r_regionkey")), "n_nationkey"),
        (reg.select("r_regionkey", "r_name"), "r_regionkey"),
    ).select("event_id", "event_type", "c_mktsegment", "n_name", "r_name")


CHAIN_SQL = """chain AS (SELECT *, row_number() OVER (PARTITION BY scene_id, channel ORDER BY timestamp, record_id) AS pos FROM records)"""
CHAIN = ["scene_id", "channel"]


def chain(v):
    return ix.number_chain(v.records(), CHAIN, ["timestamp", "record_id"])


REL = {
    "rel_x": "cos(a.yaw) * (b.tx - a.tx) + sin(a.yaw) * (b.ty - a.ty)",
    "rel_y": "-sin(a.yaw) * (b.tx - a.tx) + cos(a.yaw) * (b.ty - a.ty)",
    "rel_cos": "cos(b.yaw - a.yaw)", "rel_sin": "sin(b.yaw - a.yaw)",
}
REL_SQL = ", ".join(f"{r6(e, 5)} AS {n}" for n, e in REL.items())


def rel_cols():
    return [rd(n, 5).alias(n) for n in REL]


@query("lidar_sweep_chain", f"""WITH {CHAIN_SQL}
SELECT a.record_id, CAST(a.pos - b.pos - 1 AS INTEGER) AS rank, b.record_id AS sweep_id, {r6('(a.timestamp - b.timestamp) / 1e6')} AS lag
FROM chain a JOIN chain b ON a.scene_id = b.scene_id AND a.channel = b.channel AND b.pos BETWEEN a.pos - 10 AND a.pos - 1""")
def _(v):
    out = ix.earlier_records(chain(v), CHAIN, ["record_id", "timestamp"], 10)
    return out.select("record_id", "rank", c("s_record_id").alias("sweep_id"),
                      rd((c("timestamp") - c("s_timestamp")) / 1e6).alias("lag"))


@query("radar_sweep_chain", f"""WITH {CHAIN_SQL}
SELECT a.record_id, CAST(k AS INTEGER) AS rank, b.record_id AS sweep_id FROM chain a CROSS JOIN (SELECT unnest(range(10)) AS k)
JOIN chain b ON a.scene_id = b.scene_id AND a.channel = b.channel AND b.pos = greatest(a.pos - k, 1)""")
def _(v):
    out = ix.earlier_records(chain(v), CHAIN, ["record_id"], 10, include_current=True, repeat_last=True)
    return out.select("record_id", "rank", c("s_record_id").alias("sweep_id"))


# Test poses with height, roll and pitch, and two mounts of the fixture robot: x, y, z, roll, pitch, yaw.
TILT = {"tz": "(record_id % 9) * 0.1", "roll": "(record_id % 5 - 2) * 0.04", "pitch": "(record_id % 7 - 3) * 0.05"}
MOUNTS = {"click": (0.9, 0.0, 1.8, 0.01, -0.02, -1.57), "view": (1.7, -0.3, 1.5, -1.5, 0.03, 0.4)}


def _pose_sql(out, t, roll, pitch, yaw):
    """The 12 elements of a pose as SQL columns ``out`` + row + column."""
    cr, sr, cp, sp, cy, sy = (f"{f}({a})" for a in (roll, pitch, yaw) for f in ("cos", "sin"))
    rows = [[f"{cy} * {cp}", f"{cy} * {sp} * {sr} - {sy} * {cr}", f"{cy} * {sp} * {cr} + {sy} * {sr}", t[0]],
            [f"{sy} * {cp}", f"{sy} * {sp} * {sr} + {cy} * {cr}", f"{sy} * {sp} * {cr} - {cy} * {sr}", t[1]],
            [f"-{sp}", f"{cp} * {sr}", f"{cp} * {cr}", t[2]]]
    return ", ".join(f"CAST({e} AS DOUBLE) AS {out}{i}{j}" for i, row in enumerate(rows) for j, e in enumerate(row))


def _inverse_sql(out, m):
    return ", ".join(
        f"{m}{j}{i} AS {out}{i}{j}" if j < 3 else f"-({m}0{i} * {m}03 + {m}1{i} * {m}13 + {m}2{i} * {m}23) AS {out}{i}3" for i in range(3) for j in range(4))


def _product_sql(out, a, b):
    return ", ".join(" + ".join(f"{a}{i}{k} * {b}{k}{j}" for k in range(3)) + (f" + {a}{i}3" if j == 3 else "") + f" AS {out}{i}{j}" for i in range(3) for j in range(4))


_POSE_OUT = [f"m{i}{j}" for i in range(3) for j in range(4)]
_LIDAR, _VIEW = MOUNTS["click"], MOUNTS["view"]
NEAREST_SQL = f"""full3 AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in TILT.items())} FROM records),
 near AS (SELECT a.record_id, b.record_id AS s_record_id, a.tx, a.ty, a.tz, a.roll, a.pitch, a.yaw, b.tx AS s_tx, b.ty AS s_ty, b.tz AS s_tz, b.roll AS s_roll, b.pitch AS s_pitch, b.yaw AS s_yaw
  FROM full3 a JOIN full3 b ON a.scene_id = b.scene_id AND a.channel = 'click' AND b.channel = 'view'
  QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY abs(a.timestamp - b.timestamp), (b.timestamp, b.record_id) > (a.timestamp, a.record_id),
   CASE WHEN (b.timestamp, b.record_id) > (a.timestamp, a.record_id) THEN b.record_id ELSE -b.record_id END) = 1),
 p1 AS (SELECT *, {_pose_sql('l', _LIDAR[:3], *_LIDAR[3:])}, {_pose_sql('e', ('tx', 'ty', 'tz'), 'roll', 'pitch', 'yaw')}, {_pose_sql('g', ('s_tx', 's_ty', 's_tz'), 's_roll', 's_pitch', 's_yaw')}, {_pose_sql('s', _VIEW[:3], *_VIEW[3:])} FROM near),
 p2 AS (SELECT record_id, s_record_id, {_inverse_sql('li', 'l')}, {_inverse_sql('ei', 'e')}, {_product_sql('gs', 'g', 's')} FROM p1),
 p3 AS (SELECT *, {_product_sql('le', 'li', 'ei')} FROM p2),
 p4 AS (SELECT record_id, s_record_id, {_product_sql('m', 'le', 'gs')} FROM p3)"""


@query("sensor_to_lidar", f"WITH {NEAREST_SQL} SELECT record_id, s_record_id AS sensor_id, {', '.join(f'{r6(m, 4)} AS {m}' for m in _POSE_OUT)} FROM p4")
def _(v):
    records = v.records().withColumns({n: F.expr(e).cast("double") for n, e in TILT.items()})
    pairs = ix.nearest_records(records, ["scene_id"], c("channel") == "click", c("channel") == "view",
                               ["channel", "tx", "ty", "tz", "roll", "pitch", "yaw"])
    out = ix.sensor_to_lidar(pairs, MOUNTS, "click")
    return out.select("record_id", c("s_record_id").alias("sensor_id"), *[rd(c("pose")[i][j], 4).alias(f"m{i}{j}") for i in range(3) for j in range(4)])


@query("history_sweeps", f"""SELECT a.scene_id, a.frame_id, CAST(a.frame_id - b.frame_id - 1 AS INTEGER) AS rank, {REL_SQL}
FROM poses a JOIN poses b ON a.scene_id = b.scene_id AND b.frame_id BETWEEN a.frame_id - 5 AND a.frame_id - 1""")
def _(v):
    out = ix.earlier_records(v.poses(), ["scene_id"], ["tx", "ty", "yaw"], 5, pos="frame_id")
    return ix.relative_planar(out).select("scene_id", "frame_id", "rank", *rel_cols())


@query("sweep_rank", """SELECT a.scene_id, a.frame_id, b.frame_id AS source_frame,
CAST(row_number() OVER (PARTITION BY a.scene_id, a.frame_id ORDER BY b.frame_id DESC) AS INTEGER) AS rank
FROM frames a JOIN frames b ON a.scene_id = b.scene_id AND b.frame_id BETWEEN a.frame_id - 3 AND a.frame_id - 1""")
def _(v):
    out = ix.earlier_records(v.frames().withColumn("src", c("frame_id")), ["scene_id"], ["src"], 3, pos="frame_id")
    return out.select("scene_id", "frame_id", c("s_src").alias("source_frame"), (c("rank") + 1).alias("rank"))


@query("time_lag", f"""WITH {CHAIN_SQL} SELECT a.record_id, {r6('(a.timestamp - b.timestamp) / 1e6')} AS lag FROM chain a JOIN chain b
ON a.scene_id = b.scene_id AND a.channel = b.channel AND b.pos = a.pos - 1""")
def _(v):
    out = ix.earlier_records(chain(v), CHAIN, ["timestamp"], 1)
    return out.select("record_id", rd((c("timestamp") - c("s_timestamp")) / 1e6).alias("lag"))


@query("trajectory_join", f"""SELECT f.scene_id, f.frame_id, p.record_id IS NULL AS missing, {r6('p.tx', 5)} AS tx FROM frames f
LEFT JOIN (SELECT * FROM records WHERE channel <> 'error') p ON p.record_id = f.event_id""")
def _(v):
    poses = v.records().where(c("channel") != "error").select(c("record_id").alias("event_id"), "tx")
    out = v.frames().join(poses, "event_id", "left")
    return out.select("scene_id", "frame_id", c("tx").isNull().alias("missing"), rd("tx", 5).alias("tx"))


@query("canonical_token", f"SELECT {TOKEN_SQL} AS token FROM frames")
def _(v):
    return tokens(v).select("token")


@query("prev_token", f"""SELECT token, coalesce(lag(token) OVER (PARTITION BY scene_id ORDER BY timestamp, frame_id), '') AS prev_token
FROM (SELECT *, {TOKEN_SQL} AS token FROM frames)""")
def _(v):
    return ix.with_prev_token(tokens(v)).select("token", "prev_token")


@query("prev_index_lookup", f"""WITH t AS (SELECT *, {TOKEN_SQL} AS token, CASE WHEN scene_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM frames),
 l AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY scene_id ORDER BY timestamp, frame_id), '') AS prev_token,
   row_number() OVER (PARTITION BY split ORDER BY timestamp, token) - 1 AS idx FROM t)
SELECT a.token, a.split, CAST(a.idx AS BIGINT) AS idx, CAST(coalesce(b.idx, -1) AS BIGINT) AS prev, coalesce(b.split = a.split, true) AS split_ok
FROM l a LEFT JOIN l b ON a.prev_token = b.token""")
def _(v):
    split = F.when(c("scene_id") % 5 == 0, "val").otherwise("train")
    linked = ix.with_prev_token(tokens(v).withColumn("split", split))
    numbered = with_row_number(linked, ["split"], [c("timestamp"), c("token")], ix.hour_slice(), "rn")
    out = ix.previous_index(numbered.withColumn("idx", c("rn") - 1))
    return out.select("token", "split", "idx", "prev", "split_ok")


@query("read_index", f"""SELECT token, timestamp, CAST(rn - 1 AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (ORDER BY timestamp, token) AS rn
 FROM (SELECT *, {TOKEN_SQL} AS token FROM frames)) WHERE (rn - 1) % 5 = 0""")
def _(v):
    return wn.every_nth(tokens(v), ["timestamp", "token"], ix.hour_slice(), 5).select("token", "timestamp", "pos")


@query("read_robot_index", f"""SELECT token, split, CAST(rn - 1 AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (ORDER BY split, scene_id, frame_id) AS rn
 FROM (SELECT *, {TOKEN_SQL} AS token, CASE WHEN scene_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM frames)) WHERE (rn - 1) % 4 = 0""")
def _(v):
    split = F.when(c("scene_id") % 5 == 0, "val").otherwise("train")
    frames = tokens(v).withColumn("split", split)
    # one slice per scene, in the order of the index
    slices = F.when(c("split") == "train", c("scene_id")).otherwise(c("scene_id") + (1 << 40))
    out = wn.every_nth(frames, ["split", "scene_id", "frame_id"], slices, 4)
    return out.select("token", "split", "pos")


@query("sort_by_timestamp", f"SELECT {TOKEN_SQL} AS token, timestamp FROM frames ORDER BY timestamp, token")
def _(v):
    return tokens(v).orderBy("timestamp", "token").select("token", "timestamp")


@query("sequence_check", """WITH l AS (SELECT scene_id, frame_id, CASE WHEN event_id % 97 = 0 THEN timestamp - 864000000000 ELSE timestamp END AS timestamp FROM frames WHERE event_id % 89 <> 0),
 p AS (SELECT *, lag(frame_id) OVER w AS pf, lag(timestamp) OVER w AS pt FROM l WINDOW w AS (PARTITION BY scene_id ORDER BY frame_id))
SELECT scene_id, frame_id, 'frame_id' AS field, 'first frame id is not 0' AS message FROM p WHERE pf IS NULL AND frame_id <> 0
UNION ALL SELECT scene_id, frame_id, 'frame_id', 'frame ids are not contiguous' FROM p WHERE pf IS NOT NULL AND frame_id <> pf + 1
UNION ALL SELECT scene_id, frame_id, 'timestamp', 'timestamp does not grow' FROM p WHERE timestamp <= pt""")
def _(v):
    frames = v.frames().where(c("event_id") % 89 != 0).withColumn(
        "timestamp", F.when(c("event_id") % 97 == 0, c("timestamp") - 864000000000).otherwise(c("timestamp")))
    return wn.sequence_check(frames).select("scene_id", "frame_id", "field", "message")


@query("append_order_check", """WITH a AS (SELECT scene_id, frame_id, timestamp, row_number() OVER (PARTITION BY scene_id ORDER BY event_id) - 1 AS expected,
  lag(timestamp) OVER (PARTITION BY scene_id ORDER BY event_id) AS last FROM (SELECT scene_id, frame_id + CAST(event_id % 101 = 0 AS BIGINT) AS frame_id, timestamp, event_id FROM frames))
SELECT scene_id, frame_id, CAST(expected AS BIGINT) AS expected FROM a WHERE frame_id <> expected OR timestamp <= last""")
def _(v):
    frames = v.frames().withColumn("frame_id", c("frame_id") + (c("event_id") % 101 == 0).cast("bigint"))
    return wn.append_order_check(frames, "event_id").select("scene_id", "frame_id", "expected")


@query("periodic_split", """SELECT scene_id, frame_id, CASE WHEN frame_id % 9 < 7 THEN 'train' WHEN frame_id % 9 < 8 THEN 'val' ELSE 'test' END AS split FROM frames""")
def _(v):
    return v.frames().select("scene_id", "frame_id", ix.periodic_split(c("frame_id")).alias("split"))


@query("block_split", """SELECT scene_id, frame_id, CASE WHEN frame_id < floor(n * 7 / 9) THEN 'train' WHEN frame_id < floor(n * 8 / 9) THEN 'val' ELSE 'test' END AS split
FROM frames JOIN (SELECT scene_id, count(*) AS n FROM frames GROUP BY 1) USING (scene_id)""")
def _(v):
    frames = v.frames()
    totals = frames.groupBy("scene_id").agg(F.count("*").alias("n"))
    return frames.join(totals, "scene_id").select(
        "scene_id", "frame_id", ix.block_split(c("frame_id"), c("n")).alias("split"))


@query("renumber_frames", """SELECT scene_id, split, frame_id AS raw_id, CAST(row_number() OVER (PARTITION BY scene_id, split ORDER BY frame_id) - 1 AS BIGINT) AS frame_id
FROM (SELECT scene_id, frame_id, CASE WHEN frame_id % 9 < 7 THEN 'train' WHEN frame_id % 9 < 8 THEN 'val' ELSE 'test' END AS split FROM frames)""")
def _(v):
    frames = v.frames().withColumn("split", ix.periodic_split(c("frame_id")))
    out = with_row_number(frames, ["scene_id", "split"], [c("frame_id")], F.expr("frame_id div 65536"), "rn")
    return out.select("scene_id", "split", c("frame_id").alias("raw_id"), (c("rn") - 1).alias("frame_id"))


@query("even_subsample", """WITH n AS (SELECT frame_id, count(*) AS n FROM points GROUP BY 1),
 idx AS (SELECT frame_id, i * (n - 1) // 99 AS point_id FROM n CROSS JOIN (SELECT unnest(range(100)) AS i) WHERE n > 100
   UNION SELECT frame_id, point_id FROM points JOIN n USING (frame_id) WHERE n <= 100)
SELECT frame_id, CAST(point_id AS BIGINT) AS point_id FROM points SEMI JOIN idx USING (frame_id, point_id)""")
def _(v):
    return ix.even_subsample(v.points(), 100).select("frame_id", "point_id")


@query("stride_sample", "SELECT frame_id, point_id FROM points WHERE point_id % 3 = 0")
def _(v):
    return v.points().where(F.pmod(c("point_id"), F.lit(3)) == 0).select("frame_id", "point_id")


@query("group_ids", """SELECT frame_id, box_id, CAST(dense_rank() OVER (ORDER BY frame_id, name) - 1 AS BIGINT) AS group_id FROM boxes""")
def _(v):
    # groups are few rows per frame; frames are the slices of the global order
    boxes = v.boxes()
    groups = boxes.select("frame_id", "name").distinct()
    numbered = with_row_number(groups, [], [c("frame_id"), c("name")], F.expr("frame_id div 1024"), "rn")
    return boxes.join(numbered, ["frame_id", "name"]).select("frame_id", "box_id", (c("rn") - 1).alias("group_id"))


@query("best_so_far", f"""WITH e AS (SELECT metric, epoch, value, max(value) OVER (PARTITION BY metric ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM epochs)
SELECT metric, epoch, {r6('best', 5)} AS best, CAST(epoch - max(CASE WHEN value = best THEN epoch END) OVER (PARTITION BY metric ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stale FROM e""")
def _(v):
    out = wn.best_so_far(v.epochs(), ["metric"])
    return out.select("metric", "epoch", rd("best", 5).alias("best"), c("stale"))


ANN_SQL = """obj AS (SELECT frame_id, box_id, name, CASE WHEN box_id = 5 THEN 'nan'::DOUBLE ELSE vx END AS vx, (frame_id * 8 + box_id) % 5 AS num_lidar_pts FROM boxes)"""


@query("annotation_table", f"""WITH {ANN_SQL} SELECT frame_id, box_id, CAST(CASE name WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'PROMO' THEN 2 ELSE -1 END AS INTEGER) AS label,
CASE WHEN isnan(vx) THEN 0.0 ELSE vx END AS vx FROM obj WHERE num_lidar_pts > 0""")
def _(v):
    objects = v.boxes().withColumns({
        "vx": F.when(c("box_id") == 5, F.lit(float("nan"))).otherwise(c("vx")),
        "num_lidar_pts": (c("frame_id") * 8 + c("box_id")) % 5})
    return (ix.annotation_table(objects, ("SMALL", "LARGE", "PROMO"), False)
            .select("frame_id", "box_id", "label", "vx"))


@query("load_annotations_3d", f"SELECT frame_id, box_id, name, {r6('x', 5)} AS x, {r6('dx', 5)} AS dx, {r6('yaw', 5)} AS yaw FROM boxes")
def _(v):
    return v.boxes().select("frame_id", "box_id", "name", *[rd(k, 5).alias(k) for k in ("x", "dx", "yaw")])


@query("read_multi_sweeps", f"""WITH sw AS (SELECT f AS frame_id, f - k - 1 AS source_frame, 0.05::DOUBLE * (k + 1) AS lag, 0.25::DOUBLE * (k + 1) AS rx FROM (SELECT DISTINCT frame_id AS f FROM rawpoints) CROSS JOIN (SELECT unnest(range(2)) AS k))
SELECT s.frame_id, p.frame_id AS source_frame, {r6('x * cos(0.1) - y * sin(0.1) + rx', 5)} AS x, {r6('x * sin(0.1) + y * cos(0.1)', 5)} AS y, {r6('lag', 5)} AS time
FROM sw s JOIN rawpoints p ON p.frame_id = s.source_frame WHERE NOT (abs(x) < 3 AND abs(y) < 3)
UNION ALL SELECT frame_id, frame_id, {r6('x', 5)}, {r6('y', 5)}, 0.0 FROM rawpoints""")
def _(v):
    pts = v.rawpoints().withColumn("point_id", F.lit(0))
    k = c("k")
    sweeps = (pts.select("frame_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
              .select("frame_id", (c("frame_id") - k - 1).alias("source_frame"), (0.05 * (k + 1)).alias("lag"),
                      (0.25 * (k + 1)).alias("rel_x"), F.lit(0.0).alias("rel_y"),
                      F.cos(F.lit(0.1)).alias("rel_cos"), F.sin(F.lit(0.1)).alias("rel_sin")))
    out = ix.sweep_points(pts, sweeps, pts, 3.0)
    return out.select("frame_id", "source_frame", *[rd(n, 5).alias(n) for n in ("x", "y", "time")])


@query("read_radar_sweeps", f"""WITH {CHAIN_SQL}, sw AS (SELECT a.record_id, a.timestamp, a.pos, b.tx, b.ty, b.yaw, b.timestamp AS ts FROM chain a CROSS JOIN (SELECT unnest(range(3)) AS k)
 JOIN chain b ON a.scene_id = b.scene_id AND a.channel = b.channel AND b.pos = greatest(a.pos - k, 1))
SELECT record_id, {r6('tx * cos(0.3) - ty * sin(0.3)', 5)} AS vx, {r6('tx * sin(0.3) + ty * cos(0.3)', 5)} AS vy,
 {r6('yaw + (tx * cos(0.3) - ty * sin(0.3)) * ((timestamp - ts) / 1e6)', 3)} AS x, {r6('(timestamp - ts) / 1e6', 5)} AS lag FROM sw""")
def _(v):
    sw = ix.earlier_records(chain(v), CHAIN, ["tx", "ty", "yaw", "timestamp"], 3, include_current=True, repeat_last=True)
    out = wn.radar_compensate(sw, 0.3)
    return out.select("record_id", rd("vx", 5).alias("vx"), rd("vy", 5).alias("vy"), rd("x", 3).alias("x"), rd("lag", 5).alias("lag"))


@query("front_camera_index", f"""WITH {CHAIN_SQL} SELECT a.record_id, CAST(a.pos AS BIGINT) AS pos, {r6('a.tx', 5)} AS tx, n_name FROM chain a JOIN customer ON c_custkey = scene_id JOIN nation ON n_nationkey = c_nationkey WHERE channel = 'click'""")
def _(v):
    front = ix.number_chain(v.records().where(c("channel") == "click"), CHAIN, ["timestamp", "record_id"])
    cust = v.table("customer").select(c("c_custkey").alias("scene_id"), c("c_nationkey").alias("n_nationkey"))
    return (ix.star_join(front, (cust, "scene_id"), (v.table("nation").select("n_nationkey", "n_name"), "n_nationkey"))
            .select("record_id", "pos", rd("tx", 5).alias("tx"), "n_name"))


# The focal length changes from camera record to camera record.
_FOCAL, _CX, _CY = "(400.0 + s_record_id % 100)", 319.5, 239.5
_CALIBRATION_SQL = {"ego2global": "e", "lidar2ego": "l", "camera2ego": "s", "camera2lidar": "m", "lidar2camera": "c"}
_IMAGE_SQL = [[f"{_FOCAL} * c0{j} + {_CX}::DOUBLE * c2{j}" for j in range(4)], [f"{_FOCAL} * c1{j} + {_CY}::DOUBLE * c2{j}" for j in range(4)], [f"c2{j}" for j in range(4)]]
_CELLS = [(i, j) for i in range(3) for j in range(4)]


@query("frame_calibration", f"""WITH {NEAREST_SQL}, p5 AS (SELECT p4.*, {_inverse_sql('c', 'm')} FROM p4), p6 AS (SELECT p5.*, p1.* EXCLUDE (record_id, s_record_id) FROM p5 JOIN p1 USING (record_id))
SELECT record_id, s_record_id AS camera_id, {', '.join(f'{r6(f"{m}{i}{j}", 4)} AS {n}_{i}{j}' for n, m in _CALIBRATION_SQL.items() for i, j in _CELLS)},
{', '.join(f'{r6(_IMAGE_SQL[i][j], 4)} AS lidar2image_{i}{j}' for i, j in _CELLS)}, {r6(_FOCAL, 4)} AS fx, {r6(_FOCAL, 4)} AS fy, {r6(_CX, 4)} AS cx, {r6(_CY, 4)} AS cy FROM p6""")
def _(v):
    records = v.records().withColumns({n: F.expr(e).cast("double") for n, e in TILT.items()})
    state = ("tx", "ty", "tz", "roll", "pitch", "yaw")
    pairs = ix.nearest_records(records, ["scene_id"], c("channel") == "click", c("channel") == "view", ["channel", *state])
    rows = ix.sensor_to_lidar(pairs, MOUNTS, "click")
    mount = {n: la.euler_pose([F.lit(x) for x in m[:3]], *[F.lit(x) for x in m[3:]]) for n, m in MOUNTS.items()}
    ego = la.euler_pose([c("tx"), c("ty"), c("tz")], c("roll"), c("pitch"), c("yaw"))
    focal, zero = 400.0 + c("s_record_id") % 100, F.lit(0.0)
    lens = [[focal, zero, F.lit(_CX)], [zero, focal, F.lit(_CY)], [zero, zero, F.lit(1.0)]]
    out = wn.frame_calibration(rows, ego, mount["click"], mount["view"], la.from_array("pose", 4, 4), lens)
    cells = [rd(c(n)[i][j], 4).alias(f"{n}_{i}{j}") for n in wn.CALIBRATION if n != "camera_intrinsics" for i, j in _CELLS]
    k = c("camera_intrinsics")
    return out.select("record_id", c("s_record_id").alias("camera_id"), *cells, rd(k[0][0], 4).alias("fx"), rd(k[1][1], 4).alias("fy"), rd(k[0][2], 4).alias("cx"), rd(k[1][2], 4).alias("cy"))


@query("convert_canonical_to_training", f"""WITH q AS (SELECT scene_id, frame_id, timestamp, tx, ty, CASE WHEN cos((yaw + 0.001) / 2) < 0 THEN -1 ELSE 1 END AS s, yaw + 0.001 AS a FROM poses),
 n AS (SELECT a.scene_id, a.frame_id, count(b.frame_id) AS sweeps FROM poses a LEFT JOIN poses b ON a.scene_id = b.scene_id AND b.frame_id BETWEEN a.frame_id - 5 AND a.frame_id - 1 GROUP BY ALL)
SELECT scene_id, frame_id, timestamp, {r6('s * cos(a / 2)', 5)} AS ego_qw, {r6('s * sin(a / 2)', 5)} AS ego_qz, {r6('tx', 5)} AS ego_x, {r6('ty', 5)} AS ego_y, {r6('0.3 - 0.5', 5)} AS cam2lidar_x, sweeps, CAST(0 AS INTEGER) AS n_boxes
FROM q JOIN n USING (scene_id, frame_id)""")
def _(v):
    return wn.training_records(v.poses().withColumn("yaw", c("yaw") + 0.001), 5).select(
        "scene_id", "frame_id", "timestamp", *[rd(n, 5).alias(n) for n in ("ego_qw", "ego_qz", "ego_x", "ego_y", "cam2lidar_x")],
        "sweeps", "n_boxes")
