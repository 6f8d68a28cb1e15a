"""Queries: text functions, set operations, data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import linalg as la
from voxelmill.functions import text as tx
from voxelmill.operators import index as ix
from voxelmill.operators import quality as ql
from voxelmill.operators import windows as wn
from voxelmill.plans.q_metrics import STATS, stats
from voxelmill.plans.q_raster import COLS, ROWS
from voxelmill.plans.registry import query
from voxelmill.skew import with_row_number
from voxelmill.sources import tables as st

c = F.col

# A manifest with planted faults, derived from the event table.
MANIFEST = """manifest AS (SELECT CAST(scene_id AS VARCHAR) AS scene_id, frame_id, CASE WHEN scene_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, timestamp, event_id,
  CASE WHEN event_id % 83 = 0 THEN 'ev:0:000000' ELSE 'ev:' || scene_id || ':' || lpad(CAST(frame_id AS VARCHAR), 6, '0') END AS token,
  CASE WHEN event_id % 71 = 0 THEN '../x.png' WHEN event_id % 73 = 0 THEN '/abs/x.png' WHEN event_id % 79 = 0 THEN 'images//a/./b.png' WHEN event_id % 131 = 0 THEN NULL
   ELSE 'images/' || frame_id || '.png' END AS image_path,
  CASE WHEN event_id % 61 = 0 THEN -1.0::DOUBLE ELSE 500.0::DOUBLE END AS fx, 500.0::DOUBLE AS fy, CASE WHEN event_id % 59 = 0 THEN 700.0::DOUBLE ELSE 319.5::DOUBLE END AS cx, 239.5::DOUBLE AS cy,
  CASE WHEN event_id % 67 = 0 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END AS scale, CASE WHEN event_id % 53 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS corner, CAST(round(value) AS BIGINT) AS point_count FROM frames)"""


def manifest(v):
    e = c("event_id")
    path = (F.when(e % 71 == 0, "../x.png").when(e % 73 == 0, "/abs/x.png").when(e % 79 == 0, "images//a/./b.png")
            .when(e % 131 == 0, F.lit(None)).otherwise(F.concat(F.lit("images/"), c("frame_id").cast("string"), F.lit(".png"))))
    return v.frames().select(
        c("scene_id").cast("string").alias("scene_id"), "frame_id",
        F.when(c("scene_id") % 5 == 0, "val").otherwise("train").alias("split"), "timestamp", "event_id",
        F.when(e % 83 == 0, "ev:0:000000").otherwise(
            tx.canonical_token(F.lit("ev"), c("scene_id").cast("string"), c("frame_id"), strict=False)).alias("token"),
        path.alias("image_path"), F.when(e % 61 == 0, -1.0).otherwise(500.0).alias("fx"), F.lit(500.0).alias("fy"),
        F.when(e % 59 == 0, 700.0).otherwise(319.5).alias("cx"), F.lit(239.5).alias("cy"), F.lit(0.0).alias("k20"),
        F.lit(0.0).alias("k21"), F.lit(1.0).alias("k22"), F.when(e % 67 == 0, 1.01).otherwise(1.0).alias("scale"),
        F.when(e % 53 == 0, 0.5).otherwise(1.0).alias("corner"), F.round("value").cast("bigint").alias("point_count"), "value")


def fault_sql(where, field, message, frame="frame_id", scene="scene_id", source="manifest"):
    return f"SELECT {scene} AS scene_id, {frame} AS frame_id, '{field}' AS field, '{message}' AS message FROM {source} WHERE {where}"


# Text -------------------------------------------------------------------------------------

@query("normalize_relative_path", r"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/' || url WHEN 1 THEN replace(url, '/', '\') WHEN 2 THEN 'a/../' || url WHEN 3 THEN 'C:/' || url WHEN 4 THEN './' || regexp_replace(url, '^https?://', '') ELSE regexp_replace(url, '^https?://', '') END AS raw FROM pages),
 q AS (SELECT page_id, replace(raw, '\', '/') AS t FROM p), r AS (SELECT page_id, t, list_filter(string_split(t, '/'), lambda e: e <> '' AND e <> '.') AS parts FROM q)
SELECT page_id, CASE WHEN t LIKE '/%' OR list_contains(parts, '..') OR len(parts) = 0 OR parts[1] LIKE '%:' THEN NULL ELSE array_to_string(parts, '/') END AS path FROM r""")
def _(v):
    url, bare = c("url"), F.regexp_replace("url", "^https?://", "")
    kinds = [F.concat(F.lit("/"), url), F.regexp_replace(url, "/", "\\\\"), F.concat(F.lit("a/../"), url),
             F.concat(F.lit("C:/"), url), F.concat(F.lit("./"), bare)]
    raw = None
    for i, e in enumerate(kinds):
        raw = F.when(c("page_id") % 6 == i, e) if raw is None else raw.when(c("page_id") % 6 == i, e)
    return v.table("pages").select("page_id", tx.normalize_relative_path(raw.otherwise(bare)).alias("path"))


@query("resolve_paths", "WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/data/' || page_id WHEN 1 THEN 'rel/' || page_id END AS p FROM pages) SELECT page_id, CASE WHEN p LIKE '/%' THEN p WHEN p IS NOT NULL THEN '/root/set/' || p END AS path FROM p")
def _(v):
    p = F.when(c("page_id") % 3 == 0, F.concat(F.lit("/data/"), c("page_id").cast("string"))).when(
        c("page_id") % 3 == 1, F.concat(F.lit("rel/"), c("page_id").cast("string")))
    return v.table("pages").select("page_id", tx.resolve_path("/root/set", p).alias("path"))


@query("frame_id_from_name", r"""SELECT page_id, CAST(nullif(regexp_extract(page_id || '_rgb.png', '^(\d+)', 1), '') AS BIGINT) AS lead,
 CAST(CASE WHEN regexp_extract(n, '_LOS_(\d+)_', 1) <> '' THEN regexp_extract(n, '_LOS_(\d+)_', 1) ELSE nullif(regexp_extract(n, '(\d+)(?:\.[^.]*)?$', 1), '') END AS BIGINT) AS inner_id
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'cam_LOS_' || page_id || '_x.txt' ELSE 'frame' || page_id || '.pcd' END AS n FROM pages)""")
def _(v):
    pid = c("page_id").cast("string")
    name = F.when(c("page_id") % 2 == 0, F.concat(F.lit("cam_LOS_"), pid, F.lit("_x.txt"))).otherwise(F.concat(F.lit("frame"), pid, F.lit(".pcd")))
    return v.table("pages").select("page_id", tx.leading_id(F.concat(pid, F.lit("_rgb.png"))).alias("lead"), tx.embedded_id(name).alias("inner_id"))


_CLEAN = r"trim(regexp_replace(translate(lower(raw), '_-', '  '), '\s+', ' ', 'g'))"
_RAW = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '__') ELSE upper(p_name) || ' -' END AS raw FROM part"


def raw_names(v):
    raw = F.when(c("p_partkey") % 2 == 0, F.regexp_replace("p_name", " ", "__")).otherwise(F.concat(F.upper("p_name"), F.lit(" -")))
    return v.table("part").select("p_partkey", "p_name", raw.alias("raw"))


@query("normalize_category", f"SELECT p_partkey, {_CLEAN} AS category FROM ({_RAW})")
def _(v):
    return raw_names(v).select("p_partkey", tx.normalize_category(c("raw")).alias("category"))


@query("class_map_join", f"""SELECT p_partkey, CASE WHEN cat IN ('small ring') THEN NULL WHEN cat LIKE '%widget' AND cat IN ('red widget', 'blue widget', 'small widget') THEN 'furniture' WHEN cat IN ('blue bolt', 'red bolt') THEN 'wall' ELSE 'clutter' END AS class FROM (SELECT p_partkey, {_CLEAN} AS cat FROM ({_RAW}))""")
def _(v):
    groups = {"furniture": ("red widget", "blue widget", "small widget"), "wall": ("blue bolt", "red bolt")}
    return raw_names(v).select("p_partkey", tx.map_category(c("raw"), groups, ("small ring",), "clutter").alias("class"))


@query("name_mapping", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'car' WHEN 'LARGE' THEN 'truck' WHEN 'PROMO' THEN 'bus' ELSE p_type END AS name FROM part")
def _(v):
    table = F.create_map(*[F.lit(t) for t in ("SMALL", "car", "LARGE", "truck", "PROMO", "bus")])
    return v.table("part").select("p_partkey", F.coalesce(table[c("p_type")], c("p_type")).alias("name"))


@query("keep_supported_classes_2d", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'car' ELSE 'truck' END AS name FROM part WHERE p_type IN ('SMALL', 'LARGE')")
def _(v):
    table = F.create_map(*[F.lit(t) for t in ("SMALL", "car", "LARGE", "truck")])
    return v.table("part").select("p_partkey", table[c("p_type")].alias("name")).where(c("name").isNotNull())


@query("generation_fingerprint", f"""WITH {MANIFEST}, r AS (SELECT scene_id, frame_id, sha256(concat_ws('|', token, CAST(timestamp AS VARCHAR))) AS h FROM manifest)
SELECT scene_id, sha256(sha256(string_agg(h, '|' ORDER BY frame_id))) AS digest FROM r GROUP BY scene_id""")
def _(v):
    row = F.concat_ws("|", "token", c("timestamp").cast("string"))
    return tx.group_digest(manifest(v), ["scene_id"], "frame_id", row)


@query("violation_message", f"WITH {MANIFEST} SELECT 'dataset=ev scene=' || scene_id || ' frame=' || frame_id || ' field=fx: focal length is not positive' AS text FROM manifest WHERE fx <= 0")
def _(v):
    rows = manifest(v).where(c("fx") <= 0)
    text = tx.violation_message(F.lit("ev"), c("scene_id"), c("frame_id"), F.lit("fx"), F.lit("focal length is not positive"))
    return rows.select(text.alias("text"))


# Sets -------------------------------------------------------------------------------------

@query("union_points", "SELECT frame_id, point_id FROM points WHERE time = 0 UNION ALL SELECT frame_id, point_id FROM points WHERE time > 0.3")
def _(v):
    pts = v.points()
    return pts.where(c("time") == 0).unionByName(pts.where(c("time") > 0.3)).select("frame_id", "point_id")


@query("union_boxes", "SELECT frame_id, box_id AS id FROM boxes UNION ALL SELECT frame_id, det_id FROM detections")
def _(v):
    return v.boxes().select("frame_id", c("box_id").alias("id")).unionByName(v.detections().select("frame_id", c("det_id").alias("id")))


@query("split_disjoint", "SELECT c_nationkey AS scene_id, count(DISTINCT c_custkey % 3) AS splits FROM customer WHERE c_custkey % 7 < c_nationkey % 3 GROUP BY 1 HAVING count(DISTINCT c_custkey % 3) > 1")
def _(v):
    rows = v.table("customer").where(c("c_custkey") % 7 < c("c_nationkey") % 3).select(
        c("c_nationkey").alias("scene_id"), (c("c_custkey") % 3).alias("split"))
    return ql.split_disjoint(rows)


@query("set_equality", "SELECT user_id AS key, 'left' AS side FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT user_id FROM events)")
def _(v):
    left = v.table("events").select(c("user_id").alias("key"))
    right = v.table("customer").where(c("c_custkey") % 3 != 0).select(c("c_custkey").alias("key"))
    return ql.set_differences(left, right, ["key"])


@query("missing_items", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(v):
    return v.table("customer").select("c_custkey").subtract(
        v.table("orders").where(c("o_orderpriority") == "1-URGENT").select(c("o_custkey").alias("c_custkey")))


@query("distinct_paths", "SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages")
def _(v):
    return v.table("pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path")).distinct()


@query("dedup_first", "SELECT path, min(page_id) AS page_id FROM (SELECT regexp_replace(url, '[?#].*$', '') AS path, page_id FROM pages) GROUP BY path")
def _(v):
    return v.table("pages").groupBy(F.regexp_replace("url", "[?#].*$", "").alias("path")).agg(F.min("page_id").alias("page_id"))


@query("collect_point_paths", "SELECT DISTINCT 'points/' || user_id || '/' || event_type || '.bin' AS path FROM events WHERE user_id % 5 = 0")
def _(v):
    keep = v.table("events").where(c("user_id") % 5 == 0)
    return keep.select(F.concat(F.lit("points/"), c("user_id").cast("string"), F.lit("/"), c("event_type"), F.lit(".bin")).alias("path")).distinct()


@query("concat_datasets", "SELECT 'a' AS dataset, frame_id, box_id FROM boxes WHERE frame_id % 2 = 0 UNION ALL SELECT 'b', frame_id, box_id FROM boxes WHERE frame_id % 2 = 1")
def _(v):
    a, b = (v.boxes().where(c("frame_id") % 2 == k).select(F.lit(n).alias("dataset"), "frame_id", "box_id") for k, n in ((0, "a"), (1, "b")))
    return a.unionByName(b)


@query("repeat_dataset", "SELECT CAST(k AS INTEGER) AS repeat, frame_id, box_id FROM boxes CROSS JOIN (SELECT unnest(range(3)) AS k)")
def _(v):
    return v.boxes().select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat"), "frame_id", "box_id")


@query("available_scenes", "SELECT DISTINCT user_id AS scene_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(v):
    listing = v.table("orders").where(c("o_orderpriority") == "1-URGENT").select(c("o_custkey").alias("scene_id"))
    return v.table("events").select(c("user_id").alias("scene_id")).distinct().join(listing, "scene_id", "left_semi")


@query("pair_frame_files", """WITH a AS (SELECT event_id AS stem FROM events WHERE event_id % 11 <> 0), b AS (SELECT event_id AS stem FROM events WHERE event_id % 13 <> 0), d AS (SELECT event_id AS stem FROM events WHERE event_id % 17 <> 0)
SELECT stem, a.stem IS NULL AS no_rgb, b.stem IS NULL AS no_depth, d.stem IS NULL AS no_label FROM a FULL JOIN b USING (stem) FULL JOIN d USING (stem)""")
def _(v):
    def side(n, flag):
        return v.table("events").where(c("event_id") % n != 0).select(c("event_id").alias("stem"), F.lit(True).alias(flag))
    out = side(11, "rgb").join(side(13, "depth"), "stem", "full").join(side(17, "label"), "stem", "full")
    return out.select("stem", *[c(f).isNull().alias(f"no_{f}") for f in ("rgb", "depth", "label")])


@query("pair_rgb_points", """WITH p AS (SELECT o_custkey AS fid, min(o_orderkey) AS file FROM orders GROUP BY 1), r AS (SELECT user_id AS fid, min(event_id) AS rgb FROM events GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY fid) - 1 AS BIGINT) AS frame_id, fid, rgb, file FROM p JOIN r USING (fid)""")
def _(v):
    pts = v.table("orders").groupBy(c("o_custkey").alias("fid")).agg(F.min("o_orderkey").alias("file"))
    rgb = v.table("events").groupBy(c("user_id").alias("fid")).agg(F.min("event_id").alias("rgb"))
    out = with_row_number(pts.join(rgb, "fid"), [], [c("fid")], F.expr("fid div 65536"), "rn")
    return out.select((c("rn") - 1).alias("frame_id"), "fid", "rgb", "file")


# Checks -----------------------------------------------------------------------------------

@query("check_token", f"WITH {MANIFEST} " + fault_sql("token <> 'ev:' || scene_id || ':' || lpad(CAST(frame_id AS VARCHAR), 6, '0')", "token", "token is not canonical"))
def _(v):
    want = tx.canonical_token(F.lit("ev"), c("scene_id"), c("frame_id"), strict=False)
    return ql.faults_where(manifest(v), ~c("token").eqNullSafe(want), "token", "token is not canonical")


@query("check_unique_tokens", f"WITH {MANIFEST} SELECT token, count(*) AS n FROM manifest GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return ql.duplicates(manifest(v), ["token"])


@query("check_unique_frames", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(v):
    return ql.duplicates(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_prev_token", f"""WITH {MANIFEST}, l AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY scene_id ORDER BY frame_id), '') AS want FROM manifest)
SELECT scene_id, frame_id, 'prev_token' AS field, 'previous token does not match' AS message FROM l
WHERE want <> CASE WHEN frame_id = 0 THEN '' ELSE 'ev:' || scene_id || ':' || lpad(CAST(frame_id - 1 AS VARCHAR), 6, '0') END""")
def _(v):
    stored = F.when(c("frame_id") == 0, "").otherwise(F.format_string("ev:%s:%06d", c("scene_id"), c("frame_id") - 1))
    rows = ix.with_prev_token(manifest(v).withColumn("stored", stored))
    return ql.faults_where(rows, c("prev_token") != c("stored"), "prev_token", "previous token does not match")


@query("check_paths", f"WITH {MANIFEST} " + " UNION ALL ".join([
    fault_sql("image_path IS NULL", "image_path", "path is missing"), fault_sql("image_path IN ('../x.png', '/abs/x.png')", "image_path", "path leaves the dataset root"),
    fault_sql("image_path LIKE 'images//%'", "image_path", "path is not canonical"),
    fault_sql("image_path NOT LIKE 'images//%' AND image_path NOT IN ('../x.png', '/abs/x.png') AND image_path IS NOT NULL AND CAST(regexp_extract(image_path, '([0-9]+)[.]png', 1) AS BIGINT) >= 80", "image_path", "file does not exist")]))
def _(v):
    listing = v.frames().where(c("frame_id") < 80).select(F.concat(F.lit("images/"), c("frame_id").cast("string"), F.lit(".png")).alias("path")).distinct()
    return ql.check_paths(manifest(v), "image_path", listing)


@query("check_intrinsics", f"WITH {MANIFEST} " + " UNION ALL ".join([
    fault_sql("fx <= 0 OR fy <= 0", "cam_intrinsic", "focal length is not positive"), fault_sql("NOT (cx >= 0 AND cx < 640 AND cy >= 0 AND cy < 480)", "cam_intrinsic", "principal point is outside the image")]))
def _(v):
    return ql.check_intrinsics(manifest(v), 640, 480)


@query("check_transforms", f"WITH {MANIFEST} " + " UNION ALL ".join([
    fault_sql("corner <> 1.0", "camera2base", "last row is not 0 0 0 1"), fault_sql("scale <> 1.0", "camera2base", "rotation is not orthonormal"), fault_sql("scale <> 1.0", "camera2base", "determinant is not +1")]))
def _(v):
    pose = la.yaw_pose(F.lit(0.0), F.lit(0.0), c("value"))
    pose = [[e * c("scale") for e in row[:3]] + [row[3]] for row in pose[:3]] + [[F.lit(0.0), F.lit(0.0), F.lit(0.0), c("corner")]]
    return ql.check_transforms(manifest(v).withColumn("camera2base", la.to_array(pose)), "camera2base")


@query("check_types", """SELECT CAST(user_id AS VARCHAR) AS scene_id, event_id AS frame_id, 'k' AS field, 'not an integer' AS message FROM events WHERE event_id % 10 IN (3, 4)
UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, 'pose_valid', 'not true' FROM events WHERE event_id % 7 = 0""")
def _(v):
    raw = F.when(c("event_id") % 10 == 3, F.lit('{"k": true')).when(c("event_id") % 10 == 4, F.lit('{"k": "5"')).otherwise(F.regexp_replace("props", "[}]", ""))
    text = F.concat(raw, F.lit(', "pose_valid": '), F.when(c("event_id") % 7 == 0, "1").otherwise("true"), F.lit("}"))
    rows = v.table("events").select(c("user_id").alias("scene_id"), c("event_id").alias("frame_id"), text.alias("json"))
    return ql.json_type_faults(rows, "json", "k", ql.JSON_INTEGER, "not an integer").unionByName(
        ql.json_type_faults(rows, "json", "pose_valid", ql.JSON_TRUE, "not true"))


@query("read_manifest", """SELECT event_id, CASE WHEN event_id % 9 IN (1, 2) THEN -1 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k,
CASE WHEN event_id % 9 = 1 THEN 'blank line' WHEN event_id % 9 = 2 THEN 'not an object' END AS fault FROM events""")
def _(v):
    line = F.when(c("event_id") % 9 == 1, "  ").when(c("event_id") % 9 == 2, "[1, 2]").otherwise(c("props"))
    rows = v.table("events").select("event_id", line.alias("value"))
    return st.parse_manifest(rows, "k bigint").select(
        "event_id", F.coalesce("record.k", F.lit(-1)).alias("k"), "fault")


@query("check_splits", """SELECT CAST(NULL AS VARCHAR) AS scene_id, 'splits' AS field, 'no such split' AS message FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) WHERE s NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'splits', 'scene belongs to several splits' FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1""")
def _(v):
    rows = v.table("customer").select(c("c_nationkey").alias("scene_id"), c("c_mktsegment").alias("split"))
    return ql.check_splits(rows, ("BUILDING", "MACHINERY", "AUTOMOBILE")).drop("frame_id")


META = """meta AS (SELECT s_suppkey AS dataset, CASE WHEN s_suppkey % 17 = 0 THEN 3 ELSE 4 END AS version, CASE WHEN s_suppkey % 19 = 0 THEN NULL ELSE 'floor,carpet' END AS classes FROM supplier)"""


def metadata(v):
    return v.table("supplier").select(
        c("s_suppkey").alias("dataset"), F.when(c("s_suppkey") % 17 == 0, 3).otherwise(4).alias("version"),
        F.when(c("s_suppkey") % 19 == 0, F.lit(None)).otherwise("floor,carpet").alias("classes"))


def contract(v):
    return v.table("supplier").select(c("s_suppkey").alias("dataset"), F.lit(4).alias("version"), F.lit("floor,carpet").alias("classes"))


_METASQL = f"WITH {META} SELECT dataset, 'version' AS field FROM meta WHERE version <> 4 UNION ALL SELECT dataset, 'classes' FROM meta WHERE classes IS NULL"


@query("check_metadata", _METASQL)
def _(v):
    return ql.field_differences(metadata(v), contract(v), ["dataset"], ["version", "classes"])


@query("check_index_metadata", f"WITH {META} SELECT dataset, 'version' AS field FROM meta WHERE version <> 4 UNION ALL SELECT dataset, 'classes' FROM meta WHERE classes IS NULL UNION ALL SELECT s_suppkey, 'missing left' FROM supplier WHERE false UNION ALL SELECT s_suppkey, 'split' FROM supplier WHERE s_nationkey % 5 = 0")
def _(v):
    split = F.when(c("s_nationkey") % 5 == 0, "val").otherwise("train")
    index = metadata(v).join(v.table("supplier").select(c("s_suppkey").alias("dataset"), split.alias("split")), "dataset")
    return ql.field_differences(index, contract(v).withColumn("split", F.lit("train")), ["dataset"], ["version", "classes", "split"])


@query("resume_guard", _METASQL)
def _(v):
    return ql.resume_guard(metadata(v), contract(v), ["dataset"], ["version", "classes"])


@query("check_scene_present", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS scene_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 4 = 1)")
def _(v):
    split = v.table("customer").where(c("c_nationkey") % 4 == 1).select(c("c_custkey").cast("string").alias("scene_id"))
    return v.table("events").select(c("user_id").cast("string").alias("scene_id")).distinct().join(split, "scene_id", "left_anti")


@query("check_binary_masks", """SELECT CAST(NULL AS VARCHAR) AS scene_id, frame_id, 'bev_mask_path' AS field, 'mask value is not 0 or 1' AS message FROM map_cells WHERE (row * 53 + col) % 997 = 5 GROUP BY frame_id
UNION ALL SELECT NULL, frame_id, 'bev_mask_path', 'cell is outside the mask' FROM map_cells WHERE row >= 25 GROUP BY frame_id""")
def _(v):
    cells = v.map_cells().withColumn("label", F.when((c("row") * 53 + c("col")) % 997 == 5, 2).otherwise(c("label")))
    return ql.check_binary_masks(cells, ROWS - 1, COLS)


@query("check_labels_observed", "SELECT frame_id, count(*) AS cells FROM map_cells m WHERE label = 1 AND NOT EXISTS (SELECT 1 FROM map_cells o WHERE o.observed = 1 AND o.frame_id = m.frame_id AND o.row = m.row AND o.col = m.col) GROUP BY frame_id")
def _(v):
    return ql.check_labels_observed(v.map_cells())


@query("check_points", """SELECT CAST(frame_id // 10 AS VARCHAR) AS scene_id, frame_id, 'lidar_path' AS field, 'byte length is not a multiple of the row size' AS message FROM (SELECT frame_id, count(*) * 20 + CASE WHEN frame_id % 31 = 0 THEN 4 ELSE 0 END AS len FROM rawpoints GROUP BY 1) WHERE len % 20 <> 0
UNION ALL SELECT CAST(frame_id // 10 AS VARCHAR), frame_id, 'lidar_path', 'points are not finite' FROM rawpoints WHERE l_partkey % 503 = 0 GROUP BY frame_id""")
def _(v):
    scene = F.expr("frame_id div 10").cast("string")
    files = v.rawpoints().groupBy("frame_id").agg((F.count("*") * 20 + F.max(F.when(c("frame_id") % 31 == 0, 4).otherwise(0))).alias("length"))
    pts = v.rawpoints().withColumns({"x": F.when(c("l_partkey") % 503 == 0, float("nan")).otherwise(c("x")), "scene_id": scene})
    return ql.check_points(files.withColumn("scene_id", scene), pts)


@query("check_counts", f"""WITH {STATS} SELECT frame_id, 'point_count' AS field FROM stats WHERE frame_id % 23 = 0 UNION ALL SELECT frame_id, 'observed_sum' FROM stats WHERE frame_id % 29 = 0 UNION ALL SELECT frame_id, 'missing right' FROM stats WHERE frame_id < 0""")
def _(v):
    actual = stats(v)
    stored = actual.withColumns({"point_count": F.when(c("frame_id") % 23 == 0, c("point_count") + 1).otherwise(c("point_count")),
                                 "observed_sum": F.when(c("frame_id") % 29 == 0, -1).otherwise(c("observed_sum"))})
    return ql.check_counts(stored, actual, ["point_count", "observed_sum"])


@query("check_raster_shape", "SELECT frame_id, max(v) + 1 AS height, max(u) + 1 AS width FROM pixels GROUP BY frame_id HAVING max(v) + 1 <> 48 OR max(u) + 1 <> 64")
def _(v):
    shape = v.pixels().groupBy("frame_id").agg((F.max("v") + 1).alias("height"), (F.max("u") + 1).alias("width"))
    return shape.where((c("height") != 48) | (c("width") != 64))


@query("check_semantic_map", """WITH m AS (SELECT p_partkey * 40 AS semantic_id, p_type AS class FROM part)
SELECT semantic_id, 'id out of range' AS message FROM m WHERE semantic_id > 65535 UNION ALL SELECT semantic_id, 'unknown class' FROM m WHERE class NOT IN ('SMALL', 'LARGE', 'PROMO', 'MEDIUM') UNION ALL SELECT semantic_id, 'mapped and ignored' FROM m WHERE semantic_id % 1000 = 0""")
def _(v):
    mapping = v.table("part").select((c("p_partkey") * 40).alias("semantic_id"), c("p_type").alias("class"))
    return ql.check_semantic_map(mapping, mapping.where(c("semantic_id") % 1000 == 0).select("semantic_id"), ("SMALL", "LARGE", "PROMO", "MEDIUM"))


_REC = "SELECT user_id AS scene_id, event_id AS frame_id, {f} AS field FROM events WHERE {w}"


@query("reconcile_manifest_index", " UNION ALL ".join(_REC.format(f=f"'{f}'", w=w) for f, w in (
    ("missing right", "event_id % 41 = 0 AND event_id % 43 <> 0"), ("missing left", "event_id % 43 = 0 AND event_id % 41 <> 0"), ("value", "event_id % 47 = 0 AND event_id % 41 <> 0 AND event_id % 43 <> 0"),
    ("event_type", "event_id % 37 = 0 AND event_id % 41 <> 0 AND event_id % 43 <> 0"))))
def _(v):
    base = v.table("events").select(c("user_id").alias("scene_id"), c("event_id").alias("frame_id"), "value", "event_type")
    left = base.where(c("frame_id") % 43 != 0)
    right = base.where(c("frame_id") % 41 != 0).withColumns({
        "value": F.when(c("frame_id") % 47 == 0, F.lit(None)).otherwise(c("value")),
        "event_type": F.when(c("frame_id") % 37 == 0, "other").otherwise(c("event_type"))})
    return ql.field_differences(left, right, ["scene_id", "frame_id"], ["value", "event_type"])


@query("artifact_set_check", """SELECT path, 'left' AS side FROM (SELECT url AS path FROM pages WHERE page_id % 5 <> 0 EXCEPT SELECT url FROM pages WHERE page_id % 7 <> 0)
UNION ALL SELECT path, 'right' FROM (SELECT url AS path FROM pages WHERE page_id % 7 <> 0 EXCEPT SELECT url FROM pages WHERE page_id % 5 <> 0)""")
def _(v):
    pages = v.table("pages").select(c("url").alias("path"), "page_id")
    return ql.set_differences(pages.where(c("page_id") % 5 != 0), pages.where(c("page_id") % 7 != 0), ["path"])


_SUMM = "SELECT user_id AS scene_id, count(*) AS frames, max(value) AS top FROM events GROUP BY 1"


@query("reconcile_summaries", f"SELECT scene_id, 'frames' AS field FROM ({_SUMM}) WHERE scene_id % 11 = 0 AND scene_id % 13 <> 5 UNION ALL SELECT scene_id, 'missing right' FROM ({_SUMM}) WHERE scene_id % 13 = 5")
def _(v):
    actual = v.table("events").groupBy(c("user_id").alias("scene_id")).agg(F.count("*").alias("frames"), F.max("value").alias("top"))
    stored = actual.where(c("scene_id") % 13 != 5).withColumn("frames", F.when(c("scene_id") % 11 == 0, c("frames") + 1).otherwise(c("frames")))
    return ql.field_differences(actual, stored, ["scene_id"], ["frames", "top"])


@query("check_summaries", f"SELECT scene_id, 'top' AS field FROM ({_SUMM}) WHERE scene_id % 9 = 0 UNION ALL SELECT scene_id, 'frames' FROM ({_SUMM}) WHERE scene_id % 8 = 0")
def _(v):
    actual = v.table("events").groupBy(c("user_id").alias("scene_id")).agg(F.count("*").alias("frames"), F.max("value").alias("top"))
    stored = actual.withColumns({"frames": F.when(c("scene_id") % 8 == 0, c("frames") - 1).otherwise(c("frames")),
                                 "top": F.when(c("scene_id") % 9 == 0, F.lit(None)).otherwise(c("top"))})
    return ql.field_differences(actual, stored, ["scene_id"], ["frames", "top"])


@query("check_frame_payload", f"WITH {MANIFEST} " + " UNION ALL ".join([
    fault_sql("fx <= 0 OR fy <= 0", "cam_intrinsic", "focal length is not positive"), fault_sql("NOT (cx >= 0 AND cx < 640 AND cy >= 0 AND cy < 480)", "cam_intrinsic", "principal point is outside the image"),
    fault_sql("image_path IS NULL", "image_path", "path is missing"), fault_sql("image_path IN ('../x.png', '/abs/x.png')", "image_path", "path leaves the dataset root"), fault_sql("image_path LIKE 'images//%'", "image_path", "path is not canonical")]))
def _(v):
    rows = manifest(v)
    return ql.union_faults(ql.check_intrinsics(rows, 640, 480), ql.check_paths(rows, "image_path"))


@query("validation_report", f"WITH {MANIFEST} SELECT split, count(*) AS frames, CAST(sum(CASE WHEN fx <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM manifest GROUP BY split")
def _(v):
    rows = manifest(v)
    return ql.validation_report(rows, rows.where(c("fx") <= 0))


@query("frame_quality_gate", f"WITH {STATS} SELECT frame_id, point_count >= 250 AND observed_sum >= 195 AS accepted FROM stats")
def _(v):
    ok = (c("point_count") >= 250) & (c("observed_sum") >= 195)
    return stats(v).select("frame_id", ok.alias("accepted"))


@query("failure_summary", f"WITH {STATS} SELECT frame_id // 10 AS scene_id, count(*) AS failed, min(frame_id) AS first_frame FROM stats WHERE point_count < 240 GROUP BY 1")
def _(v):
    return stats(v).where(c("point_count") < 240).groupBy(F.expr("frame_id div 10").alias("scene_id")).agg(
        F.count("*").alias("failed"), F.min("frame_id").alias("first_frame"))


@query("check_sequence", f"""WITH {MANIFEST}, l AS (SELECT scene_id, frame_id, CASE WHEN event_id % 97 = 0 THEN timestamp - 864000000000 ELSE timestamp END AS timestamp FROM manifest WHERE event_id % 89 <> 0),
 p AS (SELECT *, lag(frame_id) OVER w AS pf, lag(timestamp) OVER w AS pt FROM l WINDOW w AS (PARTITION BY scene_id ORDER BY frame_id))
{fault_sql('pf IS NULL AND frame_id <> 0', 'frame_id', 'first frame id is not 0', source='p')} UNION ALL {fault_sql('pf IS NOT NULL AND frame_id <> pf + 1', 'frame_id', 'frame ids are not contiguous', source='p')}
UNION ALL {fault_sql('timestamp <= pt', 'timestamp', 'timestamp does not grow', source='p')}""")
def _(v):
    rows = manifest(v).where(c("event_id") % 89 != 0).withColumn(
        "timestamp", F.when(c("event_id") % 97 == 0, c("timestamp") - 864000000000).otherwise(c("timestamp")))
    return wn.sequence_check(rows).select(*ql.FAULT)
