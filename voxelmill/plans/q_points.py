"""Queries: point and box predicates, voxel means, point functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.operators import points as pt
from voxelmill.operators import voxels as vx
from voxelmill.plans.registry import query, r6, rd
from voxelmill.schemas import Grid

c = F.col
RANGE3 = (0.0, -40.0, -2.0, 40.0, 40.0, 2.0)
VOXEL = vx.VoxelGrid((0.0, -51.2, -5.0, 51.2, 51.2, 3.0), (5.0, 5.0, 1.0))
K = [[100.0, 0.0, 50.0], [0.0, 100.0, 40.0], [0.0, 0.0, 1.0]]
IMAGE_H, IMAGE_W = 80, 100
GRID = Grid(0.0, 48.0, -48.0, 48.0, -2.0, 2.0, 1.5)

XYZ = f"{r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z"


def xyz():
    return [rd("x").alias("x"), rd("y").alias("y"), rd("z").alias("z")]


@query("select_dims", f"SELECT frame_id, {r6('x')} AS x, {r6('intensity')} AS intensity FROM rawpoints")
def _(v):
    return v.rawpoints().select("frame_id", rd("x").alias("x"), rd("intensity").alias("intensity"))


@query("points_in_range_3d", f"SELECT frame_id, {XYZ} FROM rawpoints "
       "WHERE x > 0 AND y > -40 AND z > -2 AND x < 40 AND y < 40 AND z < 2")
def _(v):
    return v.rawpoints().where(pt.in_range_3d(c("x"), c("y"), c("z"), RANGE3)).select("frame_id", *xyz())


@query("boxes_in_range_3d", "SELECT frame_id, box_id FROM boxes "
       "WHERE x > 0 AND y > -40 AND z > -2.5 AND x < 40 AND y < 40 AND z < 2")
def _(v):
    inside = pt.in_range_3d(c("x"), c("y"), c("z"), (0.0, -40.0, -2.5, 40.0, 40.0, 2.0))
    return v.boxes().where(inside).select("frame_id", "box_id")


@query("points_in_range_bev", f"""
SELECT 'lidar' AS mode, frame_id, {XYZ} FROM rawpoints WHERE x > 5 AND y > -20 AND x < 45 AND y < 20
UNION ALL SELECT 'camera', frame_id, {XYZ} FROM rawpoints WHERE x > 5 AND z > -1 AND x < 45 AND z < 1""")
def _(v):
    out = None
    for mode, rng in (("lidar", (5.0, -20.0, 45.0, 20.0)), ("camera", (5.0, -1.0, 45.0, 1.0))):
        a, b = pt.bev_axes(mode)
        part = (v.rawpoints().where(pt.in_range_bev(c(a), c(b), rng))
                .select(F.lit(mode).alias("mode"), "frame_id", *xyz()))
        out = part if out is None else out.unionByName(part)
    return out


@query("boxes_in_range_bev", "SELECT frame_id, box_id FROM boxes WHERE x > 5 AND y > -20 AND x < 45 AND y < 20")
def _(v):
    return (v.boxes().where(pt.in_range_bev(c("x"), c("y"), (5.0, -20.0, 45.0, 20.0)))
            .select("frame_id", "box_id"))


@query("points_range_filter", f"""
SELECT 'points' AS kind, frame_id, {XYZ} FROM rawpoints
WHERE x > 0 AND y > -40 AND z > -2 AND x < 40 AND y < 40 AND z < 2
UNION ALL SELECT 'radar', frame_id, {XYZ} FROM rawpoints WHERE x > -55 AND y > -55 AND x < 55 AND y < 55""")
def _(v):
    pts = v.rawpoints()
    lidar = pts.where(pt.in_range_3d(c("x"), c("y"), c("z"), RANGE3))
    radar = pts.where(pt.in_range_bev(c("x"), c("y"), (-55.0, -55.0, 55.0, 55.0)))
    return (lidar.select(F.lit("points").alias("kind"), "frame_id", *xyz())
            .unionByName(radar.select(F.lit("radar").alias("kind"), "frame_id", *xyz())))


@query("object_range_filter", f"""
SELECT frame_id, box_id, {r6('yaw - floor(yaw / (2 * pi()) + 0.5) * (2 * pi())', 5)} AS yaw
FROM boxes WHERE x > 0 AND y > -40 AND x < 40 AND y < 40""")
def _(v):
    return (v.boxes().where(pt.in_range_bev(c("x"), c("y"), (0.0, -40.0, 40.0, 40.0)))
            .select("frame_id", "box_id", rd(bx.limit_period(c("yaw"), 0.5, 2 * math.pi), 5).alias("yaw")))


@query("object_name_filter", "SELECT frame_id, box_id, name FROM boxes WHERE name IN ('SMALL', 'LARGE', 'PROMO')")
def _(v):
    return v.boxes().where(c("name").isin("SMALL", "LARGE", "PROMO")).select("frame_id", "box_id", "name")


@query("remove_close", f"SELECT frame_id, {XYZ} FROM rawpoints WHERE NOT (abs(x) < 20 AND abs(y) < 20)")
def _(v):
    return pt.remove_close(v.rawpoints(), 20.0).select("frame_id", *xyz())


def _band_sql(beams):
    tests = []
    for b in pt.BEAMS_KEPT[beams]:
        lo, hi = pt.beam_band(b)
        tests.append(f"(t > {lo!r}::DOUBLE AND t < {hi!r}::DOUBLE)")
    return " OR ".join(tests)


@query("reduce_beams", " UNION ALL ".join(f"""
SELECT CAST({n} AS INTEGER) AS beams, frame_id, {XYZ}
FROM (SELECT *, asin(z / sqrt(x * x + y * y + z * z)) AS t FROM rawpoints) WHERE {_band_sql(n)}""" for n in (16, 4, 1)))
def _(v):
    out = None
    for n in (16, 4, 1):
        part = pt.reduce_beams(v.rawpoints(), n).select(F.lit(n).alias("beams"), "frame_id", *xyz())
        out = part if out is None else out.unionByName(part)
    return out


def radar_points(v):
    """Points with radar attributes derived from their keys."""
    return v.rawpoints().select(
        "frame_id", "x", "y", "z", "intensity",
        (c("l_partkey") % 3).alias("invalid_state"), (c("l_suppkey") % 8).alias("dynprop"),
        (c("l_linenumber") % 5).cast("bigint").alias("ambig_state"),
        (c("l_partkey") % 11 - 5).cast("double").alias("vx"), (c("l_suppkey") % 9 - 4).cast("double").alias("vy"))


RADAR_SQL = """radar AS (SELECT frame_id, x, y, z, intensity, l_partkey % 3 AS invalid_state, l_suppkey % 8 AS dynprop,
  CAST(l_linenumber % 5 AS BIGINT) AS ambig_state, CAST(l_partkey % 11 - 5 AS DOUBLE) AS vx,
  CAST(l_suppkey % 9 - 4 AS DOUBLE) AS vy FROM rawpoints)"""


@query("radar_state_filter", f"""WITH {RADAR_SQL}
SELECT frame_id, {XYZ}, invalid_state, dynprop, ambig_state FROM radar
WHERE invalid_state = 0 AND dynprop IN (0, 1, 2, 3, 4, 5, 6) AND ambig_state = 3""")
def _(v):
    return pt.radar_states(radar_points(v)).select("frame_id", *xyz(), "invalid_state", "dynprop", "ambig_state")


@query("score_filter", "SELECT frame_id, det_id FROM detections WHERE score > 0.3")
def _(v):
    return v.detections().where(c("score") > 0.3).select("frame_id", "det_id")


@query("top_scores_keep", "SELECT frame_id, box_id FROM boxes WHERE score >= 0.5")
def _(v):
    return v.boxes().where(c("score") >= 0.5).select("frame_id", "box_id")


@query("post_center_range", """SELECT frame_id, det_id FROM detections
WHERE x BETWEEN 5 AND 45 AND y BETWEEN -40 AND 40 AND z BETWEEN -2 AND -1.75""")
def _(v):
    return v.detections().where(
        c("x").between(5.0, 45.0) & c("y").between(-40.0, 40.0) & c("z").between(-2.0, -1.75)
    ).select("frame_id", "det_id")


CLASS_RANGE = {"SMALL": 20.0, "LARGE": 50.0, "PROMO": 40.0, "ECONOMY": 30.0, "STANDARD": 35.0, "MEDIUM": 45.0}


@query("class_range_filter", f"""SELECT frame_id, det_id, name FROM detections JOIN
(VALUES {', '.join(f"('{k}', {x}::DOUBLE)" for k, x in CLASS_RANGE.items())}) AS lim(cls, r) ON name = cls
WHERE sqrt(x * x + y * y) <= r""")
def _(v):
    limits = F.create_map(*[F.lit(t) for kv in CLASS_RANGE.items() for t in kv])
    return (v.detections().where(F.sqrt(c("x") * c("x") + c("y") * c("y")) <= limits[c("name")])
            .select("frame_id", "det_id", "name"))


@query("nonempty_boxes", "SELECT frame_id, box_id FROM boxes WHERE dx > 2.5 AND dy > 2.5 AND dz > 2.5")
def _(v):
    return (v.boxes().where((c("dx") > 2.5) & (c("dy") > 2.5) & (c("dz") > 2.5)).select("frame_id", "box_id"))


@query("region_membership", f"SELECT frame_id, {XYZ} FROM rawpoints WHERE x BETWEEN 10 AND 30 AND y BETWEEN -10 AND 10")
def _(v):
    return v.rawpoints().where(pt.region_membership(c("x"), c("y"), (10.0, 30.0, -10.0, 10.0))).select("frame_id", *xyz())


@query("keyframe_points", f"SELECT frame_id, {XYZ} FROM rawpoints WHERE time = 0")
def _(v):
    return v.rawpoints().where(c("time") == 0).select("frame_id", *xyz())


# LiDAR to camera swap, then projection with K: u = (100 * -y + 50 * x) / x, v = (100 * -z + 40 * x) / x.
PROJ = "SELECT *, (-y * 100.0 + x * 50.0) / x AS u, (-z * 100.0 + x * 40.0) / x AS v, x AS depth FROM rawpoints"


def projected(v, floor=None):
    cx, cy, cz = pt.lidar_to_camera(c("x"), c("y"), c("z"))
    u, w, d = pt.project(cx, cy, cz, K, floor)
    return v.rawpoints().withColumns({"u": u, "v": w, "depth": d})


@query("frustum_filter", f"""SELECT frame_id, {XYZ} FROM ({PROJ})
WHERE u >= 0 AND u < 100 AND v >= 0 AND v < 80 AND depth > 2 AND depth < 40""")
def _(v):
    near_far = (c("depth") > 2) & (c("depth") < 40)
    return (projected(v).where(pt.image_visible(c("u"), c("v"), c("depth"), IMAGE_H, IMAGE_W) & near_far)
            .select("frame_id", *xyz()))


@query("image_bounds_filter", f"""SELECT frame_id, {r6('u', 5)} AS u, {r6('v', 5)} AS v, {r6('depth')} AS depth FROM ({PROJ})
WHERE u >= 0 AND u < 100 AND v >= 0 AND v < 80 AND depth > 0""")
def _(v):
    return (projected(v).where(pt.image_visible(c("u"), c("v"), c("depth"), IMAGE_H, IMAGE_W))
            .select("frame_id", rd("u", 5).alias("u"), rd("v", 5).alias("v"), rd("depth").alias("depth")))


@query("lidar_to_image", f"""SELECT frame_id, {r6('(-y * 100.0 + x * 50.0) / greatest(x, 1e-8)', 5)} AS u,
{r6('(-z * 100.0 + x * 40.0) / greatest(x, 1e-8)', 5)} AS v FROM rawpoints""")
def _(v):
    return projected(v, 1e-8).select("frame_id", rd("u", 5).alias("u"), rd("v", 5).alias("v"))


@query("depth_valid", "SELECT frame_id, v, u, depth_mm FROM pixels WHERE depth_mm > 0 AND depth_mm < 8000")
def _(v):
    metres = c("depth_mm") / 1000.0
    return (v.pixels().where(~F.isnan(metres) & (metres > 0) & (metres < 8.0))
            .select("frame_id", "v", "u", "depth_mm"))


@query("valid_flag", """SELECT frame_id, box_id, (p_size % 4) + (p_partkey % 3) > 0 AS valid_flag
FROM (SELECT p_partkey // 8 AS frame_id, p_partkey % 8 AS box_id, p_size, p_partkey FROM part)""")
def _(v):
    return v.table("part").select(
        F.expr("p_partkey div 8").alias("frame_id"), (c("p_partkey") % 8).alias("box_id"),
        ((c("p_size") % 4) + (c("p_partkey") % 3) > 0).alias("valid_flag"))


@query("filter_empty_gt", "SELECT DISTINCT frame_id FROM boxes WHERE name IN ('SMALL', 'LARGE')")
def _(v):
    known = v.boxes().where(c("name").isin("SMALL", "LARGE")).select("frame_id")
    return v.boxes().select("frame_id").distinct().join(known, "frame_id", "left_semi")


@query("visibility_filter", "SELECT event_id, event_type FROM events WHERE CAST(event_id % 5 AS VARCHAR) IN ('', '1', '2', '3')")
def _(v):
    level = (c("event_id") % 5).cast("string")
    return v.table("events").where(level.isin("", "1", "2", "3")).select("event_id", "event_type")


@query("normalize_intensity", f"SELECT frame_id, {r6('x')} AS x, {r6('tanh(intensity)')} AS intensity FROM rawpoints")
def _(v):
    return v.rawpoints().select("frame_id", rd("x").alias("x"), rd(F.tanh("intensity")).alias("intensity"))


@query("rotate_points", f"SELECT frame_id, {r6('x * cos(0.3) - y * sin(0.3)')} AS x, {r6('x * sin(0.3) + y * cos(0.3)')} AS y FROM rawpoints")
def _(v):
    x, y = bx.rotate_points(c("x"), c("y"), F.lit(0.3))
    return v.rawpoints().select("frame_id", rd(x).alias("x"), rd(y).alias("y"))


@query("translate", f"SELECT frame_id, {r6('x + 1.5')} AS x, {r6('y - 2.5')} AS y, {r6('z + 0.25')} AS z FROM rawpoints")
def _(v):
    return v.rawpoints().select("frame_id", rd(c("x") + 1.5).alias("x"), rd(c("y") - 2.5).alias("y"), rd(c("z") + 0.25).alias("z"))


@query("scale", f"SELECT frame_id, {r6('x * 1.05')} AS x, {r6('y * 1.05')} AS y, {r6('z * 1.05')} AS z FROM rawpoints")
def _(v):
    return v.rawpoints().select("frame_id", *[rd(c(k) * 1.05).alias(k) for k in "xyz"])


@query("flip_points", f"""SELECT 'horizontal' AS direction, frame_id, {r6('x')} AS x, {r6('-y')} AS y FROM rawpoints
UNION ALL SELECT 'vertical', frame_id, {r6('-x')}, {r6('y')} FROM rawpoints""")
def _(v):
    pts = v.rawpoints()
    hor = pts.select(F.lit("horizontal").alias("direction"), "frame_id", rd("x").alias("x"), rd(-c("y")).alias("y"))
    ver = pts.select(F.lit("vertical").alias("direction"), "frame_id", rd(-c("x")).alias("x"), rd("y").alias("y"))
    return hor.unionByName(ver)


@query("radar_rotate", f"""WITH {RADAR_SQL}
SELECT frame_id, {r6('x * cos(0.3) - y * sin(0.3)')} AS x, {r6('x * sin(0.3) + y * cos(0.3)')} AS y,
{r6('vx * cos(0.3) - vy * sin(0.3)')} AS vx, {r6('vx * sin(0.3) + vy * cos(0.3)')} AS vy FROM radar""")
def _(v):
    x, y = bx.rotate_points(c("x"), c("y"), F.lit(0.3))
    vx_, vy_ = bx.rotate_points(c("vx"), c("vy"), F.lit(0.3))
    return radar_points(v).select("frame_id", *[rd(e).alias(n) for e, n in ((x, "x"), (y, "y"), (vx_, "vx"), (vy_, "vy"))])


@query("radar_flip", f"""WITH {RADAR_SQL}
SELECT frame_id, {r6('x')} AS x, {r6('-y')} AS y, {r6('vx')} AS vx, {r6('-vy')} AS vy FROM radar""")
def _(v):
    return radar_points(v).select("frame_id", rd("x").alias("x"), rd(-c("y")).alias("y"), rd("vx").alias("vx"), rd(-c("vy")).alias("vy"))


@query("radar_scale", f"""WITH {RADAR_SQL}
SELECT frame_id, {r6('x * 0.95')} AS x, {r6('y * 0.95')} AS y, {r6('vx * 0.95')} AS vx, {r6('vy * 0.95')} AS vy FROM radar""")
def _(v):
    return radar_points(v).select("frame_id", *[rd(c(k) * 0.95).alias(k) for k in ("x", "y", "vx", "vy")])


@query("radar_encoding", f"""WITH {RADAR_SQL}
SELECT frame_id, {r6('x')} AS x, {", ".join(f"CAST(dynprop = {i} AS INTEGER) AS dynprop_{i}" for i in range(8))},
CAST(ambig_state + 1 AS BIGINT) AS ambig_rank, CAST(invalid_state = 0 AND ambig_state = 3 AS INTEGER) AS usable,
{r6('(vx - 0.5) / 2.5')} AS vx FROM radar""")
def _(v):
    return radar_points(v).select(
        "frame_id", rd("x").alias("x"), *pt.one_hot(c("dynprop"), range(8), "dynprop_"),
        (c("ambig_state") + 1).alias("ambig_rank"),
        ((c("invalid_state") == 0) & (c("ambig_state") == 3)).cast("int").alias("usable"),
        rd(pt.normalise_feature(c("vx"), 0.5, 2.5)).alias("vx"))


@query("depth_to_points", f"""SELECT frame_id, v, u, {r6('d')} AS x, {r6('-((u - 31.5) * d / 60.0)')} AS y,
{r6('-((v - 23.5) * d / 60.0) + 0.7')} AS z, semantic_id FROM (SELECT *, depth_mm / 1000.0::DOUBLE AS d FROM pixels) WHERE depth_mm > 0""")
def _(v):
    depth = c("depth_mm") / 1000.0
    cam = pt.back_project(c("u"), c("v"), depth, 60.0, 60.0, 31.5, 23.5)
    x, y, z = pt.camera_to_base(*cam, mount=(0.0, 0.0, 0.7))
    return v.pixels().where(c("depth_mm") > 0).select(
        "frame_id", "v", "u", rd(x).alias("x"), rd(y).alias("y"), rd(z).alias("z"), "semantic_id")


@query("bev_cell_index", """SELECT frame_id, greatest(least(CAST(floor(x / 1.5) AS BIGINT), 31), 0) AS row,
greatest(least(CAST(floor((y + 48.0) / 1.5) AS BIGINT), 63), 0) AS col,
(x >= 0 AND x < 48 AND y >= -48 AND y < 48 AND z > -2 AND z < 2) AS valid FROM rawpoints""")
def _(v):
    row, col, valid = pt.bev_cell(c("x"), c("y"), c("z"), GRID)
    return v.rawpoints().select("frame_id", row.alias("row"), col.alias("col"), valid.alias("valid"))


@query("rasterize_semantics", """SELECT DISTINCT frame_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id,
CAST(floor(x / 1.5) AS BIGINT) AS row, CAST(floor((y + 48.0) / 1.5) AS BIGINT) AS col FROM rawpoints
WHERE x >= 0 AND x < 48 AND y >= -48 AND y < 48 AND z > -2 AND z < 2""")
def _(v):
    row, col, valid = pt.bev_cell(c("x"), c("y"), c("z"), GRID)
    cls = F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
    return (v.rawpoints().where(valid)
            .select("frame_id", cls.alias("class_id"), row.alias("row"), col.alias("col")).distinct())


@query("rasterize_point_mask", """SELECT DISTINCT frame_id, CAST(floor(x / 1.5) AS BIGINT) AS row,
CAST(floor((y + 48.0) / 1.5) AS BIGINT) AS col FROM rawpoints
WHERE x >= 0 AND x < 48 AND y >= -48 AND y < 48 AND z > -2 AND z < 2""")
def _(v):
    row, col, valid = pt.bev_cell(c("x"), c("y"), c("z"), GRID)
    return v.rawpoints().where(valid).select("frame_id", row.alias("row"), col.alias("col")).distinct()


@query("sensor_ray_exit", f"""SELECT frame_id, box_id, {r6('''least(
 CASE WHEN cos(yaw) > 0 THEN (48.0 - 24.0) / cos(yaw) WHEN cos(yaw) < 0 THEN (0.0 - 24.0) / cos(yaw) END,
 CASE WHEN sin(yaw) > 0 THEN (48.0 - 0.0) / sin(yaw) WHEN sin(yaw) < 0 THEN (-48.0 - 0.0) / sin(yaw) END)''', 4)} AS distance FROM boxes""")
def _(v):
    d = pt.ray_exit(F.cos("yaw"), F.sin("yaw"), F.lit(24.0), F.lit(0.0), GRID)
    return v.boxes().select("frame_id", "box_id", rd(d, 4).alias("distance"))


@query("height_expand", f"""SELECT frame_id, {r6('x')} AS x, {r6('y')} AS y, 0.25::DOUBLE * k AS z
FROM rawpoints CROSS JOIN (SELECT unnest(range(1, 9)) AS k)""")
def _(v):
    return v.rawpoints().select("frame_id", rd("x").alias("x"), rd("y").alias("y"),
                                F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")) \
        .select("frame_id", "x", "y", (F.lit(0.25) * c("k")).alias("z"))
