"""Queries: rasters, heat maps, lattices, top-k over cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import coders as cd
from voxelmill.operators import points as pt
from voxelmill.operators import raster as rs
from voxelmill.operators import topk as tk
from voxelmill.plans import sqlrand as sr
from voxelmill.plans.q_boxes import _corner_sql
from voxelmill.plans.q_points import GRID, K, PROJ
from voxelmill.plans.registry import query, r6, rd
from voxelmill.schemas import Grid

c = F.col
ROWS, COLS = 26, 53
KEYS = ["frame_id", "class_id"]
OFF = "(SELECT unnest([-1, 0, 1]) AS dr) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dc)"
TRUTH = "truth AS MATERIALIZED (SELECT frame_id, class_id, row, col FROM map_cells WHERE label = 1)"
GROWN = f"grown AS MATERIALIZED (SELECT DISTINCT frame_id, class_id, row + dr AS row, col + dc AS col FROM truth CROSS JOIN {OFF} WHERE row + dr BETWEEN 0 AND {ROWS - 1} AND col + dc BETWEEN 0 AND {COLS - 1})"
# Cells with an in-grid neighbour that is not set: fewer set neighbours than the grid has there.
EXPOSED = f"""exposed AS MATERIALIZED (SELECT t.frame_id, t.class_id, t.row, t.col FROM truth t CROSS JOIN {OFF}
  JOIN truth n ON n.frame_id = t.frame_id AND n.class_id = t.class_id AND n.row = t.row + dr AND n.col = t.col + dc
  GROUP BY t.frame_id, t.class_id, t.row, t.col
  HAVING count(*) < (3 - CAST(t.row = 0 AS INTEGER) - CAST(t.row = {ROWS - 1} AS INTEGER)) * (3 - CAST(t.col = 0 AS INTEGER) - CAST(t.col = {COLS - 1} AS INTEGER)))"""


def truth(v):
    return v.map_cells().where(c("label") == 1).select(*KEYS, "row", "col")


def blobs(v):
    """Truth cells grown by one cell, so that erosion leaves something."""
    return rs.dilate(truth(v), KEYS, 1, ROWS, COLS)


@query("dilate_cells", f"WITH {TRUTH}, {GROWN} SELECT * FROM grown")
def _(v):
    return blobs(v)


@query("erode_cells", f"WITH {TRUTH}, {GROWN}, {EXPOSED.replace('truth', 'grown')} SELECT * FROM grown ANTI JOIN exposed USING (frame_id, class_id, row, col)")
def _(v):
    return rs.erode(blobs(v), KEYS, 1, ROWS, COLS)


@query("cell_boundary", f"WITH {TRUTH}, {GROWN}, {EXPOSED.replace('truth', 'grown')} SELECT * FROM exposed")
def _(v):
    return rs.cell_boundary(blobs(v), KEYS, ROWS, COLS)


EDGE = """edge AS (SELECT DISTINCT a.frame_id, a.v AS row, a.u AS col FROM pixels a JOIN pixels b ON a.frame_id = b.frame_id AND abs(a.v - b.v) + abs(a.u - b.u) = 1 AND a.semantic_id <> b.semantic_id)"""
EDGE2 = f"edge2 AS (SELECT DISTINCT frame_id, row + dr AS row, col + dc AS col FROM edge CROSS JOIN {OFF} WHERE row + dr BETWEEN 0 AND 47 AND col + dc BETWEEN 0 AND 63)"


@query("semantic_boundary", f"WITH {EDGE}, {EDGE2} SELECT * FROM edge2")
def _(v):
    return rs.semantic_boundary(v.pixels(), 1, 48, 64)


@query("trusted_pixels", f"WITH {EDGE} SELECT frame_id, v, u FROM pixels p WHERE semantic_id <> 5 AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.frame_id = p.frame_id AND e.row = p.v AND e.col = p.u)")
def _(v):
    px = v.pixels()
    return rs.trusted_pixels(px, c("semantic_id") != 5, rs.semantic_boundary(px, 0, 48, 64)).select("frame_id", "v", "u")


FAR = """far AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, bin ORDER BY range DESC, point_id) AS r FROM (
  SELECT frame_id, point_id, x AS dx, y - 2.0 AS dy, sqrt(x * x + (y - 2.0) * (y - 2.0)) AS range, CAST(round_even(atan2(y - 2.0, x) / radians(0.5), 0) AS BIGINT) AS bin FROM points)) WHERE r = 1)"""


@query("farthest_per_azimuth", f"WITH {FAR} SELECT frame_id, bin, point_id, {r6('range', 5)} AS range FROM far")
def _(v):
    return rs.farthest_per_azimuth(v.points(), (0.0, 2.0)).select("frame_id", "bin", "point_id", rd("range", 5).alias("range"))


@query("observed_rays", f"""WITH {FAR}, ray AS (SELECT frame_id, dx * (k / (n - 1)) + 0.0 AS x, dy * (k / (n - 1)) + 2.0 AS y
 FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, CAST(greatest(ceil(range / 0.75) + 1, 2) AS BIGINT) AS n FROM far)))
SELECT DISTINCT frame_id, CAST(floor(x / 1.5) AS BIGINT) AS row, CAST(floor((y + 48.0) / 1.5) AS BIGINT) AS col FROM ray WHERE x >= 0 AND x < 48 AND y >= -48 AND y < 48""")
def _(v):
    return rs.observed_rays(v.points(), (0.0, 2.0), GRID)


@query("depth_map", f"""SELECT frame_id, v, u, {r6('min(depth)', 5)} AS depth FROM (SELECT frame_id, CAST(floor(v) AS BIGINT) AS v, CAST(floor(u) AS BIGINT) AS u, greatest(depth, 1e-5) AS depth FROM ({PROJ}))
WHERE u BETWEEN 0 AND 99 AND v BETWEEN 0 AND 79 GROUP BY frame_id, v, u""")
def _(v):
    pts = v.rawpoints().withColumn("point_id", F.lit(0))
    u, w, d = pt.project(*pt.lidar_to_camera(c("x"), c("y"), c("z")), K)
    return rs.depth_map(pts, u, w, d, 80, 100).select("frame_id", "v", "u", rd("depth", 5).alias("depth"))


@query("depth_downsample", f"""WITH b AS (SELECT frame_id, v // 8 AS row, u // 8 AS col, min(depth_mm) / 1000.0::DOUBLE AS depth FROM pixels WHERE depth_mm > 0 GROUP BY ALL)
SELECT frame_id, row, col, {r6('depth', 5)} AS depth, CAST(CASE WHEN (depth - 0.5) / 0.5 >= 0 AND (depth - 0.5) / 0.5 < 11 THEN trunc((depth - 0.5) / 0.5) ELSE 0 END AS BIGINT) AS bin FROM b""")
def _(v):
    return rs.depth_downsample(v.pixels(), 8, 1.0, 0.5, 10).withColumn("depth", rd("depth", 5))


@query("bev_resample", f"""WITH o AS (SELECT i, (4.0 + (i + 0.5) * 3.0 - 0.0) / 2.0 - 0.5 AS s FROM (SELECT unnest(range(12)) AS i)), p AS (SELECT i, (-30.0 + (i + 0.5) * 3.0 + 50.0) / 2.0 - 0.5 AS s FROM (SELECT unnest(range(20)) AS i)),
 w AS (SELECT frame_id, class_id, o.i AS row, p.i AS col, greatest(1 - abs(o.s - m.row), 0) * greatest(1 - abs(p.s - m.col), 0) AS w, score FROM map_cells m JOIN o ON abs(o.s - m.row) < 1 JOIN p ON abs(p.s - m.col) < 1)
SELECT frame_id, class_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, {r6('sum(w * score)', 5)} AS score FROM w WHERE w > 0 GROUP BY frame_id, class_id, row, col""")
def _(v):
    out = rs.bev_resample(v.map_cells(), KEYS, "score", ((0.0, 52.0, 2.0), (-50.0, 56.0, 2.0)), ((4.0, 40.0, 3.0), (-30.0, 30.0, 3.0)))
    return out.withColumn("score", rd("score", 5))


_RAD = """least((l + w + sqrt((l + w) ** 2 - 4 * (w * l * 0.9 / 1.1))) / 2, (2 * (l + w) + sqrt(4 * (l + w) ** 2 - 16 * (0.9 * w * l))) / 2,
 (-0.2 * (l + w) + sqrt(0.04 * (l + w) ** 2 + 0.4 * 4 * 0.9 * w * l)) / 2)"""
TARGETS = f"""targets AS (SELECT *, CAST(trunc(u) AS BIGINT) AS cu, CAST(trunc(v) AS BIGINT) AS cv, greatest(CAST(trunc({_RAD}) AS BIGINT), 2) AS radius FROM (
  SELECT *, (x - 0.0) / 0.8 AS u, (y + 51.2) / 0.8 AS v, dy / 0.8 AS l, dx / 0.8 AS w FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box_id) AS slot FROM boxes) WHERE slot <= 6)
  WHERE trunc(u) BETWEEN 0 AND 59 AND trunc(v) BETWEEN 0 AND 127)"""


def targets(v):
    return rs.heat_targets(v.boxes(), (0.0, -51.2), 0.1, 8, (60, 128), 0.1, 2, 6)


@query("draw_gaussian", f"""WITH {TARGETS}, disc AS (SELECT frame_id, name, cu + a AS row, cv + b AS col, exp(-(a * a + b * b) / (2 * ((2 * radius + 1) / 6.0) ** 2)) AS heat
 FROM (SELECT *, unnest(range(-radius, radius + 1)) AS b FROM (SELECT *, unnest(range(-radius, radius + 1)) AS a FROM targets)))
SELECT frame_id, name, row, col, {r6('max(heat)', 5)} AS heat FROM disc WHERE row BETWEEN 0 AND 59 AND col BETWEEN 0 AND 127 GROUP BY ALL""")
def _(v):
    return rs.draw_gaussian(targets(v), (60, 128)).withColumn("heat", rd("heat", 5))


@query("center_targets", f"""WITH {TARGETS} SELECT frame_id, box_id, cu * 128 + cv AS ind, {r6('u - cu', 5)} AS off_u, {r6('v - cv', 5)} AS off_v, {r6('ln(dy)', 5)} AS ldy, {r6('sin(yaw)', 5)} AS sin_yaw, {r6('vx', 5)} AS vx FROM targets""")
def _(v):
    return rs.centre_targets(targets(v)).select("frame_id", "box_id", "ind", *[rd(k, 5).alias(k) for k in ("off_u", "off_v", "ldy", "sin_yaw", "vx")])


@query("max_objs_limit", "SELECT frame_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box_id) AS r FROM boxes) WHERE r <= 5")
def _(v):
    return tk.top_per_group(v.boxes(), ["frame_id"], [c("box_id")], 5).select("frame_id", "box_id")


@query("flatten_by_priority", "SELECT frame_id, row, col, CAST(arg_max(class_id, [5, 9, 2][class_id + 1]) AS INTEGER) AS class_id FROM map_cells WHERE score > 0.4 GROUP BY frame_id, row, col")
def _(v):
    priority = F.array(F.lit(5), F.lit(9), F.lit(2))[c("class_id")]
    return rs.flatten_by_priority(v.map_cells(), 0.4, priority)


@query("missing_region_cells", """SELECT frame_id, CAST(r AS BIGINT) AS row, CAST(q AS BIGINT) AS col FROM (SELECT DISTINCT frame_id FROM rawpoints) CROSS JOIN (SELECT unnest(range(26)) AS r) CROSS JOIN (SELECT unnest(range(53)) AS q)
WHERE (r + 0.5) * 2 BETWEEN 10 AND 30 AND (q + 0.5) * 2 - 50 BETWEEN -10 AND 20""")
def _(v):
    frames = v.rawpoints().select("frame_id").distinct()
    return rs.missing_region(frames, Grid(0.0, 52.0, -50.0, 56.0, -9.0, 9.0, 2.0), (10.0, 30.0, -10.0, 20.0))


@query("flip_cells", "SELECT frame_id, class_id, 25 - row AS row, 52 - col AS col FROM map_cells WHERE label = 1")
def _(v):
    return truth(v).select("frame_id", "class_id", (ROWS - 1 - c("row")).alias("row"), (COLS - 1 - c("col")).alias("col"))


@query("merge_map_layers", "SELECT DISTINCT frame_id, CASE class_id WHEN 0 THEN 'divider' WHEN 1 THEN 'divider' ELSE 'area' END AS class, row, col FROM map_cells WHERE label = 1")
def _(v):
    layer_class = F.create_map(*[F.lit(t) for t in (0, "divider", 1, "divider", 2, "area")])
    return truth(v).select("frame_id", layer_class[c("class_id")].alias("class"), "row", "col").distinct()


@query("effective_supervision", "SELECT frame_id, class_id, row, col FROM map_cells WHERE observed = 1 AND supervised = 1 AND class_id <> 2")
def _(v):
    validity = F.array(F.lit(1), F.lit(1), F.lit(0))
    cells = v.map_cells().withColumn("mask", c("observed") * validity[c("class_id")] * c("supervised"))
    return cells.where(c("mask") == 1).select("frame_id", "class_id", "row", "col")


@query("mask_labels", """SELECT frame_id, class_id, row, col FROM map_cells m WHERE label = 1 AND observed = 1
AND NOT EXISTS (SELECT 1 FROM map_cells u WHERE u.score > 0.9 AND u.frame_id = m.frame_id AND u.row = m.row AND u.col = m.col)""")
def _(v):
    cells = v.map_cells()
    uncertain = cells.where(c("score") > 0.9).select("frame_id", "row", "col")
    labels = cells.where((c("label") == 1) & (c("observed") == 1))
    return labels.join(uncertain, ["frame_id", "row", "col"], "left_anti").select("frame_id", "class_id", "row", "col")


@query("coverage", f"SELECT frame_id, {r6('sum(label) / greatest(count(*), 1)', 5)} AS semantic, {r6('sum(observed) / greatest(count(*), 1)', 5)} AS observed FROM map_cells GROUP BY frame_id")
def _(v):
    n = F.greatest(F.count("*"), F.lit(1))
    return v.map_cells().groupBy("frame_id").agg(
        rd(F.sum("label") / n, 5).alias("semantic"), rd(F.sum("observed") / n, 5).alias("observed"))


@query("union_views", """SELECT DISTINCT frame_id, row, col FROM (SELECT frame_id, row, col FROM map_cells WHERE observed = 1 UNION ALL SELECT frame_id, row, col FROM map_cells WHERE supervised = 1)""")
def _(v):
    cells = v.map_cells()
    views = [cells.where(c(m) == 1).select("frame_id", "row", "col") for m in ("observed", "supervised")]
    return views[0].unionByName(views[1]).distinct()


@query("local_peak", f"""SELECT frame_id, class_id, row, col, {r6('score', 5)} AS score FROM map_cells m WHERE class_id = 2 OR (row BETWEEN 1 AND {ROWS - 2} AND col BETWEEN 1 AND {COLS - 2}
AND NOT EXISTS (SELECT 1 FROM map_cells n WHERE n.frame_id = m.frame_id AND n.class_id = m.class_id AND abs(n.row - m.row) <= 1 AND abs(n.col - m.col) <= 1 AND n.score > m.score))""")
def _(v):
    return rs.local_peaks(v.map_cells(), 1, ROWS, COLS, single=(2,)).withColumn("score", rd("score", 5))


FLAT = f"CAST((class_id * {ROWS} + row) * {COLS} + col AS BIGINT)"


@query("top_proposals", f"""SELECT frame_id, class_id, ind, CAST(r AS INTEGER) AS rank FROM (SELECT frame_id, class_id, row * {COLS} + col AS ind, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, {FLAT}) AS r FROM map_cells) WHERE r <= 20""")
def _(v):
    return tk.top_proposals(v.map_cells(), 20, ROWS, COLS)


_TOPK = f"""SELECT frame_id, class_id, ind, score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, class_id, ind) AS r FROM (
 SELECT frame_id, class_id, row * {COLS} + col AS ind, score, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY score DESC, row * {COLS} + col) AS q FROM map_cells) WHERE q <= 10"""


@query("two_stage_topk", f"""SELECT frame_id, class_id, ind, CAST(r AS INTEGER) AS rank, ind // {COLS} AS xs, ind % {COLS} AS ys FROM ({_TOPK}) WHERE r <= 10""")
def _(v):
    return tk.two_stage_topk(v.map_cells(), 10, COLS).select("frame_id", "class_id", "ind", "rank", "xs", "ys")


@query("center_decode", f"""SELECT frame_id, class_id, CAST(r AS INTEGER) AS rank, {r6('(ind // 53 + 0.5) * 2.0 + 0.0', 5)} AS x, {r6('(ind % 53 + 0.5) * 2.0 - 50.0', 5)} AS y, {r6('score', 5)} AS score FROM ({_TOPK}) WHERE r <= 10
AND score > 0.95 AND (ind // 53 + 0.5) * 2.0 BETWEEN 3 AND 45 AND (ind % 53 + 0.5) * 2.0 - 50.0 BETWEEN -40 AND 40""")
def _(v):
    top = tk.two_stage_topk(v.map_cells(), 10, COLS).withColumns({
        "cu": c("xs") + 0.5, "cv": c("ys") + 0.5, "cz": F.lit(0.0), "ldx": F.lit(0.0), "ldy": F.lit(0.0), "ldz": F.lit(0.0),
        "sin_yaw": F.lit(0.0), "cos_yaw": F.lit(1.0)})
    boxes = top.withColumns(cd.centre_decode((0.0, -50.0), (0.25, 0.25), 8, gravity=False))
    kept = boxes.where((c("score") > 0.95) & c("x").between(3.0, 45.0) & c("y").between(-40.0, 40.0))
    return kept.select("frame_id", "class_id", "rank", *[rd(k, 5).alias(k) for k in ("x", "y", "score")])


@query("top_queries", f"""WITH q AS (SELECT frame_id, det_id * 6 + k AS flat, 1.0 / (1.0 + exp(-(score * 4 - 2 - k * 0.3))) AS s, x, y FROM detections CROSS JOIN (SELECT unnest(range(6)) AS k))
SELECT frame_id, flat // 6 AS det_id, CAST(flat % 6 AS BIGINT) AS label, {r6('s', 5)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY s DESC, flat) AS r FROM q) WHERE r <= 30 AND s > 0.5 AND x BETWEEN 5 AND 45 AND y BETWEEN -40 AND 40""")
def _(v):
    k = F.explode(F.sequence(F.lit(0), F.lit(5)))
    q = v.detections().select("frame_id", "det_id", "x", "y", "score", k.alias("k"))
    q = q.withColumns({"flat": c("det_id") * 6 + c("k"), "s": 1.0 / (1.0 + F.exp(-(c("score") * 4 - 2 - c("k") * 0.3)))})
    top = tk.top_queries(q, 30, 6).where((c("s") > 0.5) & c("x").between(5.0, 45.0) & c("y").between(-40.0, 40.0))
    return top.select("frame_id", c("query").alias("det_id"), "label", rd("s", 5).alias("score"))


@query("lift_features", f"""WITH e AS (SELECT frame_id, v, u, semantic_id + 1.0 AS ctx, [exp(0.0), exp((v % 3) * 1.0), exp((u % 5) * 0.5)] AS e FROM pixels)
SELECT frame_id, v, u, CAST(k AS INTEGER) AS bin, {r6('e[k + 1] / list_sum(e) * ctx', 5)} AS value FROM e CROSS JOIN (SELECT unnest(range(3)) AS k)""")
def _(v):
    px = v.pixels().withColumns({
        "logits": F.array(F.lit(0.0), (c("v") % 3) * 1.0, (c("u") % 5) * 0.5), "ctx": c("semantic_id") + 1.0})
    return rs.lift_features(px, "logits", "ctx").select("frame_id", "v", "u", "bin", rd("value", 5).alias("value"))


@query("frustum_points", f"""WITH g AS (SELECT record_id, tx, ty, yaw, d, r, q, 1.0 + d * 2.0 AS dist, (q * (63 / 3.0) + 4.0) / 0.5 AS pu, (r * (47 / 2.0) + 2.0) / 0.5 AS pv
 FROM records CROSS JOIN (SELECT unnest(range(5)) AS d) CROSS JOIN (SELECT unnest(range(3)) AS r) CROSS JOIN (SELECT unnest(range(4)) AS q))
SELECT record_id, CAST(d AS INTEGER) AS d, CAST(r AS INTEGER) AS r, CAST(q AS INTEGER) AS q, {r6('dist * cos(yaw) + (pu - 64.0) * dist / 60.0 * sin(yaw) + tx', 4)} AS x,
 {r6('dist * sin(yaw) - (pu - 64.0) * dist / 60.0 * cos(yaw) + ty', 4)} AS y, {r6('-((pv - 48.0) * dist / 60.0)', 4)} AS z FROM g""")
def _(v):
    out = rs.frustum_points(v.records(), (1.0, 11.0, 2.0), (48, 64), (3, 4), 60.0, 60.0, 64.0, 48.0, 0.5, (4.0, 2.0))
    return out.select("record_id", "d", "r", "q", *[rd(k, 4).alias(k) for k in "xyz"])


@query("image_calibration", f"""WITH p AS (SELECT record_id, 0.4 + 0.2 * {sr.uniform(5, 'record_id')} AS s, {sr.draw(6, 'record_id')} % 2 = 0 AS flip, (-5.4 + 10.8 * {sr.uniform(7, 'record_id')}) / 180.0 * pi() AS th, {sr.uniform(8, 'record_id')} AS cu FROM records),
 k AS (SELECT *, CAST(trunc(cu * greatest(trunc(1600 * s) - 704, 0)) AS DOUBLE) AS cw, CAST(trunc((1 - 0.0) * trunc(900 * s)) - 256 AS DOUBLE) AS ch FROM p),
 m AS (SELECT record_id, th, CASE WHEN flip THEN -s ELSE s END AS a, s AS d, CASE WHEN flip THEN cw + 704.0 ELSE -cw END AS tx, -ch AS ty FROM k)
SELECT record_id, {r6('cos(th) * a', 5)} AS m00, {r6('sin(th) * d', 5)} AS m01, {r6('cos(th) * tx + sin(th) * ty + (cos(th) * -352.0 + sin(th) * -128.0 + 352.0)', 3)} AS m02,
 {r6('-sin(th) * tx + cos(th) * ty + (-sin(th) * -352.0 + cos(th) * -128.0 + 128.0)', 3)} AS m12 FROM m""")
def _(v):
    return tk.image_calibration(v.records(), (900, 1600), (256, 704), (0.4, 0.6), 5.4, 5).select(
        "record_id", rd("m00", 5).alias("m00"), rd("m01", 5).alias("m01"), rd("m02", 3).alias("m02"), rd("m12", 3).alias("m12"))


# The 2D bounds of every box in SQL: segments between corners cut at the canvas, and canvas corners inside.
def _cut(f, g, enter):
    kind = f"{f} < 0" if enter else f"{g} < 0"
    return f"CASE WHEN {kind} AND {f} <> {g} THEN {f} / ({f} - {g}) ELSE {0.0 if enter else 1.0} END"


_SIDES = [("a.u", "b.u"), ("100 - a.u", "100 - b.u"), ("a.v", "b.v"), ("80 - a.v", "80 - b.v")]
_SIDES = [(f"({f})", f"({g})") for f, g in _SIDES]
_CROSS = ["(p2.u - p1.u) * (q.y - p1.v) - (p2.v - p1.v) * (q.x - p1.u)".replace("p1", m).replace("p2", n) for m, n in (("a", "b"), ("b", "c"), ("c", "a"))]
REPROJECT_SQL = f"""cor AS (SELECT frame_id, box_id, corner, (-y * 100.0 + x * 50.0) / x AS u, (-z * 100.0 + x * 40.0) / x AS v FROM ({_corner_sql('lidar', None)}) WHERE x > 0.1),
 seg AS (SELECT a.frame_id, a.box_id, a.u AS au, a.v AS av, b.u - a.u AS du, b.v - a.v AS dv,
   greatest(0.0, {', '.join(_cut(f, g, True) for f, g in _SIDES)}) AS t0, least(1.0, {', '.join(_cut(f, g, False) for f, g in _SIDES)}) AS t1
  FROM cor a JOIN cor b ON a.frame_id = b.frame_id AND a.box_id = b.box_id AND a.corner <= b.corner WHERE {' AND '.join(f'NOT ({f} < 0 AND {g} < 0)' for f, g in _SIDES)}),
 spot AS (SELECT frame_id, box_id, au + t0 * du AS x, av + t0 * dv AS y FROM seg WHERE t0 <= t1 UNION ALL SELECT frame_id, box_id, au + t1 * du, av + t1 * dv FROM seg WHERE t0 <= t1
  UNION ALL SELECT a.frame_id, a.box_id, q.x, q.y FROM cor a JOIN cor b ON a.frame_id = b.frame_id AND a.box_id = b.box_id AND a.corner < b.corner
   JOIN cor c ON a.frame_id = c.frame_id AND a.box_id = c.box_id AND b.corner < c.corner CROSS JOIN (SELECT unnest([0.0, 0.0, 100.0, 100.0]) AS x, unnest([0.0, 80.0, 0.0, 80.0]) AS y) q
   WHERE ({' AND '.join(f'{e} > 0' for e in _CROSS)}) OR ({' AND '.join(f'{e} < 0' for e in _CROSS)})),
 bound2d AS (SELECT frame_id, box_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM spot GROUP BY ALL),
 seen2d AS (SELECT frame_id, box_id, name, x1, y1, x2, y2, (-boxes.y * 100.0 + boxes.x * 50.0) / boxes.x AS cu, (-(z + dz / 2) * 100.0 + boxes.x * 40.0) / boxes.x AS cv, boxes.x AS depth
  FROM bound2d JOIN boxes USING (frame_id, box_id) WHERE boxes.x > 0.1)"""


@query("reproject_boxes_2d", f"""WITH {REPROJECT_SQL} SELECT frame_id, box_id, {', '.join(f'{r6(n, 3)} AS {n}' for n in ('x1', 'y1', 'x2', 'y2'))}, {r6('cu', 3)} AS centre_u, {r6('cv', 3)} AS centre_v, depth FROM seen2d""")
def _(v):
    out = tk.reproject_boxes(v.boxes(), K, (100, 80), near=0.1)
    return out.select("frame_id", "box_id", *[rd(n, 3).alias(n) for n in ("x1", "y1", "x2", "y2", "centre_u", "centre_v")], "depth")
