"""Queries: in-box, radius, nearest neighbour, overlap and matching joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.operators import joins as jn
from voxelmill.operators import matching as mt
from voxelmill.operators import sampling as sm
from voxelmill.plans.registry import query, r6, rd
from voxelmill.skew import shuffled_join

c = F.col

_A = "(b.yaw + pi() / 2)"
_LX = f"((p.x - b.x) * cos({_A}) - (p.y - b.y) * sin({_A}))"
_LY = f"((p.x - b.x) * sin({_A}) + (p.y - b.y) * cos({_A}))"


def in_box_sql(dx="b.dx", dy="b.dy", dz="b.dz", z="b.z"):
    return (f"abs(p.z - ({z} + {dz} / 2)) <= {dz} / 2 AND {_LX} > -{dy} / 2 AND {_LX} < {dy} / 2 "
            f"AND {_LY} > -{dx} / 2 AND {_LY} < {dx} / 2")


PB = "points p JOIN boxes b ON p.frame_id = b.frame_id"


def points_xyz(v):
    return v.points().select("frame_id", "point_id", "x", "y", "z", "intensity")


@query("points_in_boxes_all", f"SELECT p.frame_id, p.point_id, b.box_id FROM {PB} AND {in_box_sql()}")
def _(v):
    return jn.points_in_boxes_all(points_xyz(v), v.boxes()).select("frame_id", "point_id", c("b_box_id").alias("box_id"))


@query("points_in_boxes_first", f"""SELECT p.frame_id, p.point_id, coalesce(min(b.box_id), -1) AS box_id
FROM points p LEFT JOIN boxes b ON p.frame_id = b.frame_id AND {in_box_sql()} GROUP BY p.frame_id, p.point_id""")
def _(v):
    return jn.points_in_boxes_first(points_xyz(v), v.boxes())


@query("points_in_boxes_batch", f"SELECT p.frame_id, p.point_id, b.box_id, CAST(1 AS INTEGER) AS inside FROM {PB} AND {in_box_sql()}")
def _(v):
    # sparse form of the 0/1 matrix: absent pairs are zero
    pairs = jn.points_in_boxes_all(points_xyz(v), v.boxes())
    return pairs.select("frame_id", "point_id", c("b_box_id").alias("box_id"), F.lit(1).alias("inside"))


@query("points_in_rbbox", f"""SELECT p.frame_id, p.point_id, b.box_id FROM {PB}
AND p.z > b.z AND p.z < b.z + b.dz AND abs({_LX}) < b.dy / 2 AND abs({_LY}) < b.dx / 2""")
def _(v):
    pairs = jn.join_points_boxes(points_xyz(v), v.boxes(), jn.strictly_inside(), 8.0)
    return pairs.select("frame_id", "point_id", c("b_box_id").alias("box_id"))


@query("points_in_polygon_2d", f"""SELECT p.frame_id, p.point_id, b.box_id FROM points p JOIN (SELECT * REPLACE (yaw + 0.0137 AS yaw) FROM boxes) b
ON p.frame_id = b.frame_id AND abs({_LX}) < b.dy / 2 AND abs({_LY}) < b.dx / 2""")
def _(v):
    # a slight turn keeps the integer coordinates of the test data off the edges
    boxes = v.boxes().withColumn("yaw", c("yaw") + 0.0137)
    test = jn.in_convex_polygon(c("x"), c("y"), bx.bev_corners(bx.box("b_")))
    pairs = jn.join_points_boxes(points_xyz(v), boxes, test, 8.0)
    return pairs.select("frame_id", "point_id", c("b_box_id").alias("box_id"))


@query("remove_points_in_boxes", f"""SELECT p.frame_id, p.point_id FROM points p WHERE NOT EXISTS
(SELECT 1 FROM boxes b WHERE p.frame_id = b.frame_id AND {in_box_sql()})""")
def _(v):
    return jn.remove_points_in_boxes(points_xyz(v), v.boxes()).select("frame_id", "point_id")


@query("background_points_filter", f"""SELECT p.frame_id, p.point_id FROM points p WHERE NOT (
 EXISTS (SELECT 1 FROM boxes b WHERE p.frame_id = b.frame_id AND {in_box_sql('(b.dx + 1)', '(b.dy + 1)', '(b.dz + 1)', '(b.z - 0.5)')})
 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE p.frame_id = b.frame_id AND {in_box_sql()}))""")
def _(v):
    return jn.background_filter(points_xyz(v), v.boxes(), 0.5).select("frame_id", "point_id")


@query("object_database", f"""WITH pr AS (SELECT b.frame_id, b.box_id, p.x - b.x AS ox, p.y - b.y AS oy, p.z - b.z AS oz FROM {PB} AND {in_box_sql()})
SELECT b.frame_id, b.box_id, any_value(b.name) AS name, count(pr.ox) AS num_points, {r6('avg(ox)', 5)} AS mx, {r6('avg(oy)', 5)} AS my, {r6('avg(oz)', 5)} AS mz
FROM boxes b LEFT JOIN pr ON b.frame_id = pr.frame_id AND b.box_id = pr.box_id GROUP BY b.frame_id, b.box_id""")
def _(v):
    out = jn.object_database(points_xyz(v), v.boxes())
    return out.select("frame_id", "box_id", "name", "num_points", *[rd(k, 5).alias(k) for k in ("mx", "my", "mz")])


@query("object_points", f"SELECT b.frame_id, b.box_id, p.point_id, {r6('p.x - b.x', 5)} AS x, {r6('p.y - b.y', 5)} AS y, {r6('p.z - b.z', 5)} AS z FROM {PB} AND {in_box_sql()}")
def _(v):
    return jn.object_points(points_xyz(v), v.boxes()).select("frame_id", "box_id", "point_id", *[rd(k, 5).alias(k) for k in "xyz"])


def _roi_sql(how):
    fn = "max" if how == "max" else "avg"
    return f"""SELECT '{how}' AS how, frame_id, box_id, sx, sy, sz, {r6(f'{fn}(intensity)', 5)} AS intensity FROM (
 SELECT *, row_number() OVER (PARTITION BY frame_id, box_id, sx, sy, sz ORDER BY point_id) AS r FROM (
  SELECT p.frame_id, b.box_id, p.point_id, p.intensity, CAST(greatest(least(trunc(({_LX} + b.dy / 2) / (b.dy / 2)), 1), 0) AS BIGINT) AS sx,
   CAST(greatest(least(trunc(({_LY} + b.dx / 2) / (b.dx / 2)), 1), 0) AS BIGINT) AS sy, CAST(greatest(least(trunc((p.z - b.z) / (b.dz / 2)), 1), 0) AS BIGINT) AS sz
  FROM {PB} AND {in_box_sql()})) WHERE r <= 2 GROUP BY ALL"""


@query("roi_aware_pool", _roi_sql("max") + " UNION ALL " + _roi_sql("avg"))
def _(v):
    out = None
    for how in ("max", "avg"):
        part = jn.roi_pool(points_xyz(v), v.boxes(), (2, 2, 2), 3, "intensity", how).select(
            F.lit(how).alias("how"), "frame_id", "box_id", "sx", "sy", "sz", rd("intensity", 5).alias("intensity"))
        out = part if out is None else out.unionByName(part)
    return out


def centres(v):
    return v.boxes().select("frame_id", c("box_id").alias("centre_id"), c("x").alias("c_x"), c("y").alias("c_y"),
                            (c("z") + 2.0).alias("c_z"))


CENTRES = "centres AS MATERIALIZED (SELECT frame_id, box_id AS centre_id, x AS cx, y AS cy, z + 2.0 AS cz FROM boxes)"
D2 = "((p.x - k.cx) * (p.x - k.cx) + (p.y - k.cy) * (p.y - k.cy) + (p.z - k.cz) * (p.z - k.cz))"
BALL = f"""{CENTRES}, hits AS MATERIALIZED (SELECT k.frame_id, k.centre_id, p.point_id, row_number() OVER (PARTITION BY k.frame_id, k.centre_id ORDER BY p.point_id) - 1 AS slot
  FROM centres k JOIN points p ON p.frame_id = k.frame_id AND ({D2} = 0 OR ({D2} >= 1.0 AND {D2} < 25.0))),
 ball AS MATERIALIZED (SELECT k.frame_id, k.centre_id, CAST(s AS INTEGER) AS slot, CAST(coalesce(h.point_id, f.point_id, 0) AS BIGINT) AS point_id FROM centres k CROSS JOIN (SELECT unnest(range(4)) AS s)
  LEFT JOIN hits h ON h.frame_id = k.frame_id AND h.centre_id = k.centre_id AND h.slot = s
  LEFT JOIN hits f ON f.frame_id = k.frame_id AND f.centre_id = k.centre_id AND f.slot = 0)"""


@query("ball_query", f"WITH {BALL} SELECT * FROM ball")
def _(v):
    return jn.ball_query(v.points(), centres(v), 1.0, 5.0, 4)


def _knn_sql(k):
    return f"""{CENTRES}, nn AS (SELECT * FROM (SELECT k.frame_id, k.centre_id, p.point_id, {D2} AS d2,
  CAST(row_number() OVER (PARTITION BY k.frame_id, k.centre_id ORDER BY {D2}, p.point_id) AS INTEGER) AS rank
  FROM centres k JOIN points p ON p.frame_id = k.frame_id) WHERE rank <= {k})"""


@query("knn", f"WITH {_knn_sql(5)} SELECT frame_id, centre_id, rank, point_id, {r6('d2', 5)} AS d2 FROM nn")
def _(v):
    return jn.knn(v.points(), centres(v), 5).withColumn("d2", rd("d2", 5))


@query("three_nn", f"WITH {_knn_sql(3)} SELECT frame_id, centre_id, rank, point_id, {r6('sqrt(d2)', 5)} AS distance FROM nn")
def _(v):
    return jn.knn(v.points(), centres(v), 3).select("frame_id", "centre_id", "rank", "point_id", rd(F.sqrt("d2"), 5).alias("distance"))


@query("three_interpolate", f"""WITH {_knn_sql(3)} SELECT nn.frame_id, centre_id, {r6('sum(intensity / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8))', 5)} AS intensity
FROM nn JOIN points p ON p.frame_id = nn.frame_id AND p.point_id = nn.point_id GROUP BY nn.frame_id, centre_id""")
def _(v):
    pts = v.points()
    return jn.three_interpolate(jn.knn(pts, centres(v), 3, ["intensity"]), pts, "intensity").withColumn("intensity", rd("intensity", 5))


@query("gather_points", f"WITH {BALL} SELECT b.frame_id, b.centre_id, b.slot, b.point_id, {r6('p.x')} AS x, {r6('p.intensity')} AS intensity FROM ball b JOIN points p ON p.frame_id = b.frame_id AND p.point_id = b.point_id")
def _(v):
    pts = v.points()
    out = jn.gather(pts, jn.ball_query(pts, centres(v), 1.0, 5.0, 4), ["x", "intensity"])
    return out.select("frame_id", "centre_id", "slot", "point_id", rd("x").alias("x"), rd("intensity").alias("intensity"))


@query("query_and_group", f"""WITH {BALL} SELECT b.frame_id, b.centre_id, b.slot, {r6('(p.x - k.cx) / 5.0')} AS ox, {r6('(p.y - k.cy) / 5.0')} AS oy, {r6('(p.z - k.cz) / 5.0')} AS oz, {r6('p.intensity')} AS intensity
FROM ball b JOIN points p ON p.frame_id = b.frame_id AND p.point_id = b.point_id JOIN centres k ON k.frame_id = b.frame_id AND k.centre_id = b.centre_id""")
def _(v):
    pts, ctr = v.points(), centres(v)
    out = jn.query_and_group(pts, ctr, jn.ball_query(pts, ctr, 1.0, 5.0, 4), 5.0)
    return out.select("frame_id", "centre_id", "slot", *[rd(k).alias(k) for k in ("ox", "oy", "oz", "intensity")])


@query("neighbour_pool", f"""WITH {BALL} SELECT b.frame_id, b.centre_id, {r6('max(p.intensity)', 5)} AS top, {r6('avg(p.intensity)', 5)} AS mean
FROM ball b JOIN points p ON p.frame_id = b.frame_id AND p.point_id = b.point_id GROUP BY b.frame_id, b.centre_id""")
def _(v):
    pts = v.points()
    rows = jn.gather(pts, jn.ball_query(pts, centres(v), 1.0, 5.0, 4), ["intensity"])
    return rows.groupBy("frame_id", "centre_id").agg(rd(F.max("intensity"), 5).alias("top"), rd(F.avg("intensity"), 5).alias("mean"))


@query("unique_resample", f"""WITH {BALL}, u AS (SELECT frame_id, centre_id, point_id, row_number() OVER (PARTITION BY frame_id, centre_id ORDER BY point_id) - 1 AS pos, count(*) OVER (PARTITION BY frame_id, centre_id) AS n
 FROM (SELECT DISTINCT frame_id, centre_id, point_id FROM ball))
SELECT frame_id, centre_id, CAST(s AS INTEGER) AS slot, point_id, CAST(n AS INTEGER) AS unique_count FROM u CROSS JOIN (SELECT unnest(range(6)) AS s)
WHERE pos = CASE WHEN s < n THEN s ELSE (s * 31 + centre_id) % n END""")
def _(v):
    return sm.unique_resample(jn.ball_query(v.points(), centres(v), 1.0, 5.0, 4), 6)


@query("assign_score_withk", f"""WITH {BALL} SELECT b.frame_id, b.centre_id, {r6('sum((0.1 + 0.2 * b.slot) * (p.intensity - q.intensity))', 5)} AS k0, {r6('sum((0.5 - 0.1 * b.slot) * (p.intensity - q.intensity))', 5)} AS k1
FROM ball b JOIN points p ON p.frame_id = b.frame_id AND p.point_id = b.point_id JOIN points q ON q.frame_id = b.frame_id AND q.point_id = b.centre_id GROUP BY b.frame_id, b.centre_id""")
def _(v):
    pts = v.points()
    scores = F.array(0.1 + 0.2 * c("slot"), 0.5 - 0.1 * c("slot"))
    out = sm.assign_scores(jn.ball_query(pts, centres(v), 1.0, 5.0, 4), pts, "intensity", scores, 2)
    return out.select("frame_id", "centre_id", rd("k0", 5).alias("k0"), rd("k1", 5).alias("k1"))


@query("group_all", f"SELECT frame_id, count(*) AS n, {r6('sum(x)', 3)} AS x, {r6('max(intensity)')} AS intensity FROM rawpoints GROUP BY frame_id")
def _(v):
    return v.rawpoints().groupBy("frame_id").agg(
        F.count("*").alias("n"), rd(F.sum("x"), 3).alias("x"), rd(F.max("intensity")).alias("intensity"))


@query("square_distance_pairs", f"""WITH pr AS (SELECT vec_id AS l, vec_id + k AS r FROM embeddings CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)),
 d AS (SELECT l AS left_id, r AS right_id, list_sum([(e[1]::DOUBLE - e[2]::DOUBLE) * (e[1]::DOUBLE - e[2]::DOUBLE) FOR e IN list_zip(x.embedding, y.embedding)]) AS d FROM pr JOIN embeddings x ON x.vec_id = l JOIN embeddings y ON y.vec_id = r)
SELECT left_id, right_id, {r6('d', 4)} AS distance FROM d""")
def _(v):
    emb = v.table("embeddings")
    pairs = emb.select(c("vec_id").alias("left_id"), F.explode(F.array(*[c("vec_id") + k for k in (1, 2, 3)])).alias("right_id"))
    return jn.pair_distance(emb, pairs, "vec_id", "embedding").select("left_id", "right_id", rd("distance", 4).alias("distance"))


# Box pairs --------------------------------------------------------------------------------

BD = "boxes a JOIN detections b ON a.frame_id = b.frame_id"


def pairs(v):
    return jn.box_pairs(v.boxes(), v.detections())


def _near(p):
    y = f"({p}.yaw + 0.01)"
    swap = f"abs({y} - floor({y} / pi() + 0.5) * pi()) > pi() / 4"
    w, h = f"(CASE WHEN {swap} THEN {p}.dy ELSE {p}.dx END)", f"(CASE WHEN {swap} THEN {p}.dx ELSE {p}.dy END)"
    return f"{p}.x - {w} / 2", f"{p}.y - {h} / 2", f"{p}.x + {w} / 2", f"{p}.y + {h} / 2"


def _iou2(a, b):
    inter = f"(greatest(least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]}), 0) * greatest(least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}), 0))"
    areas = " + ".join(f"({m[2]} - ({m[0]})) * ({m[3]} - ({m[1]}))" for m in (a, b))
    return inter, f"{inter} / greatest({areas} - {inter}, 1e-6)"


_NI, _NU = _iou2(_near("a"), _near("b"))


@query("bev_iou_nearest", f"SELECT a.frame_id, a.box_id, b.det_id, {r6(_NU, 5)} AS iou FROM {BD} WHERE {_NI} > 1e-9")
def _(v):
    a, b = (bx.nearest_bev(bx.box(p)) for p in ("a_", "b_"))
    shift = lambda df: df.withColumn("yaw", c("yaw") + 0.01)
    # the nearest rectangle stays inside a square of the longer side around the centre
    def square(df):
        side = F.greatest("dx", "dy")
        return shift(df).withColumns({"_w": c("dx"), "_h": c("dy"), "_yaw": c("yaw")}).withColumns(
            {"dx": side, "dy": side, "yaw": F.lit(0.0)})
    near = jn.box_pairs(square(v.boxes()), square(v.detections()))
    near = near.drop("a_dx", "a_dy", "a_yaw", "b_dx", "b_dy", "b_yaw").withColumnsRenamed(
        {"a__w": "a_dx", "a__h": "a_dy", "a__yaw": "a_yaw", "b__w": "b_dx", "b__h": "b_dy", "b__yaw": "b_yaw"})
    near = near.withColumns({**{f"a{i}": e for i, e in enumerate(a)}, **{f"b{i}": e for i, e in enumerate(b)}})
    iou, _ = jn.aabb_iou([c(f"a{i}") for i in range(4)], [c(f"b{i}") for i in range(4)])
    return near.withColumn("iou", iou).where(c("iou") > 1e-10).select(
        "frame_id", c("a_box_id").alias("box_id"), c("b_det_id").alias("det_id"), rd("iou", 5).alias("iou"))


_COS, _SIN = "abs(cos(a.yaw - b.yaw))", "abs(sin(a.yaw - b.yaw))"


def _sat(o, t):
    return (f"abs((b.x - a.x) * cos({o}.yaw) - (b.y - a.y) * sin({o}.yaw)) < {o}.dx / 2 + {t}.dx / 2 * {_COS} + {t}.dy / 2 * {_SIN} AND "
            f"abs((b.x - a.x) * sin({o}.yaw) + (b.y - a.y) * cos({o}.yaw)) < {o}.dy / 2 + {t}.dx / 2 * {_SIN} + {t}.dy / 2 * {_COS}")


SAT = f"({_sat('a', 'b')} AND {_sat('b', 'a')})"


@query("box_collision", f"SELECT a.frame_id, a.box_id, b.det_id FROM {BD} WHERE {SAT}")
def _(v):
    hit = pairs(v).where(jn.rectangles_touch(bx.box("a_"), bx.box("b_")))
    return hit.select("frame_id", c("a_box_id").alias("box_id"), c("b_det_id").alias("det_id"))


# Independent check of the clip: common corner points and edge crossings, ordered by angle, shoelace.
def _corner_list(p):
    pts = []
    for ux, uy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        pts.append(f"[{p}.x + {p}.dx * {ux} * cos({p}.yaw) + {p}.dy * {uy} * sin({p}.yaw), {p}.y + {p}.dy * {uy} * cos({p}.yaw) - {p}.dx * {ux} * sin({p}.yaw)]")
    return f"[{', '.join(pts)}]"


POLY = f"""pr AS (SELECT a.frame_id, a.box_id, b.det_id, {_corner_list('a')} AS pa, {_corner_list('b')} AS pb, a.dx * a.dy AS sa, b.dx * b.dy AS sb,
   greatest(least(a.z + a.dz, b.z + b.dz) - greatest(a.z, b.z), 0) AS hh, a.dx * a.dy * a.dz AS va, b.dx * b.dy * b.dz AS vb FROM {BD} WHERE {SAT}),
 ed AS (SELECT frame_id, box_id, det_id, i, j, pa[i] AS p1, pa[i % 4 + 1] AS p2, pb[j] AS q1, pb[j % 4 + 1] AS q2 FROM pr CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS i) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS j)),
 cr AS (SELECT *, (p2[1] - p1[1]) * (q2[2] - q1[2]) - (p2[2] - p1[2]) * (q2[1] - q1[1]) AS den,
   (q1[1] - p1[1]) * (q2[2] - q1[2]) - (q1[2] - p1[2]) * (q2[1] - q1[1]) AS tn, (q1[1] - p1[1]) * (p2[2] - p1[2]) - (q1[2] - p1[2]) * (p2[1] - p1[1]) AS un FROM ed),
 pts AS (SELECT frame_id, box_id, det_id, p1[1] + tn / den * (p2[1] - p1[1]) AS x, p1[2] + tn / den * (p2[2] - p1[2]) AS y FROM cr WHERE abs(den) > 1e-9 AND tn / den BETWEEN -1e-9 AND 1 + 1e-9 AND un / den BETWEEN -1e-9 AND 1 + 1e-9
  UNION ALL SELECT frame_id, box_id, det_id, any_value(p1)[1], any_value(p1)[2] FROM cr GROUP BY frame_id, box_id, det_id, i HAVING min((q2[1] - q1[1]) * (p1[2] - q1[2]) - (q2[2] - q1[2]) * (p1[1] - q1[1])) >= -1e-9
  UNION ALL SELECT frame_id, box_id, det_id, any_value(q1)[1], any_value(q1)[2] FROM cr GROUP BY frame_id, box_id, det_id, j HAVING min((p2[1] - p1[1]) * (q1[2] - p1[2]) - (p2[2] - p1[2]) * (q1[1] - p1[1])) >= -1e-9),
 ctr AS (SELECT frame_id, box_id, det_id, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY ALL),
 ang AS (SELECT frame_id, box_id, det_id, x - mx AS x, y - my AS y, row_number() OVER w AS r, lead(x - mx) OVER w AS nx, lead(y - my) OVER w AS ny, first_value(x - mx) OVER w AS fx, first_value(y - my) OVER w AS fy
   FROM pts JOIN ctr USING (frame_id, box_id, det_id) WINDOW w AS (PARTITION BY frame_id, box_id, det_id ORDER BY atan2(y - my, x - mx), x, y)),
 ov AS (SELECT frame_id, box_id, det_id, abs(sum(x * coalesce(ny, fy) - y * coalesce(nx, fx))) / 2 AS overlap FROM ang GROUP BY ALL),
 res AS (SELECT pr.*, overlap FROM pr JOIN ov USING (frame_id, box_id, det_id))"""


@query("bev_iou_rotated", f"WITH {POLY} SELECT frame_id, box_id, det_id, {r6('overlap / greatest(sa + sb - overlap, 1e-8)', 4)} AS iou FROM res WHERE overlap > 1e-6")
def _(v):
    out = jn.with_rotated_iou(pairs(v)).where(c("overlap") > 1e-6)
    return out.select("frame_id", c("a_box_id").alias("box_id"), c("b_det_id").alias("det_id"), rd("iou_bev", 4).alias("iou"))


@query("iou_3d", f"WITH {POLY} SELECT frame_id, box_id, det_id, {r6('overlap * hh / greatest(va + vb - overlap * hh, 1e-8)', 4)} AS iou, {r6('overlap * hh / va', 4)} AS iof FROM res WHERE overlap > 1e-6")
def _(v):
    out = jn.with_rotated_iou(pairs(v)).where(c("overlap") > 1e-6)
    return out.select("frame_id", c("a_box_id").alias("box_id"), c("b_det_id").alias("det_id"),
                      rd("iou_3d", 4).alias("iou"), rd("iof_3d", 4).alias("iof"))


def _b3(p):
    return [f"{p}.x - {p}.dx / 2", f"{p}.y - {p}.dy / 2", f"{p}.z", f"{p}.x + {p}.dx / 2", f"{p}.y + {p}.dy / 2", f"{p}.z + {p}.dz"]


_A3, _B3 = _b3("a"), _b3("b")
_I3 = "(" + " * ".join(f"greatest(least({_A3[i + 3]}, {_B3[i + 3]}) - greatest({_A3[i]}, {_B3[i]}), 0)" for i in range(3)) + ")"
_U3 = f"greatest(a.dx * a.dy * a.dz + b.dx * b.dy * b.dz - {_I3}, 1e-6)"
_H3 = "(" + " * ".join(f"(greatest({_A3[i + 3]}, {_B3[i + 3]}) - least({_A3[i]}, {_B3[i]}))" for i in range(3)) + ")"


@query("iou_axis_aligned_3d", f"SELECT a.frame_id, a.box_id, b.det_id, {r6(f'{_I3} / {_U3}', 5)} AS iou, {r6(f'{_I3} / {_U3} - ({_H3} - {_U3}) / {_H3}', 5)} AS giou FROM {BD} WHERE {_I3} > 1e-9")
def _(v):
    flat = [df.withColumn("yaw", F.lit(0.0)) for df in (v.boxes(), v.detections())]
    iou, giou = jn.aabb_iou(jn.box_bounds_3d(bx.box("a_")), jn.box_bounds_3d(bx.box("b_")))
    out = jn.box_pairs(*flat).withColumns({"iou": iou, "giou": giou}).where(c("iou") > 1e-10)
    return out.select("frame_id", c("a_box_id").alias("box_id"), c("b_det_id").alias("det_id"), rd("iou", 5).alias("iou"), rd("giou", 5).alias("giou"))


@query("giou", f"SELECT a.frame_id, b.det_id, {r6(f'{_I3} / {_U3} - ({_H3} - {_U3}) / {_H3}', 5)} AS giou FROM {BD} AND b.det_id // 4 = a.box_id")
def _(v):
    # aligned mode: each detection with its own object, overlapping or not
    a = v.boxes().select("frame_id", "box_id", *[c(n).alias("a_" + n) for n in ("x", "y", "z", "dx", "dy", "dz", "yaw")])
    b = v.detections().select("frame_id", "det_id", F.expr("det_id div 4").alias("box_id"), *[c(n).alias("b_" + n) for n in ("x", "y", "z", "dx", "dy", "dz", "yaw")])
    _, giou = jn.aabb_iou(jn.box_bounds_3d(bx.box("a_")), jn.box_bounds_3d(bx.box("b_")))
    return shuffled_join(a, b, ["frame_id", "box_id"]).select("frame_id", "det_id", rd(giou, 5).alias("giou"))


@query("camera_height_overlaps", f"SELECT a.frame_id, a.box_id, b.det_id, {r6('greatest(least(a.y, b.y) - greatest(a.y - a.dy, b.y - b.dy), 0)', 5)} AS overlap FROM {BD} AND b.det_id // 4 = a.box_id")
def _(v):
    a = v.boxes().select("frame_id", "box_id", *[c(n).alias("a_" + n) for n in ("x", "y", "z", "dx", "dy", "dz", "yaw")])
    b = v.detections().select("frame_id", "det_id", F.expr("det_id div 4").alias("box_id"), *[c(n).alias("b_" + n) for n in ("x", "y", "z", "dx", "dy", "dz", "yaw")])
    h = jn.height_overlap(bx.box("a_"), bx.box("b_"), "camera")
    return shuffled_join(a, b, ["frame_id", "box_id"]).select("frame_id", "box_id", "det_id", rd(h, 5).alias("overlap"))


_M = [[f"{p}.x - {p}.dx / 2", f"{p}.y - {p}.dy / 2", f"{p}.x + {p}.dx / 2", f"{p}.y + {p}.dy / 2"] for p in "ab"]
_MI, _MU = _iou2(*_M)


@query("mask_to_box_match", f"""WITH m AS (SELECT a.frame_id, a.box_id, b.det_id, {_MU} AS iou FROM {BD} AND {_MI} >= 0
  AND a.x - a.dx / 2 <= b.x + b.dx / 2 AND b.x - b.dx / 2 <= a.x + a.dx / 2 AND a.y - a.dy / 2 <= b.y + b.dy / 2 AND b.y - b.dy / 2 <= a.y + a.dy / 2)
SELECT frame_id, box_id, det_id AS mask_id, {r6('iou', 5)} AS iou, iou > 0.5 AS valid FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, box_id ORDER BY iou DESC, det_id) AS r FROM m) WHERE r = 1""")
def _(v):
    boxes, masks = (df.withColumn("yaw", F.lit(0.0)) for df in (v.boxes(), v.detections()))
    return jn.mask_to_box(boxes, masks).withColumn("iou", rd("iou", 5))


@query("heuristic_assign", f"""WITH d AS (SELECT a.frame_id, a.box_id AS gt_id, b.det_id AS pred_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM {BD} AND a.name = b.name),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, gt_id ORDER BY distance, pred_id) AS r FROM d WHERE distance <= 10) WHERE r = 1)
SELECT frame_id, pred_id, gt_id, {r6('distance', 5)} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, pred_id ORDER BY distance, gt_id) AS q FROM n) WHERE q = 1""")
def _(v):
    truth = v.boxes().withColumnRenamed("box_id", "gt_id")
    preds = v.detections().withColumnRenamed("det_id", "pred_id")
    return jn.heuristic_assign(truth, preds, 10.0).withColumn("distance", rd("distance", 5))


@query("match_costs", f"""WITH d AS (SELECT a.frame_id, b.det_id, a.box_id, abs(a.x - b.x) / 50.0 + abs(a.y - b.y) / 100.0 AS bev_l1, abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) + abs(a.dx - b.dx) + abs(a.dy - b.dy) + abs(a.dz - b.dz) AS box_l1 FROM {BD} AND b.det_id // 4 = a.box_id)
SELECT frame_id, box_id, det_id, {r6('bev_l1 * 0.25', 5)} AS bev_l1, {r6('box_l1 * 0.5', 5)} AS box_l1 FROM d""")
def _(v):
    a = v.boxes().select("frame_id", "box_id", *[c(n).alias("a_" + n) for n in ("x", "y", "z", "dx", "dy", "dz")])
    b = v.detections().select("frame_id", "det_id", F.expr("det_id div 4").alias("box_id"), *[c(n).alias("b_" + n) for n in ("x", "y", "z", "dx", "dy", "dz")])
    return shuffled_join(a, b, ["frame_id", "box_id"]).select(
        "frame_id", "box_id", "det_id", rd(mt.bev_l1_cost((50.0, 100.0), 0.25), 5).alias("bev_l1"), rd(mt.box_l1_cost(0.5), 5).alias("box_l1"))


@query("grouping_operation", f"WITH {BALL} SELECT b.frame_id, b.centre_id, b.slot, {r6('p.x')} AS x, {r6('p.y')} AS y, {r6('p.z')} AS z FROM ball b JOIN points p ON p.frame_id = b.frame_id AND p.point_id = b.point_id")
def _(v):
    pts = v.points()
    out = jn.gather(pts, jn.ball_query(pts, centres(v), 1.0, 5.0, 4), ["x", "y", "z"])
    return out.select("frame_id", "centre_id", "slot", *[rd(k).alias(k) for k in "xyz"])


@query("iof_3d", f"WITH {POLY} SELECT frame_id, box_id, det_id, {r6('overlap * hh / greatest(va, 1e-8)', 4)} AS iof FROM res WHERE overlap > 1e-6")
def _(v):
    out = jn.with_rotated_iou(pairs(v)).where(c("overlap") > 1e-6)
    return out.select("frame_id", c("a_box_id").alias("box_id"), c("b_det_id").alias("det_id"), rd("iof_3d", 4).alias("iof"))
