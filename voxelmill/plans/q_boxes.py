"""Queries: box geometry, coordinate modes, box coders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxelmill.functions import boxes as bx
from voxelmill.functions import coders as cd
from voxelmill.functions import linalg as la
from voxelmill.operators import anchors as an
from voxelmill.plans.registry import query, r6, rd
from voxelmill.skew import shuffled_join

c = F.col
ID = "frame_id, box_id"
DIMS = ("x", "y", "z", "dx", "dy", "dz", "yaw")


def out(v, cols, digits=5, source=None):
    """Box ids plus rounded columns."""
    df = v.boxes() if source is None else source
    return df.select("frame_id", "box_id", *[rd(e, digits).alias(n) for n, e in cols.items()])


def sel(cols, digits=5, source="boxes"):
    return f"SELECT {ID}, " + ", ".join(f"{r6(e, digits)} AS {n}" for n, e in cols.items()) + f" FROM {source}"


def box_dict(b, names=DIMS):
    return {n: getattr(b, n) for n in names}


@query("limit_period", sel({"a": "yaw - floor(yaw / pi() + 0.5) * pi()", "b": "yaw - floor(yaw / (2 * pi()) + 0.25) * (2 * pi())"}))
def _(v):
    return out(v, {"a": bx.limit_period(c("yaw")), "b": bx.limit_period(c("yaw"), 0.25, 2 * math.pi)})


_ROT = {"x": "x * cos(0.4) + y * sin(0.4)", "y": "y * cos(0.4) - x * sin(0.4)", "z": "z", "yaw": "yaw + 0.4",
        "vx": "vx * cos(0.4) + vy * sin(0.4)", "vy": "vy * cos(0.4) - vx * sin(0.4)"}


@query("rotate_boxes", sel({
    **_ROT, "cam_x": "x * cos(0.4) + z * sin(0.4)", "cam_z": "z * cos(0.4) - x * sin(0.4)", "cam_yaw": "yaw + 0.4",
    "dep_x": "x * cos(0.4) - y * sin(0.4)", "dep_y": "y * cos(0.4) + x * sin(0.4)", "dep_yaw": "yaw - 0.4"}))
def _(v):
    b, a = bx.box(velocity=True), F.lit(0.4)
    lidar, cam, dep = (bx.rotate(b, a, m) for m in ("lidar", "camera", "depth"))
    return out(v, {**box_dict(lidar, ("x", "y", "z", "yaw", "vx", "vy")), "cam_x": cam.x, "cam_z": cam.z,
                   "cam_yaw": cam.yaw, "dep_x": dep.x, "dep_y": dep.y, "dep_yaw": dep.yaw})


_FLIPS = {
    ("lidar", "horizontal"): ("x", "-y", "z", "pi() - yaw", "vx", "-vy"),
    ("lidar", "vertical"): ("-x", "y", "z", "-yaw", "-vx", "vy"),
    ("camera", "horizontal"): ("-x", "y", "z", "pi() - yaw", "-vx", "vy"),
    ("camera", "vertical"): ("x", "y", "-z", "-yaw", "vx", "vy"),
    ("depth", "horizontal"): ("-x", "y", "z", "pi() - yaw", "-vx", "vy"),
    ("depth", "vertical"): ("x", "-y", "z", "-yaw", "vx", "-vy"),
}


@query("flip_boxes", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, '{d}' AS direction, {ID}, " + ", ".join(
        f"{r6(e, 5)} AS {n}" for n, e in zip(("x", "y", "z", "yaw", "vx", "vy"), es)) + " FROM boxes"
    for (m, d), es in _FLIPS.items()))
def _(v):
    result = None
    for m, d in _FLIPS:
        f = bx.flip(bx.box(velocity=True), d, m)
        part = v.boxes().select(F.lit(m).alias("mode"), F.lit(d).alias("direction"), "frame_id", "box_id",
                                *[rd(getattr(f, n), 5).alias(n) for n in ("x", "y", "z", "yaw", "vx", "vy")])
        result = part if result is None else result.unionByName(part)
    return result


@query("scale_boxes", sel({n: f"{n} * 1.1" for n in ("x", "y", "z", "dx", "dy", "dz", "vx", "vy")}))
def _(v):
    return out(v, box_dict(bx.scale(bx.box(velocity=True), F.lit(1.1)), ("x", "y", "z", "dx", "dy", "dz", "vx", "vy")))


@query("translate_boxes", sel({"x": "x + 1.5", "y": "y - 0.5", "z": "z + 0.25"}))
def _(v):
    return out(v, box_dict(bx.translate(bx.box(), F.lit(1.5), F.lit(-0.5), F.lit(0.25)), ("x", "y", "z")))


@query("box_properties", sel({
    "volume": "dx * dy * dz", "height": "dz", "bottom": "z", "top": "z + dz", "gz": "z + dz * 0.5",
    "cam_height": "dy", "cam_bottom": "y", "cam_top": "y - dy", "cam_gy": "y - dy * 0.5"}))
def _(v):
    b = bx.box()
    bottom, top = bx.bottom_top(b)
    cam_bottom, cam_top = bx.bottom_top(b, "camera")
    return out(v, {"volume": bx.volume(b), "height": bx.height(b), "bottom": bottom, "top": top,
                   "gz": bx.gravity_centre(b)[2], "cam_height": bx.height(b, "camera"), "cam_bottom": cam_bottom,
                   "cam_top": cam_top, "cam_gy": bx.gravity_centre(b, "camera")[1]})


@query("shift_origin", sel({"x": "x", "y": "y + dy * 0.5", "z": "z - dz * 0.5"}))
def _(v):
    return out(v, box_dict(bx.shift_origin(bx.box(), (0.5, 0.5, 0.5), (0.5, 1.0, 0.0)), ("x", "y", "z")))


def _corner_sql(mode, digits=5):
    parts, near = [], (lambda e: r6(e, digits)) if digits else (lambda e: f"({e})")
    for n, bits in enumerate(bx.CORNER_BITS):
        o = bx.ORIGIN[mode]
        a, b, d = (f"{dim} * ({bit - org})" for dim, bit, org in zip(("dx", "dy", "dz"), bits, o))
        if mode == "camera":
            px, py, pz = f"({a}) * cos(yaw) + ({d}) * sin(yaw) + x", f"({b}) + y", f"({d}) * cos(yaw) - ({a}) * sin(yaw) + z"
        else:
            px, py, pz = f"({a}) * cos(yaw) + ({b}) * sin(yaw) + x", f"({b}) * cos(yaw) - ({a}) * sin(yaw) + y", f"({d}) + z"
        parts.append(f"SELECT '{mode}' AS mode, {ID}, CAST({n} AS INTEGER) AS corner, {near(px)} AS x, {near(py)} AS y, {near(pz)} AS z FROM boxes")
    return " UNION ALL ".join(parts)


@query("box_corners", " UNION ALL ".join(_corner_sql(m) for m in ("lidar", "camera", "depth")))
def _(v):
    result = None
    for mode in ("lidar", "camera", "depth"):
        part = v.boxes().select(F.lit(mode).alias("mode"), "frame_id", "box_id",
                                F.posexplode(bx.corners_array(bx.box(), mode)).alias("corner", "p"))
        part = part.select("mode", "frame_id", "box_id", "corner", *[rd(f"p.{k}", 5).alias(k) for k in "xyz"])
        result = part if result is None else result.unionByName(part)
    return result


HALF_W = "abs(dx * cos(yaw)) / 2 + abs(dy * sin(yaw)) / 2"
HALF_H = "abs(dx * sin(yaw)) / 2 + abs(dy * cos(yaw)) / 2"


@query("corners_to_minmax", sel({"x1": f"x - ({HALF_W})", "y1": f"y - ({HALF_H})", "x2": f"x + {HALF_W}", "y2": f"y + {HALF_H}"}))
def _(v):
    return out(v, dict(zip(("x1", "y1", "x2", "y2"), bx.bev_bounds(bx.box()))))


@query("box_surfaces", f"""SELECT {ID}, CAST(face AS INTEGER) AS face, {r6('nx', 5)} AS nx, {r6('ny', 5)} AS ny, {r6('nz', 5)} AS nz, {r6('d', 5)} AS d FROM (
 SELECT *, -(nx * px + ny * py + nz * pz) AS d FROM (
  SELECT {ID}, unnest([0, 1, 2, 3, 4, 5]) AS face,
   unnest([-cos(yaw), cos(yaw), -sin(yaw), sin(yaw), 0, 0]) AS nx, unnest([sin(yaw), -sin(yaw), -cos(yaw), cos(yaw), 0, 0]) AS ny,
   unnest([0.0, 0.0, 0.0, 0.0, -1.0, 1.0]::DOUBLE[]) AS nz,
   unnest([x - cos(yaw) * dx / 2, x + cos(yaw) * dx / 2, x - sin(yaw) * dy / 2, x + sin(yaw) * dy / 2, x, x]) AS px,
   unnest([y + sin(yaw) * dx / 2, y - sin(yaw) * dx / 2, y - cos(yaw) * dy / 2, y + cos(yaw) * dy / 2, y, y]) AS py,
   unnest([z, z, z, z, z, z + dz]) AS pz FROM boxes))""")
def _(v):
    faces = an.box_faces(bx.box())
    df = v.boxes().select("frame_id", "box_id", F.posexplode(faces).alias("face", "p"))
    return df.select("frame_id", "box_id", "face", *[rd(f"p.{k}", 5).alias(k) for k in ("nx", "ny", "nz", "d")])


@query("bev_box", sel({"cx": "x", "cy": "y", "w": "dx", "h": "dy", "yaw": "yaw", "cam_cy": "z", "cam_h": "dz"}))
def _(v):
    lidar, cam = bx.bev_columns(bx.box()), bx.bev_columns(bx.box(), "camera")
    return out(v, {**dict(zip(("cx", "cy", "w", "h", "yaw"), lidar)), "cam_cy": cam[1], "cam_h": cam[3]})


# Yaws are multiples of pi/8, so the 45 degree test is written on the integer index.
_SWAP = "abs(yaw - floor(yaw / pi() + 0.5) * pi()) > pi() / 4"
_NW, _NH = f"CASE WHEN {_SWAP} THEN dy ELSE dx END", f"CASE WHEN {_SWAP} THEN dx ELSE dy END"
NEAR = {"x1": f"x - ({_NW}) / 2", "y1": f"y - ({_NH}) / 2", "x2": f"x + ({_NW}) / 2", "y2": f"y + ({_NH}) / 2"}


@query("nearest_bev", sel(NEAR, source="(SELECT * REPLACE (yaw + 0.01 AS yaw) FROM boxes)"))
def _(v):
    return out(v, dict(zip(("x1", "y1", "x2", "y2"), bx.nearest_bev(bx.box()))),
               source=v.boxes().withColumn("yaw", c("yaw") + 0.01))


@query("xywhr2xyxyr", sel({"x1": "x - dx / 2", "y1": "y - dy / 2", "x2": "x + dx / 2", "y2": "y + dy / 2", "ry": "yaw"}))
def _(v):
    return out(v, dict(zip(("x1", "y1", "x2", "y2", "ry"), bx.xyxyr(bx.box()))))


@query("enlarge_box", sel({"dx": "dx + 1", "dy": "dy + 1", "dz": "dz + 1", "z": "z - 0.5"}))
def _(v):
    return out(v, box_dict(bx.enlarge(bx.box(), 0.5), ("dx", "dy", "dz", "z")))


def _centre_sql(units, kind):
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {ID}, CAST({n} AS INTEGER) AS pos, {r6(f'x + dx * {a / 2} * cos(yaw) + dy * {b / 2} * sin(yaw)', 5)} AS x, "
        f"{r6(f'y + dy * {b / 2} * cos(yaw) - dx * {a / 2} * sin(yaw)', 5)} AS y, {r6(f'z + dz * 0.5 + dz * {d / 2}', 5)} AS z FROM boxes"
        for n, (a, b, d) in enumerate(units))


@query("surface_line_centers", _centre_sql(((0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)), "face") + " UNION ALL "
       + _centre_sql(((1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1), (1, 0, -1), (-1, 0, -1), (0, 1, -1), (0, -1, -1),
                      (1, 1, 0), (1, -1, 0), (-1, 1, 0), (-1, -1, 0)), "edge"))
def _(v):
    result = None
    for kind, centres in (("face", bx.surface_centres(bx.box())), ("edge", bx.line_centres(bx.box()))):
        arr = F.array(*[F.struct(x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in centres])
        part = v.boxes().select(F.lit(kind).alias("kind"), "frame_id", "box_id", F.posexplode(arr).alias("pos", "p"))
        part = part.select("kind", "frame_id", "box_id", "pos", *[rd(f"p.{k}", 5).alias(k) for k in "xyz"])
        result = part if result is None else result.unionByName(part)
    return result


def _axes_sql(m, names=("x", "y", "z")):
    return [" + ".join(f"({k}) * ({f})" for k, f in zip(names, row) if f) for row in m]


@query("convert_box_mode", " UNION ALL ".join(
    f"SELECT '{s}' AS src, '{d}' AS dst, {ID}, " + ", ".join(f"{r6(e, 5)} AS {n}" for n, e in zip(
        ("x", "y", "z", "dx", "dy", "dz", "yaw"), _axes_sql(m) + [("dx", "dy", "dz")[i] for i in order] + ["yaw"])) + " FROM boxes"
    for (s, d), (m, order) in bx.BOX_AXES.items()))
def _(v):
    result = None
    for s, d in bx.BOX_AXES:
        b = bx.convert_box(bx.box(), s, d)
        part = v.boxes().select(F.lit(s).alias("src"), F.lit(d).alias("dst"), "frame_id", "box_id",
                                *[rd(getattr(b, n), 5).alias(n) for n in DIMS])
        result = part if result is None else result.unionByName(part)
    return result


# Written out by hand: the point table of the six mode pairs.
_POINT_SQL = {
    ("lidar", "camera"): ("-y", "-z", "x"), ("camera", "lidar"): ("z", "-x", "-y"),
    ("depth", "camera"): ("x", "-z", "y"), ("camera", "depth"): ("x", "z", "-y"),
    ("lidar", "depth"): ("-y", "x", "z"), ("depth", "lidar"): ("y", "-x", "z"),
}


@query("convert_point_mode", " UNION ALL ".join(
    f"SELECT '{s}' AS src, '{d}' AS dst, frame_id, " + ", ".join(f"{r6(e)} AS {n}" for n, e in zip("xyz", es)) + " FROM rawpoints"
    for (s, d), es in _POINT_SQL.items()))
def _(v):
    result = None
    for s, d in _POINT_SQL:
        p = bx.convert_point(c("x"), c("y"), c("z"), s, d)
        part = v.rawpoints().select(F.lit(s).alias("src"), F.lit(d).alias("dst"), "frame_id",
                                    *[rd(e).alias(n) for n, e in zip("xyz", p)])
        result = part if result is None else result.unionByName(part)
    return result


RT = [[0.0, 0.0, 1.0, 0.3], [-1.0, 0.0, 0.0, -0.2], [0.0, -1.0, 0.0, 1.1]]


@query("camera_to_lidar", sel({"x": "z + 0.3", "y": "-x - 0.2", "z": "-y + 1.1", "dx": "dz", "dy": "dx", "dz": "dy"}))
def _(v):
    return out(v, box_dict(bx.convert_box(bx.box(), "camera", "lidar", RT), ("x", "y", "z", "dx", "dy", "dz")))


_U, _V = "(-y * 100.0 + x * 50.0) / x", "(-z * 100.0 + x * 40.0) / x"


@query("project_to_image", f"""WITH k AS (SELECT * FROM ({_corner_sql('lidar', None)}) WHERE x > 0.1)
SELECT {ID}, {r6(f'min({_U})', 4)} AS u1, {r6(f'min({_V})', 4)} AS v1, {r6(f'max({_U})', 4)} AS u2, {r6(f'max({_V})', 4)} AS v2 FROM k GROUP BY {ID}""")
def _(v):
    k = [[100.0, 0.0, 50.0], [0.0, 100.0, 40.0], [0.0, 0.0, 1.0]]
    return out(v, {n: c(n) for n in ("u1", "v1", "u2", "v2")}, 4, an.image_bounds(v.boxes(), k))


@query("in_front_corners", f"""SELECT {ID}, count(*) AS n FROM ({_corner_sql('lidar')}) WHERE x > 3 GROUP BY {ID}""")
def _(v):
    pts = F.filter(bx.corners_array(bx.box()), lambda p: F.round(p.x + F.lit(1.3e-9), 5) > 3)
    df = v.boxes().select("frame_id", "box_id", F.size(pts).cast("bigint").alias("n"))
    return df.where(c("n") > 0)


@query("velocity_to_lidar", sel({"vx": "vx * cos(0.7) + vy * sin(0.7)", "vy": "vy * cos(0.7) - vx * sin(0.7)"}))
def _(v):
    pose = la.yaw_pose(F.lit(0.0), F.lit(0.0), F.lit(0.7))
    inv = [row[:3] for row in la.rigid_inverse(pose)[:3]]
    vx, vy, _ = la.apply_point(inv, [c("vx"), c("vy"), F.lit(0.0)])
    return out(v, {"vx": vx, "vy": vy})


@query("yaw_convention", sel({"yaw": "-yaw - pi() / 2"}))
def _(v):
    return out(v, {"yaw": -c("yaw") - math.pi / 2})


@query("box_to_global", f"""WITH g AS (SELECT *, x * cos(0.5) - y * sin(0.5) + 10.0 AS ex, x * sin(0.5) + y * cos(0.5) - 4.0 AS ey FROM boxes)
SELECT {ID}, {r6('ex * cos(1.1) - ey * sin(1.1) + 600.0', 5)} AS x, {r6('ex * sin(1.1) + ey * cos(1.1) + 1600.0', 5)} AS y, {r6('z + 1.8 + 0.2', 5)} AS z,
 {r6('-yaw - pi() / 2 + 0.5 + 1.1', 5)} AS yaw FROM g WHERE sqrt(ex * ex + ey * ey) <= 40.0""")
def _(v):
    lidar2ego = la.yaw_pose(F.lit(10.0), F.lit(-4.0), F.lit(0.5), 1.8)
    ego2global = la.yaw_pose(F.lit(600.0), F.lit(1600.0), F.lit(1.1), 0.2)
    ego = la.apply_point(lidar2ego, [c("x"), c("y"), c("z")])
    near = v.boxes().withColumns(dict(zip(("ex", "ey", "ez"), ego))).where(
        F.sqrt(c("ex") * c("ex") + c("ey") * c("ey")) <= 40.0)
    x, y, z = la.apply_point(ego2global, [c("ex"), c("ey"), c("ez")])
    return out(v, {"x": x, "y": y, "z": z, "yaw": -c("yaw") - math.pi / 2 + 0.5 + 1.1}, source=near)


@query("attribute_rule", f"""SELECT {ID}, CASE WHEN sqrt(vx * vx + vy * vy) > 0.2 THEN
  CASE WHEN name IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'vehicle.moving' WHEN name IN ('PROMO', 'ECONOMY') THEN 'cycle.with_rider' ELSE 'default' END
 ELSE CASE WHEN name = 'STANDARD' THEN 'pedestrian.standing' WHEN name = 'LARGE' THEN 'vehicle.stopped' ELSE 'default' END END AS attribute FROM boxes""")
def _(v):
    moving = {"SMALL": "vehicle.moving", "MEDIUM": "vehicle.moving", "LARGE": "vehicle.moving",
              "PROMO": "cycle.with_rider", "ECONOMY": "cycle.with_rider"}
    still = {"STANDARD": "pedestrian.standing", "LARGE": "vehicle.stopped"}
    rule = an.attribute_rule(c("name"), c("vx"), c("vy"), moving, still, F.lit("default"))
    return v.boxes().select("frame_id", "box_id", rule.alias("attribute"))


PAIR = """pairs AS (SELECT a.frame_id, a.box_id, a.x AS ax, a.y AS ay, a.z AS az, a.dx AS adx, a.dy AS ady, a.dz AS adz, a.yaw AS ayaw,
 d.x, d.y, d.z, d.dx, d.dy + 0.5 AS dy, d.dz, d.yaw FROM boxes a JOIN detections d ON a.frame_id = d.frame_id AND d.det_id // 4 = a.box_id)"""


def anchor_pairs(v):
    """Every box (as anchor) joined to its shifted copies."""
    anchors = v.boxes().select("frame_id", "box_id", *[c(n).alias("a" + n) for n in DIMS])
    targets = v.detections().select(
        "frame_id", F.floor(c("det_id") / 4).alias("box_id"), *DIMS).withColumn("dy", c("dy") + 0.5)
    return shuffled_join(anchors, targets, ["frame_id", "box_id"])


_ENC = {"tx": "(x - ax) / sqrt(adx * adx + ady * ady)", "ty": "(y - ay) / sqrt(adx * adx + ady * ady)",
        "tz": "(z + dz / 2 - az - adz / 2) / adz", "tdx": "ln(dx / adx)", "tdy": "ln(dy / ady)", "tdz": "ln(dz / adz)", "tyaw": "yaw - ayaw"}


@query("box_delta_encode", f"WITH {PAIR} " + sel(_ENC, source="pairs"))
def _(v):
    return out(v, cd.delta_encode(bx.box("a"), bx.box()), source=anchor_pairs(v))


@query("box_delta_decode", f"WITH {PAIR} " + sel({n: n for n in DIMS}, source="pairs"))
def _(v):
    pairs = anchor_pairs(v)
    enc = pairs.withColumns(cd.delta_encode(bx.box("a"), bx.box())).drop(*DIMS)
    return out(v, cd.delta_decode(bx.box("a")), source=enc)


@query("center_encode", sel({"cu": "x / 1.6", "cv": "(y + 51.2) / 1.6", "cz": "z + dz * 0.5", "ldx": "ln(dx)", "ldy": "ln(dy)", "ldz": "ln(dz)",
                             "sin_yaw": "sin(yaw)", "cos_yaw": "cos(yaw)", "vx": "vx", "vy": "vy"}))
def _(v):
    return out(v, cd.centre_encode(bx.box(velocity=True), (0.0, -51.2), (0.2, 0.2), 8))


@query("bin_encode", f"""SELECT {ID}, CAST(floor(s / (pi() / 6)) AS BIGINT) AS dir_class, {r6('s - (floor(s / (pi() / 6)) * (pi() / 6) + pi() / 12)', 5)} AS dir_res,
 {r6('dx - [4.5, 4.0, 3.5][1 + box_id % 3]', 5)} AS rdx, {r6('dy - [2.0, 2.5, 3.0][1 + box_id % 3]', 5)} AS rdy, {r6('dz - [1.5, 3.0, 2.0][1 + box_id % 3]', 5)} AS rdz
FROM (SELECT *, a - floor(a / (2 * pi())) * (2 * pi()) AS s FROM (SELECT *, (yaw + 0.05) - floor((yaw + 0.05) / (2 * pi())) * (2 * pi()) + pi() / 12 AS a FROM boxes))""")
def _(v):
    idx, rest = cd.angle_to_bin(c("yaw") + 0.05, 12)
    sizes = ((4.5, 2.0, 1.5), (4.0, 2.5, 3.0), (3.5, 3.0, 2.0))
    res = cd.size_residual(bx.box(), (c("box_id") % 3).cast("int"), sizes)
    return v.boxes().select("frame_id", "box_id", idx.alias("dir_class"), rd(rest, 5).alias("dir_res"),
                            *[rd(e, 5).alias(n) for e, n in zip(res, ("rdx", "rdy", "rdz"))])


@query("bin_decode", f"""SELECT {ID}, {r6('CASE WHEN a > pi() THEN a - 2 * pi() ELSE a END', 5)} AS yaw, {r6('greatest(dx, 0.1)', 5)} AS dx
FROM (SELECT *, (yaw + 0.05) - floor((yaw + 0.05) / (2 * pi())) * (2 * pi()) AS a FROM boxes)""")
def _(v):
    idx, rest = cd.angle_to_bin(c("yaw") + 0.05, 12)
    coded = v.boxes().withColumns({"dir_class": idx, "dir_res": rest, "half": c("dx") / 2})
    return out(v, {"yaw": cd.bin_to_angle(c("dir_class"), c("dir_res"), 12),
                   "dx": F.greatest(c("half") * 2, F.lit(0.1))}, source=coded)


@query("normalize_bbox", sel({"cx": "x", "cy": "y", "lw": "ln(dx)", "ll": "ln(dy)", "cz": "z", "lh": "ln(dz)", "sin_yaw": "sin(yaw)",
                              "cos_yaw": "cos(yaw)", "vx": "vx", "vy": "vy"}))
def _(v):
    return out(v, cd.normalise_box(bx.box(velocity=True)))


@query("denormalize_bbox", sel({"x": "x", "y": "y", "z": "z", "dx": "dx", "dy": "dy", "dz": "dz",
                                "yaw": "atan2(sin(yaw + 0.01), cos(yaw + 0.01))"}))
def _(v):
    norm = v.boxes().withColumn("yaw", c("yaw") + 0.01)
    norm = norm.select("frame_id", "box_id", *[e.alias(n) for n, e in cd.normalise_box(bx.box()).items()])
    return out(v, cd.denormalise_box(), source=norm)


@query("gaussian_radius", f"""SELECT {ID}, {r6('''least(
 (l + w + sqrt((l + w) ** 2 - 4 * (w * l * 0.9 / 1.1))) / 2, (2 * (l + w) + sqrt(4 * (l + w) ** 2 - 16 * (0.9 * w * l))) / 2,
 (-0.2 * (l + w) + sqrt(0.04 * (l + w) ** 2 + 0.4 * 4 * 0.9 * w * l)) / 2)''', 5)} AS radius FROM (SELECT {ID}, dy / 0.8 AS l, dx / 0.8 AS w FROM boxes)""")
def _(v):
    return out(v, {"radius": cd.gaussian_radius(c("dy") / 0.8, c("dx") / 0.8, 0.1)})


# The lattice is built for every class name in the part table, one set of anchors per class.
@query("anchor_grid", f"""WITH cls AS (SELECT p_type AS name, count(*) AS objects FROM part GROUP BY 1),
 lat AS (SELECT i, j, r FROM (SELECT unnest(range(16)) AS i) CROSS JOIN (SELECT unnest(range(24)) AS j) CROSS JOIN (SELECT unnest([0.0, 1.57]) AS r))
SELECT 'corner' AS align, name, objects, CAST(i AS BIGINT) AS ix, CAST(j AS BIGINT) AS iy, {r6('i * (48.0 / 15)', 5)} AS x, {r6('-48.0 + j * (96.0 / 23)', 5)} AS y, {r6('r', 5)} AS yaw FROM cls CROSS JOIN lat
UNION ALL SELECT 'centre', name, objects, CAST(i AS BIGINT), CAST(j AS BIGINT), {r6('i * (48.0 / 16) + 48.0 / 16 / 2', 5)}, {r6('-48.0 + j * (96.0 / 24) + 96.0 / 24 / 2', 5)}, {r6('r', 5)} FROM cls CROSS JOIN lat""")
def _(v):
    classes = v.table("part").groupBy(c("p_type").alias("name")).agg(F.count("*").alias("objects"))
    grid = dict(x=(0.0, 48.0, 16), y=(-48.0, 48.0, 24), rotations=(0.0, 1.57))
    corner = an.anchor_grid(classes, aligned=False, **grid).select(F.lit("corner").alias("align"), "*")
    centre = an.anchor_grid(classes, aligned=True, **grid).select(F.lit("centre").alias("align"), "*")
    return corner.unionByName(centre).select(
        "align", "name", "objects", "ix", "iy", *[rd(k, 5).alias(k) for k in ("x", "y", "yaw")])


# Quaternions and poses --------------------------------------------------------------------

@query("quat_to_matrix", f"""WITH q AS (SELECT scene_id, frame_id, cos(yaw / 2) AS w, sin(yaw / 2) AS z FROM poses)
SELECT scene_id, frame_id, {r6('1 - 2 * z * z', 5)} AS m00, {r6('-2 * w * z', 5)} AS m01, {r6('2 * w * z', 5)} AS m10, {r6('1.0', 5)} AS m22 FROM q""")
def _(v):
    two = F.lit(2.0)
    q = la.quat_to_matrix(F.cos(c("yaw") / 2) * two, F.lit(0.0), F.lit(0.0), F.sin(c("yaw") / 2) * two, normalise=True)
    return v.poses().select("scene_id", "frame_id", rd(q[0][0], 5).alias("m00"), rd(q[0][1], 5).alias("m01"),
                            rd(q[1][0], 5).alias("m10"), rd(q[2][2], 5).alias("m22"))


@query("matrix_to_quat", f"""WITH q AS (SELECT scene_id, frame_id, CASE WHEN cos(a / 2) < 0 THEN -1 ELSE 1 END AS s, cos(a / 2) AS w, sin(a / 2) AS z
 FROM (SELECT *, yaw + 0.001 AS a FROM poses))
SELECT scene_id, frame_id, {r6('s * w', 5)} AS w, {r6('0.0', 5)} AS x, {r6('0.0', 5)} AS y, {r6('s * z', 5)} AS z FROM q""")
def _(v):
    pose = la.yaw_pose(c("tx"), c("ty"), c("yaw") + 0.001)
    quat = la.with_quaternion(v.poses(), [row[:3] for row in pose[:3]], "qw", "qx", "qy", "qz")
    return quat.select("scene_id", "frame_id", *[rd(f"q{n}", 5).alias(n) for n in "wxyz"])


@query("conjugate_trajectory", f"""SELECT scene_id, frame_id, {r6('cos(yaw)', 5)} AS m00, {r6('-sin(yaw)', 5)} AS m02, {r6('ty', 5)} AS m03, {r6('-tx', 5)} AS m23 FROM poses""")
def _(v):
    swap = la.lit_matrix([[0, 1, 0, 0], [0, 0, 1, 0], [-1, 0, 0, 0], [0, 0, 0, 1]])
    pose = la.yaw_pose(c("tx"), c("ty"), c("yaw"))
    m = la.matmul(la.matmul(swap, pose), la.rigid_inverse(swap))
    return v.poses().select("scene_id", "frame_id", rd(m[0][0], 5).alias("m00"), rd(m[0][2], 5).alias("m02"),
                            rd(m[0][3], 5).alias("m03"), rd(m[2][3], 5).alias("m23"))


@query("invert_pose", f"""SELECT scene_id, frame_id, {r6('cos(yaw)', 5)} AS m00, {r6('sin(yaw)', 5)} AS m01, {r6('-(cos(yaw) * tx + sin(yaw) * ty)', 5)} AS tx, {r6('-(-sin(yaw) * tx + cos(yaw) * ty)', 5)} AS ty FROM poses""")
def _(v):
    m = la.rigid_inverse(la.yaw_pose(c("tx"), c("ty"), c("yaw")))
    return v.poses().select("scene_id", "frame_id", rd(m[0][0], 5).alias("m00"), rd(m[0][1], 5).alias("m01"),
                            rd(m[0][3], 5).alias("tx"), rd(m[1][3], 5).alias("ty"))


@query("compose_pose", f"""SELECT scene_id, frame_id, {r6('cos(yaw + 0.5)', 5)} AS m00, {r6('cos(yaw) * 1.5 - sin(yaw) * 0.5 + tx', 5)} AS tx, {r6('sin(yaw) * 1.5 + cos(yaw) * 0.5 + ty', 5)} AS ty FROM poses""")
def _(v):
    m = la.matmul(la.yaw_pose(c("tx"), c("ty"), c("yaw")), la.yaw_pose(F.lit(1.5), F.lit(0.5), F.lit(0.5)))
    return v.poses().select("scene_id", "frame_id", rd(m[0][0], 5).alias("m00"), rd(m[0][3], 5).alias("tx"), rd(m[1][3], 5).alias("ty"))


@query("apply_pose", f"SELECT frame_id, {r6('x * cos(0.5) - y * sin(0.5) + 1.5', 5)} AS x, {r6('x * sin(0.5) + y * cos(0.5) - 0.5', 5)} AS y, {r6('z + 0.7', 5)} AS z FROM rawpoints")
def _(v):
    x, y, z = la.apply_point(la.yaw_pose(F.lit(1.5), F.lit(-0.5), F.lit(0.5), 0.7), [c("x"), c("y"), c("z")])
    return v.rawpoints().select("frame_id", rd(x, 5).alias("x"), rd(y, 5).alias("y"), rd(z, 5).alias("z"))


@query("camera_matrix", f"""SELECT scene_id, frame_id, {r6('640 / (2 * tan(radians(60 + value % 60) / 2))', 5)} AS fx, {r6('319.5', 5)} AS cx, {r6('239.5', 5)} AS cy FROM frames""")
def _(v):
    k = an.camera_intrinsics(640, 480, F.radians(60 + c("value") % 60))
    return v.frames().select("scene_id", "frame_id", rd(k[0][0], 5).alias("fx"), rd(k[0][2], 5).alias("cx"), rd(k[1][2], 5).alias("cy"))


@query("patch_pose", f"""SELECT scene_id, frame_id, {r6('cos(yaw) * 0.985 + tx', 5)} AS map_x, {r6('sin(yaw) * 0.985 + ty', 5)} AS map_y,
 {r6('degrees(atan2(sin(yaw + 0.001), cos(yaw + 0.001)))', 4)} AS heading FROM poses""")
def _(v):
    m = la.matmul(la.yaw_pose(c("tx"), c("ty"), c("yaw")), la.yaw_pose(F.lit(0.985), F.lit(0.0), F.lit(0.001)))
    return v.poses().select("scene_id", "frame_id", rd(m[0][3], 5).alias("map_x"), rd(m[1][3], 5).alias("map_y"),
                            rd(F.degrees(F.atan2(m[1][0], m[0][0])), 4).alias("heading"))
