"""Queries: chains of named steps, bundles, SQL helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill import steps as st
from voxelmill.plans import sqlrand as sr
from voxelmill.plans.q_voxels import FEATURES, KEY, VOXEL
from voxelmill.plans.registry import query, r6, rd
from voxelmill.session import scratch_folder

_EPOCH_FLIP = f"{sr.draw(31, 'frame_id')} % 2 = 1", f"{sr.draw(32, 'frame_id')} % 2 = 1"


@query("step_chain", f"""WITH kept AS (SELECT frame_id, CASE WHEN {_EPOCH_FLIP[1]} THEN -x ELSE x END AS x, CASE WHEN {_EPOCH_FLIP[0]} THEN -y ELSE y END AS y, z, intensity, time FROM rawpoints WHERE time > 0),
cells AS (SELECT *, CAST(floor(x / 5.12) AS BIGINT) AS cx, CAST(floor((y + 51.2) / 5.12) AS BIGINT) AS cy, CAST(floor((z + 5.0) / 1.0) AS BIGINT) AS cz FROM kept)
SELECT {KEY}, count(*) AS n, {", ".join(f"{r6(f'avg({f})', 5)} AS {f}" for f in FEATURES)} FROM cells
WHERE cx BETWEEN 0 AND 9 AND cy BETWEEN 0 AND 19 AND cz BETWEEN 0 AND 7 GROUP BY {KEY}""")
def _(v):
    run = st.resolve([{"step": "keep_where", "condition": "time > 0"}, {"step": "flip", "seed": 31}, {"step": "voxel_mean", "grid": VOXEL, "features": FEATURES}])
    return run(v.rawpoints()).select(*KEY.split(", "), "n", *[rd(f, 5).alias(f) for f in FEATURES])


@query("sql_helpers", f"""SELECT frame_id, box_id, {r6('yaw - floor((yaw + pi()) / (2 * pi())) * 2 * pi()', 5)} AS yaw, {r6('x * cos(yaw) - y * sin(yaw)', 5)} AS tx,
{r6('x * sin(yaw) + y * cos(yaw)', 5)} AS ty, CAST(floor((y + 51.2) / 5.12) AS BIGINT) AS cell FROM boxes""")
def _(v):
    boxes = v.boxes()
    st.register_sql_helpers(boxes.sparkSession)
    return boxes.select("frame_id", "box_id", rd(F.expr("wrap_angle(yaw)"), 5).alias("yaw"), rd(F.expr("turn_x(x, y, yaw)"), 5).alias("tx"),
                        rd(F.expr("turn_y(x, y, yaw)"), 5).alias("ty"), F.expr("grid_cell(y, -51.2D, 5.12D)").alias("cell"))


@query("table_bundle", "SELECT 'boxes' AS name, count(*) AS n, CAST(sum(box_id) AS BIGINT) AS total FROM boxes UNION ALL SELECT 'points', count(*), CAST(sum(point_id) AS BIGINT) FROM points")
def _(v):
    points = v.points()
    folder = scratch_folder(points.sparkSession, "bundle")
    st.write_bundle({"boxes": v.boxes(), "points": points.select("frame_id", "point_id", "x")}, folder)
    back = st.bundle(points.sparkSession, folder, ["boxes", "points"])
    parts = [back[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(key).alias("total")) for n, key in (("boxes", "box_id"), ("points", "point_id"))]
    return parts[0].unionByName(parts[1])
