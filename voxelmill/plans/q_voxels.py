"""Queries: voxels, pillars, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.operators import sparse as sp
from voxelmill.operators import voxels as vx
from voxelmill.plans.registry import query, r6, rd

c = F.col
VOXEL = vx.VoxelGrid((0.0, -51.2, -5.0, 51.2, 51.2, 3.0), (5.12, 5.12, 1.0))
POOL = vx.VoxelGrid((10.0, -40.0, -2.0, 42.0, 40.0, 2.0), (4.0, 4.0, 1.0))
FEATURES = ["x", "y", "z", "intensity"]


def _index_sql(g, source, trunc=False):
    fn = "trunc" if trunc else "floor"
    cols = ", ".join(
        f"CAST({fn}(({k} - ({g.range[i]!r}::DOUBLE)) / {g.size[i]!r}::DOUBLE) AS BIGINT) AS c{k}" for i, k in enumerate("xyz"))
    test = " AND ".join(f"c{k} >= 0 AND c{k} < {n}" for k, n in zip("xyz", g.shape))
    return f"(SELECT * FROM (SELECT *, {cols} FROM {source}) WHERE {test})"


CELLS = _index_sql(VOXEL, "rawpoints")
PCELLS = _index_sql(VOXEL, "points")
POOLED = _index_sql(POOL, "rawpoints", trunc=True)
KEY = "frame_id, cx, cy, cz"


@query("dynamic_voxelize", f"""WITH idx AS (SELECT frame_id, x, y, z,
  {", ".join(f"CAST(floor(({k} - ({VOXEL.range[i]!r}::DOUBLE)) / {VOXEL.size[i]!r}::DOUBLE) AS BIGINT) AS i{k}" for i, k in enumerate("xyz"))} FROM rawpoints),
 t AS (SELECT *, ix >= 0 AND ix < {VOXEL.shape[0]} AND iy >= 0 AND iy < {VOXEL.shape[1]} AND iz >= 0 AND iz < {VOXEL.shape[2]} AS ok FROM idx)
SELECT frame_id, {r6('x')} AS x, {r6('y')} AS y, CASE WHEN ok THEN ix ELSE -1 END AS cx, CASE WHEN ok THEN iy ELSE -1 END AS cy,
 CASE WHEN ok THEN iz ELSE -1 END AS cz FROM t""")
def _(v):
    return vx.dynamic_voxelize(v.rawpoints(), VOXEL).select(
        "frame_id", rd("x").alias("x"), rd("y").alias("y"), "cx", "cy", "cz")


@query("voxel_mean", f"""SELECT {KEY}, count(*) AS n, {", ".join(f"{r6(f'avg({f})', 5)} AS {f}" for f in FEATURES)}
FROM {CELLS} GROUP BY {KEY}""")
def _(v):
    out = vx.voxel_mean(v.rawpoints(), VOXEL, FEATURES)
    return out.select(*vx.CELL, "n", *[rd(f, 5).alias(f) for f in FEATURES])


@query("hard_voxelize", f"""WITH cells AS (SELECT * FROM {PCELLS}),
 opened AS (SELECT {KEY}, row_number() OVER (PARTITION BY frame_id ORDER BY min(point_id)) - 1 AS voxel_id FROM cells GROUP BY {KEY}),
 kept AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY point_id) - 1 AS slot FROM cells)
SELECT {KEY}, CAST(voxel_id AS BIGINT) AS voxel_id, CAST(slot AS BIGINT) AS slot, point_id, {r6('x')} AS x
FROM kept JOIN opened USING ({KEY}) WHERE slot < 3 AND voxel_id < 60""")
def _(v):
    return vx.hard_voxelize(v.points(), VOXEL, 3, 60).select(
        *vx.CELL, "voxel_id", "slot", "point_id", rd("x").alias("x"))


@query("voxel_arrival_rank", f"""SELECT {KEY}, min(point_id) AS first_point, count(*) AS n,
CAST(row_number() OVER (PARTITION BY frame_id ORDER BY min(point_id)) - 1 AS BIGINT) AS voxel_id FROM {PCELLS} GROUP BY {KEY}""")
def _(v):
    return vx.voxel_arrival_rank(v.points(), VOXEL)


@query("empty_cloud_voxels", f"""WITH means AS (SELECT {KEY}, avg(x) AS x, avg(intensity) AS intensity FROM {_index_sql(vx.VoxelGrid((0.0, 0.0, 2.4, 10.0, 10.0, 3.0), (10.0, 10.0, 0.6)), 'rawpoints')} GROUP BY {KEY}),
 counts AS (SELECT f.frame_id, count(m.frame_id) AS n FROM (SELECT DISTINCT frame_id FROM rawpoints) f LEFT JOIN means m USING (frame_id) GROUP BY 1)
SELECT {KEY}, {r6('x', 5)} AS x, {r6('intensity', 5)} AS intensity FROM means
UNION ALL SELECT frame_id, 0, 0, 0, 0.0, 0.0 FROM (SELECT frame_id, unnest(range(n, 2)) FROM counts WHERE n < 2)""")
def _(v):
    small = vx.VoxelGrid((0.0, 0.0, 2.4, 10.0, 10.0, 3.0), (10.0, 10.0, 0.6))
    voxels = vx.voxel_mean(v.rawpoints(), small, ["x", "intensity"])
    frames = v.rawpoints().select("frame_id").distinct()
    out = vx.frames_with_dummy(frames, voxels, ["x", "intensity"])
    return out.select(*vx.CELL, rd("x", 5).alias("x"), rd("intensity", 5).alias("intensity"))


@query("dynamic_scatter", " UNION ALL ".join(f"""
SELECT '{how}' AS how, {KEY}, {r6(f'{fn}(x)', 5)} AS x, {r6(f'{fn}(intensity)', 5)} AS intensity FROM {CELLS} GROUP BY {KEY}"""
       for how, fn in (("sum", "sum"), ("mean", "avg"), ("max", "max"))))
def _(v):
    cells = vx.dynamic_voxelize(v.rawpoints(), VOXEL)
    out = None
    for how in ("sum", "mean", "max"):
        part = vx.dynamic_scatter(cells, ["x", "intensity"], how).select(
            F.lit(how).alias("how"), *vx.CELL, rd("x", 5).alias("x"), rd("intensity", 5).alias("intensity"))
        out = part if out is None else out.unionByName(part)
    return out


@query("dynamic_point_to_voxel", f"""SELECT {KEY}, {r6('x')} AS x, {r6('y')} AS y, count(*) OVER (PARTITION BY {KEY}) AS n FROM {CELLS}""")
def _(v):
    return vx.with_voxel_size(v.rawpoints(), VOXEL).select(*vx.CELL, rd("x").alias("x"), rd("y").alias("y"), "n")


@query("point_to_voxel_map", f"""WITH cells AS (SELECT * FROM {PCELLS}),
 vox AS (SELECT {KEY}, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY min(point_id)) - 1 AS BIGINT) AS voxel_id FROM cells GROUP BY {KEY})
SELECT frame_id, point_id, voxel_id FROM cells JOIN vox USING ({KEY})""")
def _(v):
    pts = v.points()
    ranked = vx.voxel_arrival_rank(pts, VOXEL).select(*vx.CELL, "voxel_id")
    return vx.inside_voxels(pts, VOXEL).join(ranked, vx.CELL).select("frame_id", "point_id", "voxel_id")


@query("bev_pool", f"""SELECT {KEY}, {r6('sum(x)', 5)} AS x, {r6('sum(intensity)', 5)} AS intensity FROM {POOLED} GROUP BY {KEY}""")
def _(v):
    return vx.bev_pool(v.rawpoints(), POOL, ["x", "intensity"]).select(
        *vx.CELL, rd("x", 5).alias("x"), rd("intensity", 5).alias("intensity"))


@query("collapse_z", f"""SELECT frame_id, cx, cy, {", ".join(f"{r6(f'coalesce(sum(CASE WHEN cz = {k} THEN intensity END), 0)', 5)} AS z{k}" for k in range(4))}
FROM {POOLED} GROUP BY frame_id, cx, cy""")
def _(v):
    pooled = vx.bev_pool(v.rawpoints(), POOL, ["intensity"])
    return vx.collapse_z(pooled, "intensity", 4).select("frame_id", "cx", "cy", *[rd(f"z{k}", 5).alias(f"z{k}") for k in range(4)])


@query("segment_sum", f"SELECT {KEY}, {r6('sum(intensity)', 5)} AS intensity FROM {CELLS} GROUP BY {KEY}")
def _(v):
    return vx.segment_sum(vx.inside_voxels(v.rawpoints(), VOXEL), "intensity").select(*vx.CELL, rd("intensity", 5).alias("intensity"))


@query("interval_runs", f"""WITH runs AS (SELECT frame_id, (cx * 20 + cy) * 8 + cz AS rank, count(*) AS length FROM {CELLS} GROUP BY ALL)
SELECT frame_id, rank, length, CAST(coalesce(sum(length) OVER (PARTITION BY frame_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM runs""")
def _(v):
    return vx.interval_runs(vx.inside_voxels(v.rawpoints(), VOXEL), VOXEL)


@query("pillar_decorate", f"""WITH cells AS (SELECT * FROM {CELLS}),
 m AS (SELECT {KEY}, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cells GROUP BY {KEY})
SELECT {KEY}, {r6('x')} AS x, {r6('y')} AS y, {r6('x - mx', 5)} AS fx, {r6('y - my', 5)} AS fy, {r6('z - mz', 5)} AS fz,
 {r6('x - ((cx + 0.5) * 5.12)', 5)} AS px, {r6('y - ((cy + 0.5) * 5.12 + (-51.2))', 5)} AS py FROM cells JOIN m USING ({KEY})""")
def _(v):
    return vx.pillar_decorate(v.rawpoints(), VOXEL).select(
        *vx.CELL, rd("x").alias("x"), rd("y").alias("y"), *[rd(k, 5).alias(k) for k in ("fx", "fy", "fz", "px", "py")])


@query("radar_decorate", f"""SELECT {KEY}, {r6('x - ((cx + 0.5) * 5.12)', 5)} AS px, {r6('y - ((cy + 0.5) * 5.12 + (-51.2))', 5)} AS py,
 {r6('x / 51.2')} AS sx, {r6('(y + 51.2) / 102.4')} AS sy, {r6('CASE WHEN l_linenumber = 7 THEN 0.0 ELSE intensity END')} AS intensity FROM {CELLS}""")
def _(v):
    cells = vx.inside_voxels(v.rawpoints(), VOXEL)
    dirty = F.when(c("l_linenumber") == 7, F.lit(float("nan"))).otherwise(c("intensity"))
    out = sp.radar_decorate(cells.withColumn("intensity", dirty), VOXEL, ["intensity"])
    return out.select(*vx.CELL, *[rd(k, 5).alias(k) for k in ("px", "py")], *[rd(k).alias(k) for k in ("sx", "sy", "intensity")])


@query("pillar_max", f"SELECT {KEY}, {r6('max(intensity)')} AS intensity, {r6('max(z)')} AS z FROM {CELLS} GROUP BY {KEY}")
def _(v):
    cells = vx.inside_voxels(v.rawpoints(), VOXEL)
    return vx.dynamic_scatter(cells, ["intensity", "z"], "max").select(*vx.CELL, rd("intensity").alias("intensity"), rd("z").alias("z"))


@query("sparsity", f"SELECT frame_id, {r6('count(DISTINCT (cx, cy, cz)) / 1600.0', 8)} AS sparsity FROM {CELLS} GROUP BY frame_id")
def _(v):
    cells = vx.inside_voxels(v.rawpoints(), VOXEL)
    return sp.sparsity(cells, VOXEL).select("frame_id", rd("sparsity", 8).alias("sparsity"))


VOX = f"(SELECT {KEY}, sum(intensity) - 1.0 AS f FROM {CELLS} GROUP BY {KEY})"


def voxel_features(v):
    cells = vx.inside_voxels(v.rawpoints(), VOXEL)
    return cells.groupBy(*vx.CELL).agg((F.sum("intensity") - 1.0).alias("f"))


def _pairs_sql(stride, pad):
    offs = "SELECT a, b, d FROM (SELECT unnest(range(3)) AS a) CROSS JOIN (SELECT unnest(range(3)) AS b) CROSS JOIN (SELECT unnest(range(3)) AS d)"
    outs = [(n + 2 * pad - 3) // stride + 1 for n in VOXEL.shape]
    nums = ", ".join(f"c{k} + {pad} - {o} AS n{k}" for k, o in zip("xyz", "abd"))
    test = " AND ".join(f"n{k} >= 0 AND n{k} % {stride} = 0 AND n{k} // {stride} < {m}" for k, m in zip("xyz", outs))
    return (f"(SELECT frame_id, cx, cy, cz, f, (a * 3 + b) * 3 + d AS kernel, nx // {stride} AS ox, ny // {stride} AS oy, nz // {stride} AS oz "
            f"FROM (SELECT *, {nums} FROM {VOX} CROSS JOIN ({offs})) WHERE {test})")


@query("sparse_conv_pairs", f"""SELECT 'strided' AS kind, {KEY}, CAST(kernel AS BIGINT) AS kernel, ox, oy, oz FROM {_pairs_sql(2, 1)}
UNION ALL SELECT 'submanifold', p.frame_id, p.cx, p.cy, p.cz, CAST(kernel AS BIGINT), ox, oy, oz FROM {_pairs_sql(1, 1)} p
JOIN {VOX} o ON p.frame_id = o.frame_id AND ox = o.cx AND oy = o.cy AND oz = o.cz
UNION ALL SELECT 'transposed', frame_id, cx, cy, cz, CAST((a * 2 + b) * 2 + d AS BIGINT), cx * 2 + a, cy * 2 + b, cz * 2 + d FROM {VOX}
CROSS JOIN (SELECT unnest(range(2)) AS a) CROSS JOIN (SELECT unnest(range(2)) AS b) CROSS JOIN (SELECT unnest(range(2)) AS d)""")
def _(v):
    vox = voxel_features(v)
    cols = [*vx.CELL, "kernel", "ox", "oy", "oz"]
    strided = sp.conv_pairs(vox, VOXEL.shape, (3, 3, 3), 2, 1).select(F.lit("strided").alias("kind"), *cols)
    sub = sp.submanifold_pairs(vox, VOXEL.shape, (3, 3, 3)).select(F.lit("submanifold").alias("kind"), *cols)
    up = sp.transposed_pairs(vox, VOXEL.shape, (2, 2, 2), 2, 0).select(F.lit("transposed").alias("kind"), *cols)
    return strided.unionByName(sub).unionByName(up)


@query("sparse_max_pool", f"SELECT frame_id, ox, oy, oz, {r6('greatest(max(f), 0.0)', 5)} AS f FROM {_pairs_sql(2, 1)} GROUP BY ALL")
def _(v):
    pairs = sp.conv_pairs(voxel_features(v), VOXEL.shape, (3, 3, 3), 2, 1)
    return sp.max_pool(pairs, "f").withColumn("f", rd("f", 5))


@query("sparse_conv_sum", f"""SELECT frame_id, ox, oy, oz, {r6('sum(f * (0.5 - kernel / 27.0))', 5)} AS f FROM {_pairs_sql(2, 1)} GROUP BY frame_id, ox, oy, oz""")
def _(v):
    pairs = sp.conv_pairs(voxel_features(v), VOXEL.shape, (3, 3, 3), 2, 1)
    return sp.conv_sum(pairs, "f", [0.5 - k / 27.0 for k in range(27)]).withColumn("f", rd("f", 5))


@query("to_dense", f"""WITH vox AS {VOX}, fr AS (SELECT DISTINCT frame_id FROM rawpoints)
SELECT g.frame_id, CAST(i AS BIGINT) AS cx, CAST(j AS BIGINT) AS cy, CAST(k AS BIGINT) AS cz, {r6('coalesce(f, 0)', 5)} AS f FROM
 (SELECT * FROM fr CROSS JOIN (SELECT unnest(range(10)) AS i) CROSS JOIN (SELECT unnest(range(20)) AS j) CROSS JOIN (SELECT unnest(range(8)) AS k)) g
 LEFT JOIN vox v ON v.frame_id = g.frame_id AND v.cx = i AND v.cy = j AND v.cz = k""")
def _(v):
    frames = v.rawpoints().select("frame_id").distinct()
    return sp.to_dense(frames, voxel_features(v), VOXEL, "f").withColumn("f", rd("f", 5))


@query("pillar_scatter", f"""WITH p AS (SELECT frame_id, cx, cy, sum(intensity) AS f FROM {CELLS} GROUP BY ALL), fr AS (SELECT DISTINCT frame_id FROM rawpoints)
SELECT g.frame_id, CAST(i AS BIGINT) AS cx, CAST(j AS BIGINT) AS cy, {r6('coalesce(f, 0)', 5)} AS f FROM
 (SELECT * FROM fr CROSS JOIN (SELECT unnest(range(10)) AS i) CROSS JOIN (SELECT unnest(range(20)) AS j)) g
 LEFT JOIN p ON p.frame_id = g.frame_id AND p.cx = i AND p.cy = j""")
def _(v):
    cells = vx.inside_voxels(v.rawpoints(), VOXEL).groupBy("frame_id", "cx", "cy").agg(F.sum("intensity").alias("f"))
    frames = v.rawpoints().select("frame_id").distinct()
    return sp.pillar_scatter(frames, cells, VOXEL, "f").withColumn("f", rd("f", 5))
