"""Queries: sampling, augmentation, degradation, noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.operators import degrade as dg
from voxelmill.operators import index as ix
from voxelmill.operators import sampling as sm
from voxelmill.operators import voxels as vx
from voxelmill.plans import sqlrand as sr
from voxelmill.plans.q_index import CHAIN, CHAIN_SQL, chain
from voxelmill.plans.registry import query, r6, rd
from voxelmill.session import cut_lineage

c = F.col


def pts(v):
    return v.points().select("frame_id", "point_id", "x", "y", "z", "intensity", "time")


def ranked(seed, source="points", keys="frame_id", ident="point_id", extra=""):
    return f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {extra}{sr.draw(seed, ident, keys)}, {ident}) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM {source})"


@query("point_shuffle", f"SELECT frame_id, point_id, CAST(k - 1 AS BIGINT) AS new_id FROM {ranked(3)}")
def _(v):
    return sm.point_shuffle(pts(v), 3).select("frame_id", "point_id", "new_id")


@query("pad_or_drop", f"""SELECT frame_id, point_id, {r6('x')} AS x, CAST(1 AS INTEGER) AS mask FROM {ranked(4)} WHERE k <= 256
UNION ALL SELECT frame_id, CAST(i AS BIGINT), 0.0, 0 FROM (SELECT frame_id, unnest(range(n, 256)) AS i FROM (SELECT frame_id, count(*) AS n FROM points GROUP BY 1) WHERE n < 256)""")
def _(v):
    return sm.pad_or_drop(pts(v), 256, 4).select("frame_id", "point_id", rd("x").alias("x"), "mask")


@query("point_sample", f"""SELECT frame_id, CAST(k - 1 AS BIGINT) AS slot, point_id FROM {ranked(5, extra='CASE WHEN x * x + y * y > 1600 THEN 0 ELSE 1 END, ')} WHERE n >= 256 AND k <= 256
UNION ALL SELECT frame_id, s, {sr.draw(6, 's', 'frame_id')} % n FROM (SELECT frame_id, n, unnest(range(256)) AS s FROM (SELECT frame_id, count(*) AS n FROM points GROUP BY 1) WHERE n < 256)""")
def _(v):
    return sm.point_sample(pts(v), 256, 5, far=c("x") * c("x") + c("y") * c("y") > 1600)


@query("choose_sweeps", f"""WITH {CHAIN_SQL}, sw AS (SELECT a.record_id, a.pos - b.pos - 1 AS rank FROM chain a JOIN chain b ON a.scene_id = b.scene_id AND a.channel = b.channel AND b.pos BETWEEN a.pos - 10 AND a.pos - 1)
SELECT 'test' AS mode, record_id, CAST(rank AS INTEGER) AS rank FROM sw WHERE rank < 3 UNION ALL SELECT 'train', record_id, CAST(rank AS INTEGER) FROM {ranked(7, 'sw', 'record_id', 'rank')} WHERE k <= 3""")
def _(v):
    sw = ix.earlier_records(chain(v), CHAIN, [], 10).select("record_id", "rank")
    test = sm.choose_sweeps(sw, 3, False, 7).select(F.lit("test").alias("mode"), "record_id", "rank")
    return test.unionByName(sm.choose_sweeps(sw, 3, True, 7).select(F.lit("train").alias("mode"), "record_id", "rank"))


@query("frame_dropout", f"SELECT frame_id, point_id FROM points WHERE time = 0 OR {sr.uniform(8, 'frame_id', 'round(time * 1000)')} >= 0.4")
def _(v):
    return sm.frame_dropout(pts(v), 0.4, 8).select("frame_id", "point_id")


@query("class_balanced_sample", f"""WITH fc AS (SELECT DISTINCT frame_id, name FROM boxes), n AS (SELECT name, count(*) AS n FROM fc GROUP BY 1), q AS (SELECT name, n, CAST(floor(n * ((1.0::DOUBLE / 6) / (n / (SELECT sum(n) FROM n)))) AS BIGINT) AS draws FROM n),
 d AS (SELECT name, n, unnest(range(draws)) AS draw_id FROM q), p AS (SELECT name, frame_id, row_number() OVER (PARTITION BY name ORDER BY frame_id) AS pos FROM fc)
SELECT d.name, d.draw_id, p.frame_id FROM d JOIN p ON p.name = d.name AND p.pos = {sr.draw(11, 'draw_id', "CAST('0x' || substr(md5(d.name), 1, 7) AS BIGINT)")} % n + 1""")
def _(v):
    return sm.class_balanced_sample(v.boxes().select("frame_id", "name").distinct(), 6, 11)


_OBJ = "obj AS (SELECT frame_id * 8 + box_id AS object_id, frame_id % 5 AS pool, name FROM boxes)"


def objects(v):
    return v.boxes().withColumns({"object_id": c("frame_id") * 8 + c("box_id"), "pool": c("frame_id") % 5})


@query("batch_sampler", f"WITH {_OBJ} " + " UNION ALL ".join(f"SELECT object_id, pool, CAST({k} AS INTEGER) AS cycle, CAST(k - 1 AS BIGINT) AS pos, CAST((k - 1) // 16 AS BIGINT) AS batch FROM {ranked(13 + k, 'obj', 'pool', 'object_id')}" for k in range(2)))
def _(v):
    return sm.batches(objects(v).select("object_id", "pool"), "object_id", "pool", 16, 2, 13).select("object_id", "pool", "cycle", "pos", "batch")


@query("filter_by_difficulty", f"WITH {_OBJ} SELECT object_id FROM obj WHERE object_id % 4 NOT IN (3) ")
def _(v):
    return objects(v).withColumn("difficulty", c("object_id") % 4).where(~c("difficulty").isin(3)).select("object_id")


@query("filter_by_min_points", f"WITH {_OBJ} SELECT object_id FROM obj WHERE object_id % 9 >= CASE name WHEN 'SMALL' THEN 5 WHEN 'LARGE' THEN 3 ELSE 0 END")
def _(v):
    need = F.coalesce(F.create_map(F.lit("SMALL"), F.lit(5), F.lit("LARGE"), F.lit(3))[c("name")], F.lit(0))
    return objects(v).where(c("object_id") % 9 >= need).select("object_id")


@query("replace_invalid_frame", f"""WITH fr AS (SELECT DISTINCT frame_id FROM points), ok AS (SELECT DISTINCT frame_id FROM boxes WHERE name = 'SMALL'), g AS (SELECT frame_id, frame_id % 4 AS grp, row_number() OVER (PARTITION BY frame_id % 4 ORDER BY frame_id) AS pos, count(*) OVER (PARTITION BY frame_id % 4) AS n FROM ok)
SELECT fr.frame_id, fr.frame_id AS used FROM fr SEMI JOIN ok USING (frame_id) UNION ALL SELECT l.frame_id, g.frame_id FROM (SELECT frame_id FROM fr ANTI JOIN ok USING (frame_id)) l JOIN g ON g.grp = l.frame_id % 4 AND g.pos = {sr.draw(17, 'l.frame_id')} % g.n + 1""")
def _(v):
    frames = v.rawpoints().select("frame_id").distinct()
    return sm.replace_invalid_frames(frames, v.boxes().where(c("name") == "SMALL"), 4, 17)


_TH, _FA = f"(-0.78 + 1.56 * {sr.uniform(21, 'frame_id')})", f"(0.9 + (1.1 - 0.9) * {sr.uniform(22, 'frame_id')})"
_T = {k: f"({sr.normal(23 + i, 'frame_id')} * 0.5)" for i, k in enumerate("xyz")}


@query("global_rot_scale_trans", f"""WITH p AS (SELECT frame_id, {_TH} AS th, {_FA} AS fa, {_T['x']} AS tx, {_T['y']} AS ty, {_T['z']} AS tz FROM (SELECT DISTINCT frame_id FROM rawpoints))
SELECT 'points' AS kind, frame_id, {r6('(x * cos(th) + y * sin(th) + tx) * fa', 4)} AS x, {r6('(y * cos(th) - x * sin(th) + ty) * fa', 4)} AS y, {r6('(z + tz) * fa', 4)} AS z FROM rawpoints JOIN p USING (frame_id)
UNION ALL SELECT 'boxes', frame_id, {r6('(x * cos(th) + y * sin(th) + tx) * fa', 4)}, {r6('(y * cos(th) - x * sin(th) + ty) * fa', 4)}, {r6('yaw + th', 4)} FROM boxes JOIN p USING (frame_id)""")
def _(v):
    def params(rows):
        return dg.augmentation_parameters(rows, 21, (-0.78, 0.78), (0.9, 1.1), 0.5)

    p = dg.rot_scale_trans_points(params(v.rawpoints())).select(F.lit("points").alias("kind"), "frame_id", *[rd(k, 4).alias(k) for k in "xyz"])
    b = dg.rot_scale_trans_boxes(params(v.boxes().join(v.rawpoints().select("frame_id").distinct(), "frame_id", "left_semi"))).select(F.lit("boxes").alias("kind"), "frame_id", rd("x", 4).alias("x"), rd("y", 4).alias("y"), rd("yaw", 4).alias("z"))
    return p.unionByName(b)


_FH, _FV = f"{sr.draw(31, 'frame_id')} % 2 = 1", f"{sr.draw(32, 'frame_id')} % 2 = 1"


@query("random_flip_3d", f"""WITH p AS (SELECT frame_id, {_FH} AS fh, {_FV} AS fv FROM (SELECT DISTINCT frame_id FROM rawpoints))
SELECT 'points' AS kind, frame_id, {r6('CASE WHEN fv THEN -x ELSE x END')} AS x, {r6('CASE WHEN fh THEN -y ELSE y END')} AS y, 0.0::DOUBLE AS yaw FROM rawpoints JOIN p USING (frame_id)
UNION ALL SELECT 'boxes', frame_id, {r6('CASE WHEN fv THEN -x ELSE x END')}, {r6('CASE WHEN fh THEN -y ELSE y END')}, {r6('CASE WHEN fh AND fv THEN yaw - pi() WHEN fh THEN pi() - yaw WHEN fv THEN -yaw ELSE yaw END', 5)} FROM boxes JOIN p USING (frame_id)""")
def _(v):
    seen = v.rawpoints().select("frame_id").distinct()
    p = dg.random_flip_points(dg.flip_parameters(v.rawpoints(), 31)).select(F.lit("points").alias("kind"), "frame_id", rd("x").alias("x"), rd("y").alias("y"), F.lit(0.0).alias("yaw"))
    b = dg.random_flip_boxes(dg.flip_parameters(v.boxes().join(seen, "frame_id", "left_semi"), 31)).select(F.lit("boxes").alias("kind"), "frame_id", rd("x").alias("x"), rd("y").alias("y"), rd("yaw", 5).alias("yaw"))
    return p.unionByName(b)


@query("radar_jitter", f"SELECT frame_id, point_id, {r6('x + ' + sr.normal(33, 'point_id', 'frame_id') + ' * 0.1', 5)} AS x, {r6('y + ' + sr.normal(34, 'point_id', 'frame_id') + ' * 0.1', 5)} AS y FROM points")
def _(v):
    return dg.radar_jitter(pts(v), 0.1, 33).select("frame_id", "point_id", rd("x", 5).alias("x"), rd("y", 5).alias("y"))


_IN = "x BETWEEN 10 AND 30 AND y BETWEEN -10 AND 20"


@query("degrade_region", f"SELECT frame_id, point_id FROM points WHERE NOT ({_IN}) UNION ALL SELECT frame_id, point_id FROM {ranked(41, f'(SELECT * FROM points WHERE {_IN})')} WHERE k <= round_even(n * 0.3, 0)")
def _(v):
    return dg.degrade_region(pts(v), (10.0, 30.0, -10.0, 20.0), 0.3, 41).select("frame_id", "point_id")


@query("degrade_density", f"SELECT frame_id, point_id FROM {ranked(42)} WHERE k <= greatest(round_even(n * 0.45, 0), 1)")
def _(v):
    return dg.degrade_density(pts(v), 0.45, 42).select("frame_id", "point_id")


@query("degrade_drop", f"SELECT frame_id, point_id FROM {ranked(43)} WHERE k <= greatest(round_even(n * (1.0::DOUBLE - 0.3::DOUBLE), 0), 1)")
def _(v):
    return dg.degrade_drop(pts(v), 0.3, 43).select("frame_id", "point_id")


@query("degrade_all", "SELECT f.frame_id, count(p.point_id) AS left_points FROM (SELECT DISTINCT frame_id FROM points) f LEFT JOIN (SELECT * FROM points WHERE false) p USING (frame_id) GROUP BY 1")
def _(v):
    empty = dg.degrade_all(pts(v)).groupBy("frame_id").agg(F.count("*").alias("left_points"))
    return v.rawpoints().select("frame_id").distinct().join(empty, "frame_id", "left").na.fill(0)


_MODE = f"CASE WHEN u < 0.3::DOUBLE THEN 'clean' WHEN u < 0.3::DOUBLE + 0.3::DOUBLE THEN 'local' WHEN u < 0.3::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE THEN 'global' ELSE 'combined' END"
_RD = f"""par AS (SELECT *, {_MODE} AS mode FROM (SELECT frame_id, count(*) AS original, {sr.uniform(51, 'frame_id')} AS u, 0.1 + (0.4 - 0.1) * {sr.uniform(52, 'frame_id')} AS ratio, CASE WHEN {sr.uniform(53, 'frame_id')} < 0.2 THEN 2 ELSE 1 END AS nb FROM points GROUP BY frame_id)),
 lb AS (SELECT frame_id, b, 5.0 + 7.0 * {sr.uniform(54, 'frame_id', 'b')} AS sx, 5.0 + 7.0 * {sr.uniform(55, 'frame_id', 'b')} AS sy, {sr.draw(56, 'frame_id', 'b')} % original AS point_id FROM (SELECT *, unnest(range(1, nb + 1)) AS b FROM par WHERE mode IN ('local', 'combined'))),
 bx AS (SELECT lb.frame_id, greatest(least(x, 50 - sx / 2), 0 + sx / 2) AS cx, greatest(least(y, 50 - sy / 2), -50 + sy / 2) AS cy, sx, sy FROM lb JOIN points p ON p.frame_id = lb.frame_id AND p.point_id = lb.point_id),
 op AS (SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.frame_id = p.frame_id AND p.x BETWEEN cx - sx / 2 AND cx + sx / 2 AND p.y BETWEEN cy - sy / 2 AND cy + sy / 2)),
 av AS (SELECT frame_id, count(*) AS avail FROM op GROUP BY 1),
 pl AS (SELECT *, quota < least(200, original) AS fb FROM (SELECT par.*, CASE WHEN mode IN ('global', 'combined') THEN CAST(greatest(round_even(coalesce(avail, 0) * (1.0 - ratio), 0), least(200, coalesce(avail, 0))) AS BIGINT) ELSE coalesce(avail, 0) END AS quota FROM par LEFT JOIN av USING (frame_id)))"""


@query("random_degradation", f"""WITH {_RD} SELECT frame_id, point_id FROM {ranked(57, 'op')} JOIN pl USING (frame_id) WHERE NOT fb AND k <= quota UNION ALL SELECT frame_id, point_id FROM points JOIN pl USING (frame_id) WHERE fb""")
def _(v):
    kept, _ = dg.random_degradation(pts(v), (0.0, -50.0, 50.0, 50.0), 51, size=(5.0, 12.0), min_points=200)
    return kept.select("frame_id", "point_id")


@query("degradation_record", f"""WITH {_RD} SELECT frame_id, CASE WHEN fb THEN 'clean_fallback' ELSE mode END AS mode, original, CASE WHEN fb THEN original ELSE quota END AS retained, {r6("CASE WHEN NOT fb AND mode IN ('global', 'combined') THEN ratio ELSE 0 END", 5)} AS drop_ratio FROM pl""")
def _(v):
    _, record = dg.random_degradation(pts(v), (0.0, -50.0, 50.0, 50.0), 51, size=(5.0, 12.0), min_points=200)
    return record.select("frame_id", "mode", "original", "retained", rd("drop_ratio", 5).alias("drop_ratio"))


_TURN = f"(atan2(y, x) - ({sr.uniform(62, 'frame_id')} * (2 * pi()) - pi()) + pi())"


@query("sector_dropout", f"SELECT frame_id, point_id FROM points WHERE NOT ({sr.uniform(61, 'frame_id')} < 0.6 AND abs({_TURN} - floor({_TURN} / (2 * pi())) * (2 * pi()) - pi()) <= radians(40.0) / 2)")
def _(v):
    return dg.apply_sector_dropout(pts(v), (0.6, 1, 40.0), 61).select("frame_id", "point_id")


@query("add_outliers", f"""WITH n AS (SELECT frame_id, CAST(round_even(count(*) * 0.05::DOUBLE, 0) AS BIGINT) AS m, median(time) AS time FROM points GROUP BY 1), o AS (SELECT frame_id, time, unnest(range(m)) AS i FROM n)
SELECT frame_id, CAST(-1 - i AS BIGINT) AS point_id, {r6('0.0 + 51.2 * ' + sr.uniform(71, 'i', 'frame_id'), 5)} AS x, {r6('-51.2 + 102.4 * ' + sr.uniform(72, 'i', 'frame_id'), 5)} AS y, {r6('0.25 * ' + sr.uniform(74, 'i', 'frame_id'), 5)} AS intensity, {r6('time', 5)} AS time FROM o""")
def _(v):
    p = pts(v)
    out = dg.outliers(p, 0.05, 71, p.columns)
    return out.select("frame_id", "point_id", *[rd(k, 5).alias(k) for k in ("x", "y", "intensity", "time")])


@query("noise_profile")
def _(v):
    p = pts(v).withColumns({k: c(k) / 10 for k in "xyz"})
    return dg.add_noise(p, dg.PROFILES["mid"], 81).select("frame_id", "point_id", "kind", *[rd(k, 4).alias(k) for k in ("x", "y", "z", "intensity")])


@query("noise_totals")
def _(v):
    p = pts(v).withColumns({k: c(k) / 10 for k in "xyz"})
    return dg.noise_totals(p, dg.add_noise(p, dg.PROFILES["heavy"], 82))


@query("voxel_point_sample")
def _(v):
    g = vx.VoxelGrid((0.0, -51.2, -5.0, 51.2, 51.2, 3.0), (5.12, 5.12, 8.0))
    return sm.voxel_point_sample(pts(v), g, 2, 80, 91)


@query("farthest_point_sample")
def _(v):
    return sm.farthest_point_sample(v.points(), 16)


@query("farthest_feature_sample")
def _(v):
    # feature distance: position plus intensity
    return sm.farthest_point_sample(v.points(), 8, ("x", "y", "z", "intensity"))


@query("object_paste")
def _(v):
    scene = v.boxes().where(c("box_id") < 4)
    pool = v.boxes().where(c("box_id") >= 4).withColumn("object_id", c("frame_id") * 8 + c("box_id"))
    return sm.paste_objects(scene, pool, {"SMALL": 3, "LARGE": 2, "PROMO": 2}, 101).select("frame_id", "object_id", "name")


@query("object_noise")
def _(v):
    moves = cut_lineage(sm.object_moves(v.boxes(), 100, 1.0, 0.3, 111))  # read by both parts
    none = F.lit(None)
    boxes = sm.moved_boxes(moves).withColumns({"part": F.lit("box"), "point_id": none.cast("bigint")})
    points = sm.moved_points(v.points().select("frame_id", "point_id", "x", "y", "z"), moves).withColumns({"part": F.lit("point"), "yaw": none.cast("double")})
    return boxes.unionByName(points).select("part", "frame_id", "box_id", "point_id", "attempt", *[rd(k, 5).alias(k) for k in ("x", "y", "z", "yaw")])


@query("shift_height", f"WITH q AS (SELECT frame_id, quantile_cont(z, 0.0099) AS floor_z FROM rawpoints GROUP BY 1) SELECT frame_id, {r6('z')} AS z, {r6('z - floor_z', 5)} AS height FROM rawpoints JOIN q USING (frame_id)")
def _(v):
    return sm.shift_height(v.rawpoints()).select("frame_id", rd("z").alias("z"), rd("height", 5).alias("height"))
