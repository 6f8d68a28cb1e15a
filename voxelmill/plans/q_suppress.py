"""Queries: suppression, matching, negative sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.operators import matching as mt
from voxelmill.operators import suppress as sp
from voxelmill.plans import sqlrand as sr
from voxelmill.plans.q_joins import POLY, _b3, _iou2
from voxelmill.plans.registry import query, r6, rd

c = F.col


def greedy_sql(pairs: str, key: str = "frame_id", source: str = "detections", with_views: str = "") -> str:
    """Sequential rule in SQL: walk the detections by score and keep one unless a kept one kills it."""
    return f"""{with_views}o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, det_id) AS r FROM {source}),
 kill AS (SELECT frame_id, loser, list(winner) AS killers FROM ({pairs}) GROUP BY ALL),
 walk AS (SELECT {key}, 0::BIGINT AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT {key} FROM o)
  UNION ALL SELECT {', '.join('w.' + k for k in key.split(', '))}, w.r + 1, CASE WHEN k.killers IS NOT NULL AND list_has_any(w.kept, k.killers) THEN w.kept ELSE list_append(w.kept, o.det_id) END
  FROM walk w JOIN o ON {' AND '.join(f'o.{k} = w.{k}' for k in key.split(', '))} AND o.r = w.r + 1 LEFT JOIN kill k ON k.frame_id = o.frame_id AND k.loser = o.det_id),
 kept AS (SELECT {key}, unnest(kept) AS det_id FROM (SELECT {key}, arg_max(kept, r) AS kept FROM walk GROUP BY ALL))"""


def pair_sql(test: str, same: str = "", source: str = "detections") -> str:
    return f"SELECT a.frame_id, a.det_id AS winner, b.det_id AS loser FROM {source} a JOIN {source} b ON a.frame_id = b.frame_id AND a.det_id <> b.det_id{same} WHERE {test}"


_M = [[f"{p}.x - {p}.dx / 2", f"{p}.y - {p}.dy / 2", f"{p}.x + {p}.dx / 2", f"{p}.y + {p}.dy / 2"] for p in "ab"]
_AXIS = _iou2(*_M)[1]
_A3, _B3 = _b3("a"), _b3("b")
_I3 = "(" + " * ".join(f"greatest(least({_A3[i + 3]}, {_B3[i + 3]}) - greatest({_A3[i]}, {_B3[i]}), 0)" for i in range(3)) + ")"
CIRCLE = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {t}"
# The polygon oracle of the joins, on pairs of detections.
POLY_DD = POLY.replace("boxes a JOIN detections b ON a.frame_id = b.frame_id", "detections a JOIN detections b ON a.frame_id = b.frame_id AND a.det_id <> b.det_id").replace("a.box_id, b.det_id", "a.det_id AS box_id, b.det_id")
ROT_PAIRS = "SELECT frame_id, box_id AS winner, det_id AS loser FROM res WHERE overlap / greatest(sa + sb - overlap, 1e-8) > {t}"


@query("circle_nms", "WITH RECURSIVE " + greedy_sql(pair_sql(CIRCLE.format(t=4.0))) + " SELECT frame_id, det_id FROM (SELECT k.frame_id, k.det_id, row_number() OVER (PARTITION BY k.frame_id ORDER BY score DESC, k.det_id) AS q FROM kept k JOIN detections d ON d.frame_id = k.frame_id AND d.det_id = k.det_id) WHERE q <= 83")
def _(v):
    return sp.nms(v.detections(), ["frame_id"], "det_id", sp.circle(4.0), post_max=83).select("frame_id", "det_id")


@query("axis_nms", "WITH RECURSIVE " + greedy_sql(pair_sql(f"{_AXIS} > 0.3")) + " SELECT frame_id, det_id FROM kept")
def _(v):
    return sp.nms(v.detections(), ["frame_id"], "det_id", sp.axis_aligned(0.3)).select("frame_id", "det_id")


@query("aligned_3d_nms", "WITH RECURSIVE " + greedy_sql(pair_sql(f"{_I3} / (a.dx * a.dy * a.dz + b.dx * b.dy * b.dz - {_I3}) > 0.25", " AND a.name = b.name")) + " SELECT frame_id, det_id FROM kept")
def _(v):
    return sp.nms(v.detections(), ["frame_id", "name"], "det_id", sp.aligned_3d(0.25)).select("frame_id", "det_id")


@query("rotated_nms", f"WITH RECURSIVE {POLY_DD}, " + greedy_sql(ROT_PAIRS.format(t=0.2)) + " SELECT frame_id, det_id FROM kept")
def _(v):
    return sp.nms(v.detections(), ["frame_id"], "det_id", sp.rotated(0.2)).select("frame_id", "det_id")


@query("nms_pre_post_limit", "WITH RECURSIVE pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_id) AS q FROM detections) WHERE q <= 20), "
       + greedy_sql(pair_sql(f"{_AXIS} > 0.3", source="pre"), source="pre")
       + " SELECT frame_id, det_id FROM (SELECT k.frame_id, k.det_id, row_number() OVER (PARTITION BY k.frame_id ORDER BY score DESC, k.det_id) AS z FROM kept k JOIN detections d ON d.frame_id = k.frame_id AND d.det_id = k.det_id) WHERE z <= 5")
def _(v):
    return sp.nms(v.detections(), ["frame_id"], "det_id", sp.axis_aligned(0.3), pre_max=20, post_max=5).select("frame_id", "det_id")


_MULTI = ("WITH RECURSIVE sc AS (SELECT * FROM detections WHERE score > 0.2), " + greedy_sql(pair_sql(f"{_AXIS} > 0.3", " AND a.name = b.name", "sc"), "frame_id, name", "sc")
          + " SELECT frame_id, det_id, name FROM (SELECT k.frame_id, k.det_id, d.name, row_number() OVER (PARTITION BY k.frame_id ORDER BY score DESC, k.det_id) AS z FROM kept k JOIN detections d ON d.frame_id = k.frame_id AND d.det_id = k.det_id) WHERE z <= {n}")


@query("multiclass_nms", _MULTI.format(n=500))
def _(v):
    return sp.multiclass_nms(v.detections(), "det_id", sp.axis_aligned(0.3), 0.2, 500).select("frame_id", "det_id", "name")


@query("max_num_limit", _MULTI.format(n=6))
def _(v):
    return sp.multiclass_nms(v.detections(), "det_id", sp.axis_aligned(0.3), 0.2, 6).select("frame_id", "det_id", "name")


@query("task_nms", "WITH RECURSIVE tk AS (SELECT *, CASE WHEN name IN ('SMALL', 'LARGE') THEN 0 WHEN name IN ('PROMO', 'ECONOMY') THEN 1 ELSE 2 END AS task, CASE WHEN name IN ('SMALL', 'LARGE') THEN 4.0 WHEN name IN ('PROMO', 'ECONOMY') THEN 1.0 END AS rad FROM detections), "
       + greedy_sql(pair_sql("a.task < 2 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= a.rad", " AND a.task = b.task", "tk"), "frame_id, task", "tk")
       + " SELECT frame_id, task, det_id FROM kept")
def _(v):
    tasks = [{"classes": ("SMALL", "LARGE"), "radius": 4.0}, {"classes": ("PROMO", "ECONOMY"), "radius": 1.0}, {"classes": ("STANDARD", "MEDIUM")}]
    return sp.task_nms(v.detections(), "det_id", tasks).select("frame_id", "task", "det_id")


@query("combine_scores", f"""SELECT frame_id, det_id, CAST(k AS INTEGER) AS label, {r6('CASE WHEN k = det_id % 3 THEN 1 / (1 + exp(-(score * 4 - 2 + k))) * (0.5 + score / 2) ELSE 0 END', 5)} AS score FROM detections CROSS JOIN (SELECT unnest(range(3)) AS k)""")
def _(v):
    rows = v.detections().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(2))))
    s = sp.combine_scores(c("score") * 4 - 2 + c("label"), 0.5 + c("score") / 2, c("label"), c("det_id") % 3)
    return rows.select("frame_id", "det_id", "label", rd(s, 5).alias("score"))


@query("hungarian_assign")
def _(v):
    truth = v.boxes().withColumnRenamed("box_id", "gt_id")
    preds = v.detections().withColumnRenamed("det_id", "pred_id")
    return mt.hungarian_assign(preds, truth, (50.0, 100.0)).withColumn("cost", rd(F.coalesce("cost", F.lit(0.0)), 5))


_EDGES, _FR, _N = (0.55, 0.35, 0.15), (0.5, 0.3, 0.2), 12
_NEG = f"""neg AS (SELECT frame_id, det_id AS neg_id, score * 0.54 AS overlap, {sr.draw(9, 'det_id', 'frame_id')} AS dr FROM detections),
 b AS (SELECT *, CASE WHEN overlap >= 0.35 THEN 0 WHEN overlap >= 0.15 THEN 1 ELSE 2 END AS band, count(*) OVER (PARTITION BY frame_id) AS n FROM neg),
 q AS (SELECT frame_id, n0, n1, n2, least(n0, 6) AS t0, greatest(6 - n0, 0) AS e0 FROM (SELECT frame_id, count(*) FILTER (band = 0) AS n0, count(*) FILTER (band = 1) AS n1, count(*) FILTER (band = 2) AS n2 FROM b GROUP BY 1)),
 q2 AS (SELECT *, least(n1, 3 + e0) AS t1 FROM q), q3 AS (SELECT *, least(n2, 12 - t0 - t1) AS t2 FROM q2)"""


@query("negative_piecewise_sample", f"""WITH {_NEG} SELECT r.frame_id, neg_id, {r6('overlap', 5)} AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, band ORDER BY dr, neg_id) AS k FROM b) r JOIN q3 USING (frame_id)
WHERE n <= 12 OR k <= CASE band WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END""")
def _(v):
    neg = v.detections().select("frame_id", c("det_id").alias("neg_id"), (c("score") * 0.54).alias("overlap"))
    out = mt.negative_piecewise_sample(neg, _N, _EDGES, _FR, 9)
    return out.select("frame_id", "neg_id", rd("overlap", 5).alias("overlap"))
