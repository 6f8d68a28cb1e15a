"""Queries: statistics, map metrics, losses, latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.operators import metrics as mx
from voxelmill.operators import raster as rs
from voxelmill.plans.q_raster import COLS, OFF, ROWS
from voxelmill.plans.registry import query, r6, rd
from voxelmill.schemas import METRIC_THRESHOLDS

c = F.col

STATS = """stats AS (SELECT p.frame_id, point_count, bad_intensity, coalesce(class_0, 0) AS class_0, coalesce(class_1, 0) AS class_1, coalesce(class_2, 0) AS class_2, coalesce(observed_sum, 0) AS observed_sum FROM
 (SELECT frame_id, count(*) AS point_count, CAST(sum(CASE WHEN intensity < 0 OR intensity > 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad_intensity FROM rawpoints GROUP BY 1) p
 LEFT JOIN (SELECT frame_id, CAST(sum(CASE WHEN class_id = 0 THEN label ELSE 0 END) AS BIGINT) AS class_0, CAST(sum(CASE WHEN class_id = 1 THEN label ELSE 0 END) AS BIGINT) AS class_1,
   CAST(sum(CASE WHEN class_id = 2 THEN label ELSE 0 END) AS BIGINT) AS class_2, CAST(sum(observed) AS BIGINT) AS observed_sum FROM map_cells GROUP BY 1) m USING (frame_id))"""
SCENES = f"""{STATS}, scenes AS (SELECT frame_id // 10 AS scene_id, count(*) AS frame_count, min(point_count) AS min_points, max(point_count) AS max_points, avg(point_count) AS mean_points,
 CAST(sum(class_0) AS BIGINT) AS class_0, CAST(sum(class_1) AS BIGINT) AS class_1, CAST(sum(class_2) AS BIGINT) AS class_2, CAST(sum(observed_sum) AS BIGINT) AS observed_sum FROM stats GROUP BY 1)"""


def stats(v):
    return mx.frame_statistics(v.rawpoints(), v.map_cells())


def scenes(v):
    return mx.scene_summary(stats(v), F.expr("frame_id div 10"))


@query("frame_statistics", f"WITH {STATS} SELECT * FROM stats")
def _(v):
    return stats(v)


@query("scene_summary", f"WITH {SCENES} SELECT * REPLACE ({r6('mean_points', 4)} AS mean_points) FROM scenes")
def _(v):
    return scenes(v).withColumn("mean_points", rd("mean_points", 4))


@query("dataset_summary", f"WITH {SCENES} SELECT CASE WHEN scene_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS scenes, CAST(sum(frame_count) AS BIGINT) AS frames, CAST(sum(observed_sum) AS BIGINT) AS observed_sum FROM scenes GROUP BY 1")
def _(v):
    return mx.dataset_summary(scenes(v), F.when(c("scene_id") % 5 == 0, "val").otherwise("train"))


@query("quality_warnings", f"""WITH {STATS}, s AS (SELECT *, CASE WHEN frame_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT * REPLACE (CASE WHEN frame_id % 50 = 3 THEN point_count * 6 ELSE point_count END AS point_count,
   CASE WHEN frame_id % 40 = 7 THEN 1 ELSE bad_intensity END AS bad_intensity, CASE WHEN frame_id % 5 = 0 THEN 0 ELSE class_2 END AS class_2) FROM stats)),
 t AS (SELECT split, sum(class_2) AS c2, sum(observed_sum) / (count(*) * 100000.0) AS cov, median(point_count) AS med FROM s GROUP BY 1)
SELECT split, 'class 2' AS subject, 'class never occurs' AS warning FROM t WHERE c2 = 0
UNION ALL SELECT split, 'coverage', 'less than one cell in a hundred is observed' FROM t WHERE cov < 0.01
UNION ALL SELECT split, 'frame ' || frame_id, 'point count outside five times the median' FROM s JOIN t USING (split) WHERE point_count < med / 5 OR point_count > med * 5
UNION ALL SELECT split, 'frame ' || frame_id, 'intensity not between 0 and 1' FROM s WHERE bad_intensity > 0""")
def _(v):
    rows = stats(v).withColumns({
        "point_count": F.when(c("frame_id") % 50 == 3, c("point_count") * 6).otherwise(c("point_count")),
        "bad_intensity": F.when(c("frame_id") % 40 == 7, 1).otherwise(c("bad_intensity")),
        "class_2": F.when(c("frame_id") % 5 == 0, 0).otherwise(c("class_2"))})
    return mx.quality_warnings(rows, 100000, F.when(c("frame_id") % 5 == 0, "val").otherwise("train"))


@query("class_distribution", f"WITH d AS (SELECT name, count(DISTINCT frame_id) AS frames FROM boxes GROUP BY 1) SELECT name, frames, {r6('frames / (SELECT sum(frames) FROM d)', 5)} AS share FROM d")
def _(v):
    return mx.class_distribution(v.boxes()).withColumn("share", rd("share", 5))


def _conf(where="true", group="class_id"):
    return f"""conf AS (SELECT {group}, t AS threshold, count(*) AS valid, CAST(sum(CASE WHEN hit AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN hit AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
 CAST(sum(CASE WHEN NOT hit AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM (SELECT *, CAST(score AS FLOAT) >= CAST(t AS FLOAT) AS hit FROM map_cells CROSS JOIN (SELECT unnest({list(METRIC_THRESHOLDS)}::DOUBLE[]) AS t) WHERE {where}) GROUP BY ALL),
 sc AS (SELECT *, tp / (tp + fp + fn + 1e-7) AS iou, tp / (tp + fp + 1e-7) AS p, tp / (tp + fn + 1e-7) AS r FROM conf), sc2 AS (SELECT *, 2 * p * r / (p + r + 1e-7) AS f1 FROM sc)"""


@query("map_confusion", f"WITH {_conf()} SELECT class_id, threshold, valid, tp, fp, fn FROM conf")
def _(v):
    return mx.map_confusion(v.map_cells(), METRIC_THRESHOLDS)


@query("map_iou", f"""WITH {_conf()}, top AS (SELECT class_id, max(iou) AS v FROM sc GROUP BY 1)
SELECT CAST(class_id AS VARCHAR) AS class, printf('iou@%.2f', threshold) AS metric, {r6('iou', 5)} AS value FROM sc UNION ALL SELECT CAST(class_id AS VARCHAR), 'iou@max', {r6('v', 5)} FROM top UNION ALL SELECT 'mean', 'iou@max', {r6('(SELECT avg(v) FROM top)', 5)}""")
def _(v):
    return mx.map_iou(v.map_cells(), METRIC_THRESHOLDS).withColumn("value", rd("value", 5))


_MM = ("iou_max", "iou_50", "precision", "recall", "f1")


@query("masked_map_metrics", f"""WITH {_conf("supervised = 1")}, m AS (SELECT a.class_id, a.iou_max, a.valid_pixels, b.iou AS iou_50, b.p AS precision, b.r AS recall, b.f1 FROM (SELECT class_id, max(iou) AS iou_max, max(valid) AS valid_pixels FROM sc2 GROUP BY 1) a JOIN sc2 b ON a.class_id = b.class_id AND b.threshold = 0.5)
SELECT CAST(class_id AS VARCHAR) AS class, valid_pixels, {", ".join(f"{r6(k, 5)} AS {k}" for k in _MM)} FROM m
UNION ALL SELECT 'mean', CAST(sum(valid_pixels) AS BIGINT), {", ".join(r6(f"avg({k})", 5) for k in _MM)} FROM m""")
def _(v):
    return mx.masked_map_metrics(v.map_cells(), METRIC_THRESHOLDS).select("class", "valid_pixels", *[rd(k, 5).alias(k) for k in _MM])


def _exposed(name, src):
    return f"""{name} AS (SELECT DISTINCT t.frame_id, t.class_id, t.row, t.col FROM {src} t CROSS JOIN {OFF}
  LEFT JOIN {src} n ON n.frame_id = t.frame_id AND n.class_id = t.class_id AND n.row = t.row + dr AND n.col = t.col + dc
  WHERE t.row + dr BETWEEN 0 AND {ROWS - 1} AND t.col + dc BETWEEN 0 AND {COLS - 1} AND n.row IS NULL)"""


# Dense block patterns per frame, so that supervision and labels have an interior.
BCELLS = f"""bc AS (SELECT f.frame_id, k.class_id, g.r AS row, g.q AS col, CASE WHEN ((g.r // 3 + g.q // 4 + f.frame_id + k.class_id) % 3) = 0 THEN 1 ELSE 0 END AS label,
 CASE WHEN (((g.r + 1) // 3 + g.q // 4 + f.frame_id + k.class_id) % 3) = 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS score, CASE WHEN (g.r // 8 + g.q // 8) % 4 <> 0 THEN 1 ELSE 0 END AS supervised
 FROM (SELECT DISTINCT frame_id FROM map_cells) f CROSS JOIN (SELECT unnest([0, 1, 2]) AS class_id) k CROSS JOIN (SELECT r::BIGINT AS r, q::BIGINT AS q FROM (SELECT unnest(range({ROWS})) AS r) CROSS JOIN (SELECT unnest(range({COLS})) AS q)) g),
 tr AS (SELECT frame_id, class_id, row, col FROM bc WHERE label = 1), pd AS (SELECT frame_id, class_id, row, col FROM bc WHERE score >= 0.5), su AS (SELECT frame_id, class_id, row, col FROM bc WHERE supervised = 1)"""


@query("boundary_f1", f"""WITH {BCELLS}, {_exposed('tb', 'tr')}, {_exposed('pb', 'pd')}, {_exposed('sb', 'su')}, core AS (SELECT * FROM su ANTI JOIN sb USING (frame_id, class_id, row, col)),
 t AS (SELECT * FROM tb SEMI JOIN core USING (frame_id, class_id, row, col)), p AS (SELECT * FROM pb SEMI JOIN core USING (frame_id, class_id, row, col)),
 td AS (SELECT DISTINCT frame_id, class_id, row + dr AS row, col + dc AS col FROM t CROSS JOIN {OFF}), pdl AS (SELECT DISTINCT frame_id, class_id, row + dr AS row, col + dc AS col FROM p CROSS JOIN {OFF}),
 pc AS (SELECT class_id, count(*) AS pred, count(td.row) AS pred_matched FROM p LEFT JOIN td USING (frame_id, class_id, row, col) GROUP BY 1), tc AS (SELECT class_id, count(*) AS truth, count(pdl.row) AS truth_matched FROM t LEFT JOIN pdl USING (frame_id, class_id, row, col) GROUP BY 1)
SELECT class_id, pred, pred_matched, truth, truth_matched, {r6('2 * (pred_matched / (pred + 1e-7)) * (truth_matched / (truth + 1e-7)) / (pred_matched / (pred + 1e-7) + truth_matched / (truth + 1e-7) + 1e-7)', 5)} AS f1 FROM pc JOIN tc USING (class_id)""")
def _(v):
    frames = v.map_cells().select("frame_id").distinct()
    grid = rs.lattice(frames, ROWS, COLS).withColumn("class_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    mix = F.expr("col div 4") + c("frame_id") + c("class_id")
    cells = grid.withColumns({
        "label": F.when((F.expr("row div 3") + mix) % 3 == 0, 1).otherwise(0),
        "score": F.when((F.expr("(row + 1) div 3") + mix) % 3 == 0, 0.8).otherwise(0.2),
        "supervised": F.when((F.expr("row div 8") + F.expr("col div 8")) % 4 != 0, 1).otherwise(0)})
    out = mx.boundary_f1(cells, ["frame_id", "class_id"], ROWS, COLS)
    return out.select("class_id", "pred", "pred_matched", "truth", "truth_matched", rd("f1", 5).alias("f1"))


INSIDE = "row BETWEEN 5 AND 15 AND col BETWEEN 15 AND 35"


def _region(scores):
    counts = ", ".join(f"CAST(sum(CASE WHEN {e} >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS {m}tp, CAST(sum(CASE WHEN {e} >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS {m}fp, CAST(sum(CASE WHEN {e} < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS {m}fn"
                       for m, e in scores.items())
    return (f"reg AS (SELECT coalesce(region, 'full') AS region, class_id, count(*) AS valid, {counts} FROM (SELECT *, CASE WHEN {INSIDE} THEN 'missing' ELSE 'retained' END AS region FROM map_cells WHERE supervised = 1) "
            "GROUP BY GROUPING SETS ((region, class_id), (class_id)))")


def inside():
    return c("row").between(5, 15) & c("col").between(15, 35)


@query("region_metrics", f"WITH {_region({'': 'score'})} SELECT region, class_id, valid, tp, fp, fn, {r6('tp / (tp + fp + fn + 1e-7)', 5)} AS iou FROM reg")
def _(v):
    return mx.region_metrics(v.map_cells(), inside()).select("region", "class_id", "valid", "tp", "fp", "fn", rd("iou", 5).alias("iou"))


_SC = {"original": "score", "degraded": "(score - 0.2)", "restored": "(score - 0.1)"}
_SUM = f"{_region({m + '_': e for m, e in _SC.items()})}, smry AS (" + " UNION ALL ".join(
    f"SELECT region, '{m}' AS mode, avg({m}_tp / ({m}_tp + {m}_fp + {m}_fn + 1e-7)) AS mean_iou FROM reg GROUP BY 1" for m in _SC) + ")"


def region_summary(v):
    return mx.region_mode_summary(v.map_cells(), inside(), {
        "original": c("score"), "degraded": c("score") - 0.2, "restored": c("score") - 0.1})


@query("region_mode_summary", f"WITH {_SUM} SELECT region, mode, {r6('mean_iou', 5)} AS mean_iou FROM smry")
def _(v):
    return region_summary(v).select("region", "mode", rd("mean_iou", 5).alias("mean_iou"))


@query("degradation_comparison", f"""WITH {_SUM}, w AS (SELECT region, max(CASE WHEN mode = 'original' THEN mean_iou END) AS o, max(CASE WHEN mode = 'degraded' THEN mean_iou END) AS d, max(CASE WHEN mode = 'restored' THEN mean_iou END) AS r FROM smry GROUP BY 1)
SELECT region, {r6('o - d', 5)} AS loss, {r6('r - d', 5)} AS gain, {r6('(r - d) / (o - d)', 4)} AS recovery FROM w""")
def _(v):
    out = mx.degradation_comparison(region_summary(v), "original", "degraded", "restored")
    return out.select("region", rd("loss", 5).alias("loss"), rd("gain", 5).alias("gain"), rd("recovery", 4).alias("recovery"))


@query("detection_metric_rows", """WITH a AS (SELECT name, CAST(box_id % 4 AS VARCHAR) AS distance, avg(score) AS ap FROM boxes GROUP BY ALL)
SELECT 'object/' || name || '_ap_dist_' || distance AS metric, round(ap + 1.3e-9, 4) AS value FROM a UNION ALL SELECT 'object/map', round((SELECT avg(ap) FROM a) + 1.3e-9, 4)""")
def _(v):
    per = v.boxes().groupBy("name", (c("box_id") % 4).cast("string").alias("distance")).agg((F.avg("score") + 1.3e-9).alias("ap"))
    results = per.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("distance", "ap"))).alias("m"))
    text = results.select(F.to_json(F.create_map("name", "m")).alias("payload"))
    return mx.detection_rows(text, "payload").withColumn("value", F.round("value", 4))


_LG = "(score * 6 - 3)"
_CE = f"(greatest({_LG}, 0) - {_LG} * label + ln(1 + exp(-abs({_LG}))))"
_P = f"(1 / (1 + exp(-{_LG})))"


@query("masked_loss_stats", f"""SELECT class_id, {r6(f'sum({_CE} * (1 - ({_P} * label + (1 - {_P}) * (1 - label))) ** 2 * supervised) / sum(supervised)', 5)} AS focal, {r6(f'sum({_CE} * supervised) / sum(supervised)', 5)} AS xent FROM map_cells GROUP BY class_id""")
def _(v):
    logit, target = c("score") * 6 - 3, c("label").cast("double")
    return v.map_cells().groupBy("class_id").agg(
        rd(mx.masked_mean(mx.focal_loss(logit, target), c("supervised")), 5).alias("focal"),
        rd(mx.masked_mean(mx.cross_entropy(logit, target), c("supervised")), 5).alias("xent"))


@query("latency_summary", f"""SELECT event_type, count(value) AS count, {r6('avg(value)', 4)} AS mean, {r6('quantile_cont(value, 0.5)', 4)} AS p50, {r6('quantile_cont(value, 0.95)', 4)} AS p95, {r6('quantile_cont(value, 0.99)', 4)} AS p99, {r6('min(value)', 4)} AS min, {r6('max(value)', 4)} AS max FROM events GROUP BY 1""")
def _(v):
    out = mx.latency_summary(v.table("events"), ["event_type"], "value")
    return out.select("event_type", "count", *[rd(k, 4).alias(k) for k in ("mean", "p50", "p95", "p99", "min", "max")])


@query("throughput_summary", f"""WITH r AS (SELECT event_type, user_id % 4 AS worker, count(*) AS samples, sum(value) / 100.0 AS seconds, avg(value) AS loss FROM events GROUP BY ALL)
SELECT event_type, CAST(sum(samples) AS BIGINT) AS samples, {r6('sum(samples) / greatest(max(seconds), 1e-12)', 4)} AS samples_per_s, {r6('max(seconds) * 1000 / sum(samples)', 4)} AS ms_per_sample, {r6('sum(loss * samples) / sum(samples)', 4)} AS loss FROM r GROUP BY 1""")
def _(v):
    runs = v.table("events").groupBy("event_type", (c("user_id") % 4).alias("worker")).agg(
        F.count("*").alias("samples"), (F.sum("value") / 100.0).alias("seconds"), F.avg("value").alias("loss"))
    out = mx.throughput_summary(runs, ["event_type"])
    return out.select("event_type", "samples", *[rd(k, 4).alias(k) for k in ("samples_per_s", "ms_per_sample", "loss")])


@query("shape_consistency", "SELECT frame_id // 10 AS scene_id, count(DISTINCT (h, w)) AS shapes FROM (SELECT frame_id, max(v) AS h, max(u) AS w FROM pixels GROUP BY 1) GROUP BY 1")
def _(v):
    shapes = v.pixels().groupBy("frame_id").agg(F.max("v").alias("h"), F.max("u").alias("w"))
    return shapes.groupBy(F.expr("frame_id div 10").alias("scene_id")).agg(F.countDistinct("h", "w").alias("shapes"))


@query("floor_plane_fit")
def _(v):
    # floor points: a tilted plane with small unevenness and outliers derived from the point table
    bump = (c("x") * 7.31 + c("z") * 13.7) % 1.0 * 0.02
    spike = F.when(c("l_partkey") % 13 == 0, 0.6).otherwise(0.0)
    pts = v.rawpoints().select("x", (c("x") * 0.02 + c("z") * 0.05 + 0.7 + bump + spike).alias("y"), "z")
    return v.spark.createDataFrame([mx.fit_floor_plane(pts)])
