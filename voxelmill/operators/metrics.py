"""Statistics, map metrics, losses, latency summaries and the floor plane fit.

Counts for all thresholds come from one pass of conditional sums, so cells are never
multiplied by thresholds; medians and percentiles use rank slices instead of per-key
buffers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.operators import raster as rs
from voxelmill.session import cut_lineage
from voxelmill.skew import exact_quantiles, shuffled_join

c = F.col
EPS = 1e-7


def frame_statistics(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Point count, intensity faults, cells per class and observed cells of every frame."""
    per_point = points.groupBy("frame_id").agg(
        F.count("*").alias("point_count"),
        F.sum(((c("intensity") < 0) | (c("intensity") > 1)).cast("int")).alias("bad_intensity"))
    per_cell = cells.groupBy("frame_id").agg(
        *[F.sum(F.when(c("class_id") == k, c("label")).otherwise(0)).alias(f"class_{k}") for k in range(3)],
        F.sum("observed").alias("observed_sum"))
    return per_point.join(per_cell, "frame_id", "left").na.fill(0)


def scene_summary(stats: DataFrame, scene: Column) -> DataFrame:
    return stats.groupBy(scene.alias("scene_id")).agg(
        F.count("*").alias("frame_count"), F.min("point_count").alias("min_points"), F.max("point_count").alias("max_points"),
        F.avg("point_count").alias("mean_points"), *[F.sum(f"class_{k}").alias(f"class_{k}") for k in range(3)],
        F.sum("observed_sum").alias("observed_sum"))


def dataset_summary(scenes: DataFrame, split: Column) -> DataFrame:
    return scenes.groupBy(split.alias("split")).agg(
        F.count("*").alias("scenes"), F.sum("frame_count").alias("frames"), F.sum("observed_sum").alias("observed_sum"))


def quality_warnings(stats: DataFrame, cells_per_frame: int, split: Column, classes: int = 3) -> DataFrame:
    """Warnings (split, subject, warning): classes without cells, low coverage, point-count
    outliers beyond five times the median, intensity outside 0..1."""
    rows = stats.withColumn("split", split)
    totals = rows.groupBy("split").agg(
        *[F.sum(f"class_{k}").alias(f"class_{k}") for k in range(classes)],
        (F.sum("observed_sum") / (F.count("*") * F.lit(float(cells_per_frame)))).alias("coverage"))
    empty = totals.select("split", F.explode(F.array(*[
        F.when(c(f"class_{k}") == 0, F.lit(f"class {k}")) for k in range(classes)])).alias("subject")) \
        .where(c("subject").isNotNull()).withColumn("warning", F.lit("class never occurs"))
    low = totals.where(c("coverage") < 0.01).select(
        "split", F.lit("coverage").alias("subject"), F.lit("less than one cell in a hundred is observed").alias("warning"))
    median = exact_quantiles(rows, ["split"], "point_count", [0.5], ["median"])
    far = F.when(c("median") == 0, c("point_count") > 0).otherwise(
        (c("point_count") < c("median") / 5) | (c("point_count") > c("median") * 5))
    subject = F.concat(F.lit("frame "), c("frame_id").cast("string")).alias("subject")
    outlier = rows.join(median, "split").where(far).select(
        "split", subject, F.lit("point count outside five times the median").alias("warning"))
    bright = rows.where(c("bad_intensity") > 0).select("split", subject, F.lit("intensity not between 0 and 1").alias("warning"))
    return empty.unionByName(low).unionByName(outlier).unionByName(bright)


def class_distribution(frame_classes: DataFrame) -> DataFrame:
    """Frames per class and the share of each class in all (frame, class) pairs."""
    counts = frame_classes.select("frame_id", "name").distinct().groupBy("name").agg(F.count("*").alias("frames"))
    total = counts.agg(F.sum("frames").alias("t")).scalar()
    return counts.withColumn("share", c("frames") / total)


# Map metrics ------------------------------------------------------------------------------

def _counts(prefix: str, hit: Column, label: Column) -> list[Column]:
    one = lambda test: F.sum(test.cast("bigint"))
    return [one(hit & label).alias(f"{prefix}tp"), one(hit & ~label).alias(f"{prefix}fp"),
            one(~hit & label).alias(f"{prefix}fn")]


def map_confusion(cells: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("class_id",)) -> DataFrame:
    """tp, fp, fn per class and threshold; thresholds are single precision and inclusive."""
    label, score = c("label") == 1, c("score").cast("float")
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += _counts(f"t{i}_", score >= F.lit(t).cast("float"), label)
    wide = cells.groupBy(*keys).agg(*aggs, F.count("*").alias("valid"))
    entry = [F.struct(F.lit(float(t)).alias("threshold"), *[c(f"t{i}_{k}").alias(k) for k in ("tp", "fp", "fn")])
             for i, t in enumerate(thresholds)]
    return wide.select(*keys, "valid", F.inline(F.array(*entry)))


def with_scores(counts: DataFrame) -> DataFrame:
    """IoU, precision, recall and F1 from tp, fp, fn."""
    rows = counts.withColumns({
        "iou": c("tp") / (c("tp") + c("fp") + c("fn") + EPS), "precision": c("tp") / (c("tp") + c("fp") + EPS),
        "recall": c("tp") / (c("tp") + c("fn") + EPS)})
    return rows.withColumn("f1", 2 * c("precision") * c("recall") / (c("precision") + c("recall") + EPS))


def map_iou(cells: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """IoU rows per class and threshold, the maximum per class, and the mean of the maxima."""
    rows = with_scores(map_confusion(cells, thresholds))
    name = F.concat(F.lit("iou@"), F.format_number("threshold", 2))
    per = rows.select(c("class_id").cast("string").alias("class"), name.alias("metric"), c("iou").alias("value"))
    top = rows.groupBy("class_id").agg(F.max("iou").alias("value"))
    best = top.select(c("class_id").cast("string").alias("class"), F.lit("iou@max").alias("metric"), "value")
    mean = top.agg(F.avg("value").alias("value")).select(F.lit("mean").alias("class"), F.lit("iou@max").alias("metric"), "value")
    return per.unionByName(best).unionByName(mean)


def masked_map_metrics(cells: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per class: valid pixels, best IoU and the scores at 0.5 inside the supervision mask;
    means over classes with valid pixels, 0 when there is none."""
    masked = cells.withColumn("_m", c("supervised") == 1)
    at_half = [i for i, t in enumerate(thresholds) if abs(t - 0.5) < 1e-9][0]
    valid = masked.where(c("_m"))
    rows = with_scores(map_confusion(valid, thresholds))
    best = rows.groupBy("class_id").agg(F.max("iou").alias("iou_max"), F.max("valid").alias("valid_pixels"))
    half = rows.where(c("threshold") == float(thresholds[at_half])).select(
        "class_id", c("iou").alias("iou_50"), "precision", "recall", "f1")
    names = ["iou_max", "iou_50", "precision", "recall", "f1"]
    classes = cells.select("class_id").distinct()
    per = classes.join(best.join(half, "class_id"), "class_id", "left").na.fill(0)
    flat = per.select(c("class_id").cast("string").alias("class"), "valid_pixels", *names)
    mean = per.agg(*[F.coalesce(F.avg(F.when(c("valid_pixels") > 0, c(n))), F.lit(0.0)).alias(n) for n in names],
                   F.sum("valid_pixels").alias("valid_pixels"))
    return flat.unionByName(mean.select(F.lit("mean").alias("class"), "valid_pixels", *names))


def boundary_f1(cells: DataFrame, keys: Sequence[str], rows: int, cols: int, tolerance: int = 1) -> DataFrame:
    """Boundary precision, recall and F1 per class at threshold 0.5.

    Edges of prediction and truth count inside the eroded supervision mask; an edge cell is
    matched when the other edge comes within ``tolerance`` cells.
    """
    keys = list(keys)
    ident, word = [*keys, "row", "col"], [*keys, "row", "_block"]
    # words of 32 cells from here on; each of the three tables is read several times below, so it is written once
    core = cut_lineage(rs.core_words(cells.where(c("supervised") == 1).select(*ident), keys, tolerance, rows, cols)).withColumnRenamed("_bits", "_core")

    def edges(test):
        found = shuffled_join(rs.boundary_words(cells.where(test).select(*ident), keys, rows, cols), core, word)
        return cut_lineage(found.select(*word, c("_bits").bitwiseAND(c("_core")).alias("_bits")).where(c("_bits") != 0))

    pred, true = edges(c("score") >= 0.5), edges(c("label") == 1)

    def matched(a, b):
        near = rs.grown_words(b, keys, tolerance).withColumnRenamed("_bits", "_near")
        hit = c("_bits").bitwiseAND(F.coalesce("_near", F.lit(0).cast("bigint")))
        return shuffled_join(a, near, word, "left").groupBy("class_id").agg(
            F.sum(F.bit_count("_bits").cast("bigint")).alias("n"), F.sum(F.bit_count(hit).cast("bigint")).alias("m"))

    p = matched(pred, true).select("class_id", c("n").alias("pred"), c("m").alias("pred_matched"))
    t = matched(true, pred).select("class_id", c("n").alias("truth"), c("m").alias("truth_matched"))
    both = p.join(t, "class_id", "full").na.fill(0)
    both = both.withColumns({"precision": c("pred_matched") / (c("pred") + EPS), "recall": c("truth_matched") / (c("truth") + EPS)})
    return both.withColumn("f1", 2 * c("precision") * c("recall") / (c("precision") + c("recall") + EPS))


def region_metrics(cells: DataFrame, inside: Column) -> DataFrame:
    """Scores at 0.5 per region (missing, retained, full) and class; full is the union."""
    rows = cells.where(c("supervised") == 1).withColumn("region", F.when(inside, "missing").otherwise("retained"))
    hit, label = c("score") >= 0.5, c("label") == 1
    sets = rows.groupingSets([["region", "class_id"], ["class_id"]], "region", "class_id").agg(
        *_counts("", hit, label), F.count("*").alias("valid"))
    return with_scores(sets.withColumn("region", F.coalesce("region", F.lit("full"))))


def region_mode_summary(cells: DataFrame, inside: Column, scores: dict[str, Column]) -> DataFrame:
    """Mean IoU per region and model mode, over classes with valid cells."""
    rows = cells.where(c("supervised") == 1).withColumn("region", F.when(inside, "missing").otherwise("retained"))
    label = c("label") == 1
    aggs = []
    for mode, score in scores.items():
        aggs += _counts(f"{mode}_", score >= 0.5, label)
    sets = rows.groupingSets([["region", "class_id"], ["class_id"]], "region", "class_id").agg(*aggs)
    sets = sets.withColumn("region", F.coalesce("region", F.lit("full")))
    entry = [F.struct(F.lit(m).alias("mode"), *[c(f"{m}_{k}").alias(k) for k in ("tp", "fp", "fn")]) for m in scores]
    long = with_scores(sets.select("region", "class_id", F.inline(F.array(*entry))))
    return long.groupBy("region", "mode").agg(F.avg("iou").alias("mean_iou"), F.avg("f1").alias("mean_f1"))


def degradation_comparison(summary: DataFrame, base: str, degraded: str, restored: str) -> DataFrame:
    """Loss and recovery of mean IoU between modes; null where the divisor is zero or not finite."""
    wide = summary.groupBy("region").pivot("mode", [base, degraded, restored]).agg(F.first("mean_iou"))
    lost, won = c(base) - c(degraded), c(restored) - c(degraded)
    return wide.withColumns({"loss": lost, "gain": won,
                             "recovery": F.when((lost != 0) & ~F.isnan(lost), won / lost)})


def detection_rows(results: DataFrame, json_col: str) -> DataFrame:
    """One metric row per class and distance from nested result JSON, rounded to four digits,
    and the mean AP."""
    aps = F.from_json(c(json_col), "map<string, map<string, double>>")
    rows = results.select(F.explode(aps).alias("class", "_d")).select("class", F.explode("_d").alias("distance", "ap"))
    detail = rows.select(F.concat_ws("_", F.concat(F.lit("object/"), c("class")), F.lit("ap_dist"), c("distance")).alias("metric"),
                         F.round("ap", 4).alias("value"))
    mean = rows.agg(F.avg("ap").alias("value")).select(F.lit("object/map").alias("metric"), "value")
    return detail.unionByName(mean)


# Losses and latency -----------------------------------------------------------------------

def cross_entropy(logit: Column, target: Column) -> Column:
    """Binary cross entropy of a logit in its stable form."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(logit: Column, target: Column, alpha: float = -1.0, gamma: float = 2.0) -> Column:
    p = 1.0 / (1.0 + F.exp(-logit))
    hit = p * target + (1.0 - p) * (1.0 - target)
    loss = cross_entropy(logit, target) * F.pow(1.0 - hit, gamma)
    if alpha >= 0:
        loss = loss * (target * alpha + (1.0 - target) * (1 - alpha))
    return loss


def masked_mean(loss: Column, mask: Column) -> Column:
    """Mean of a loss over masked rows, 0 when no row is valid."""
    return F.coalesce(F.sum(loss * mask) / F.nullif(F.sum(mask), F.lit(0)), F.lit(0.0))


def latency_summary(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, p50, p95, p99 (linear), min and max per key."""
    simple = samples.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"),
                                        F.min(value).alias("min"), F.max(value).alias("max"))
    ranks = exact_quantiles(samples, keys, value, [0.5, 0.95, 0.99], ["p50", "p95", "p99"])
    return simple.join(ranks, list(keys))


def throughput_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples per second, milliseconds per sample, sample-weighted loss; the slowest worker
    sets the elapsed time."""
    out = runs.groupBy(*keys).agg(F.sum("samples").alias("samples"), F.max("seconds").alias("seconds"),
                                  (F.sum(c("loss") * c("samples")) / F.sum("samples")).alias("loss"))
    safe = F.greatest(c("seconds"), F.lit(1e-12))
    return out.withColumns({"samples_per_s": c("samples") / safe, "ms_per_sample": safe * 1000 / c("samples")})


# Floor plane ------------------------------------------------------------------------------

def fit_floor_plane(points: DataFrame, rounds: int = 6, low: float = 0.015, high: float = 0.05,
                    need: int = 100) -> dict[str, float]:
    """Robust plane ``y = a x + b z + c`` over all floor points.

    Each round is one aggregate of normal-equation sums plus exact median and MAD by rank
    slices; only ten numbers reach the driver.
    """
    pts = cut_lineage(points.select("x", "y", "z"))
    total = pts.count()
    if total < need:
        raise RuntimeError(f"the floor fit needs {need} points, the table has {total}")
    inlier: Column = F.lit(True)
    coef, kept = np.zeros(3), total
    for _ in range(rounds):
        chosen = pts.where(inlier)
        terms = {"xx": c("x") * c("x"), "xz": c("x") * c("z"), "zz": c("z") * c("z"), "xs": c("x"), "zs": c("z"),
                 "xy": c("x") * c("y"), "zy": c("z") * c("y"), "ys": c("y"), "n": F.lit(1.0)}
        s = chosen.agg(*[F.sum(e).alias(k) for k, e in terms.items()]).first()
        lhs = np.array([[s.xx, s.xz, s.xs], [s.xz, s.zz, s.zs], [s.xs, s.zs, s.n]])
        coef = np.linalg.solve(lhs, np.array([s.xy, s.zy, s.ys]))
        residual = c("y") - (c("x") * float(coef[0]) + c("z") * float(coef[1]) + float(coef[2]))
        rows = chosen.select(residual.alias("r"))
        median = exact_quantiles(rows, [], "r", [0.5], ["m"]).first().m
        mad = exact_quantiles(rows.select(F.abs(c("r") - median).alias("r")), [], "r", [0.5], ["m"]).first().m
        limit = min(high, max(low, 4.0 * 1.4826 * mad))
        updated = F.abs(residual - median) <= limit
        check = pts.agg(F.sum(updated.cast("bigint")).alias("n"),
                        F.sum((updated != inlier).cast("bigint")).alias("changed")).first()
        if check.n < need:
            raise RuntimeError("too few points lie near the floor plane")
        if check.changed == 0:
            break
        inlier, kept = updated, check.n
    a, b, d = (float(v) for v in coef)
    fitted = c("y") - (c("x") * a + c("z") * b + d)
    rmse = pts.where(inlier).agg(F.sqrt(F.avg(fitted * fitted)).alias("r")).first().r
    return {"a": a, "b": b, "c": d, "height": abs(d) / float(np.sqrt(a * a + 1.0 + b * b)),
            "points": total, "inliers": int(kept), "rmse": rmse}
