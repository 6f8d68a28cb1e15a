"""Sliced windows equal plain windows when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelmill.operators.batches import map_groups
from voxelmill.skew import exact_quantiles, value_slices, with_lag, with_row_number, with_running

c = F.col


@pytest.fixture(scope="module", params=[1, 8])
def rows(spark, request):
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"k": key, "id": np.arange(n), "t": rng.permutation(n) * 7, "v": rng.integers(0, 50, n).astype(float)})
    return spark.createDataFrame(pdf).repartition(request.param)


def same(a, b):
    cols = sorted(a.columns)
    rows = [sorted((tuple(r) for r in df.select(cols).collect()), key=str) for df in (a, b)]
    assert rows[0] == rows[1]


def by_time():
    return Window.partitionBy("k").orderBy("t")


def test_row_number(rows):
    got = with_row_number(rows, ["k"], [c("t")], F.expr("t div 500"), "rn")
    same(got, rows.withColumn("rn", F.row_number().over(by_time()).cast("bigint")))


def test_row_number_over_value_slices(rows):
    sliced = value_slices(rows, ["k"], "t", rows_per_slice=100, out="s")
    assert sliced.where("k = 0").select("s").distinct().count() > 5
    got = with_row_number(sliced, ["k"], [c("t")], c("s"), "rn").drop("s")
    same(got, rows.withColumn("rn", F.row_number().over(by_time()).cast("bigint")))


def test_row_number_without_key(rows):
    got = with_row_number(rows, [], [c("t")], F.expr("t div 500"), "rn")
    assert sorted(r.rn for r in got.collect()) == list(range(1, 3001))


def test_lag_crosses_empty_slices(rows):
    thin = rows.where("t % 5 = 0")
    got = with_lag(thin, ["k"], ["t"], F.expr("t div 11"), {"before": "v"})
    same(got, thin.withColumn("before", F.lag("v").over(by_time())))


def test_running(rows):
    got = with_running(rows, ["k"], ["t"], F.expr("t div 300"), {"total": ("sum", "v"), "top": ("max", "v"), "low": ("min", "v")})
    w = by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same(got, rows.withColumns({"total": F.sum("v").over(w), "top": F.max("v").over(w), "low": F.min("v").over(w)}))


def test_quantiles(rows):
    got = exact_quantiles(rows, ["k"], "v", [0.5, 0.95, 0.0099], ["a", "b", "d"]).toPandas().set_index("k")
    pdf = rows.toPandas()
    for k, part in pdf.groupby("k"):
        assert np.allclose(got.loc[k], np.quantile(part.v, [0.5, 0.95, 0.0099]))
    whole = exact_quantiles(rows, [], "v", [0.5], ["m"]).first().m
    assert whole == np.median(pdf.v)


def test_groups_stay_whole_across_arrow_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        def count(pdf):
            return pdf.groupby("k", as_index=False).agg(n=("id", "size"))
        got = map_groups(rows.select("k", "id"), ["k"], [c("id")], count, "k bigint, n bigint")
        same(got, rows.groupBy("k").agg(F.count("*").alias("n")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_far_values_leave_even_slices(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=20_000), [1e12, -1e12, 1e300], np.full(3000, 0.25)])
    pdf = pd.DataFrame({"k": np.where(np.arange(len(v)) % 10 == 0, 1, 0), "id": range(len(v)), "v": v})
    df = spark.createDataFrame(pdf)
    sliced = value_slices(df, ["k"], "v", rows_per_slice=1000, out="s").toPandas()
    hot = sliced[(sliced.k == 0) & (sliced.v != 0.25)]
    assert hot.groupby("s").size().max() < 5 * len(hot) / 64  # no slice holds most rows
    order = sliced[sliced.k == 0].sort_values("v")
    assert order.s.is_monotonic_increasing and sliced.groupby(["k", "v"]).s.nunique().max() == 1
    got = exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.99, 1.0], ["a", "b", "c", "d"]).toPandas().set_index("k")
    for key, part in pdf.groupby("k"):
        assert got.loc[key].tolist() == pytest.approx(np.quantile(part.v, [0.0, 0.5, 0.99, 1.0]).tolist())


def test_joins_of_growing_tables_are_not_broadcast(spark):
    from voxelmill.operators import joins as jn
    from voxelmill.operators import suppress as sp

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()

    points = spark.range(40).select((c("id") % 4).alias("frame_id"), c("id").alias("point_id"), *[(c("id") * 1.0).alias(k) for k in "xyz"], F.lit(0.5).alias("intensity"))
    centres = spark.range(4).select(c("id").alias("frame_id"), c("id").alias("centre_id"), *[F.lit(1.0).alias("c_" + k) for k in "xyz"])
    boxes = spark.createDataFrame([(i % 4, i, i, float(i), "a", *[1.0] * 7) for i in range(8)],
                                  ["frame_id", "box_id", "det_id", "score", "name", "x", "y", "z", "dx", "dy", "dz", "yaw"])
    ball = jn.ball_query(points, centres, 0.0, 5.0, 4)
    found = [ball, jn.query_and_group(points, centres, ball), jn.box_pairs(boxes, boxes), jn.points_in_boxes_all(points, boxes),
             sp.nms(boxes, ["frame_id"], "det_id", sp.circle(4.0)), jn.heuristic_assign(boxes.withColumn("gt_id", c("box_id")), boxes.withColumn("pred_id", c("det_id")), 9.0)]
    for df in found:
        optimized, physical = plan(df)
        assert "Join" in optimized and "BroadcastHashJoin" not in physical
