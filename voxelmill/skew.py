"""Ordered computations that survive one key holding a large share of all rows.

A plain window sends a whole key to one task. The helpers here split every key into
ordered slices (``bucket``: any column that never decreases along the order), run the
window inside ``(key, slice)`` and repair the slice borders with a small table that has
one row per slice. Slices that depend only on the row itself (``id >> 20``, the hour of a
time stamp) need no extra pass; ``value_slices`` derives them from counted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _cols(keys: Keys) -> list[Column]:
    return [F.col(k) for k in keys]


SALTS = 8


def shuffled_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the input. The planner derives sizes from compressed files and does not
    count what an explode adds, also behind a checkpoint, and would send millions of rows through the driver as
    a broadcast; the hint has both sides shuffled."""
    return left.join(right.hint("merge"), on, how)


def spread_join(rows: DataFrame, keys: Keys, spread: Column, per_key: DataFrame) -> DataFrame:
    """Join of rows with a table of one or few rows a key: each key's rows are dealt over ``SALTS`` join
    keys by the hash of ``spread``, and the small table travels in as many copies."""
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def value_slices(df: DataFrame, keys: Keys, value: str, rows_per_slice: int = 1 << 20,
                 out: str = "_slice") -> DataFrame:
    """Add an order-preserving slice number to the rows of each key.

    Keys of more than ``rows_per_slice`` rows are cut at 63 percentiles of a sixteenth of their values, so
    that a few far values leave even slices; very large slices are cut further by width. The
    cuts only tune the cost: equal values always share a slice, and slices follow the values.
    """
    v = F.col(value).cast("double")
    drawn = F.pmod(F.xxhash64(value), F.lit(16)) == 0
    cuts = F.percentile_approx(F.when(drawn, v), [i / 64 for i in range(1, 64)], 1000)
    big = F.count("*") > rows_per_slice
    parts = F.struct(F.when(big, cuts).alias("cuts"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                     F.ceil(F.count("*") / F.lit(64.0 * rows_per_slice)).alias("n"))
    joined = with_group_value(df, keys, parts, "_range", value)
    r = F.col("_range")
    above = F.size(F.filter(r.cuts, lambda x: x <= v))
    low, high = F.coalesce(F.get(r.cuts, above - 1), r.lo), F.coalesce(F.get(r.cuts, above), r.hi)
    inside = F.least(F.floor((v - low) / F.greatest(high - low, F.lit(1e-300)) * r.n), r.n - 1)
    slice_ = F.when(r.cuts.isNotNull(), above * r.n + inside).otherwise(0).cast("bigint")
    return joined.withColumn(out, slice_).drop("_range")


def with_group_value(df: DataFrame, keys: Keys, value: Column, out: str, spread: str) -> DataFrame:
    """Add an aggregate of each key's rows to the rows; a large key is dealt out by the hash of ``spread``.
    Without keys the aggregate is a scalar subquery."""
    if not keys:
        return df.withColumn(out, df.agg(value.alias(out)).scalar())
    return spread_join(df, keys, F.col(spread), df.groupBy(*keys).agg(value.alias(out)))


def with_row_number(df: DataFrame, keys: Keys, order: Sequence[Column], bucket: Column,
                    out: str = "rn") -> DataFrame:
    """1-based position of each row inside its key, exact, without one task per key."""
    keys = list(keys)
    sliced = df.withColumn("_slice", bucket)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    running = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .drop("_n")
    )
    return (
        sliced.withColumn("_local", F.row_number().over(local))
        .join(offsets, keys + ["_slice"])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before", "_slice")
    )


def with_lag(df: DataFrame, keys: Keys, order: Sequence[str], bucket: Column,
             cols: dict[str, str]) -> DataFrame:
    """Values of the previous row inside the key; ``cols`` maps output name to source column."""
    keys = list(keys)
    sliced = df.withColumn("_slice", bucket)
    packed = F.struct(*[F.col(src).alias(out) for out, src in cols.items()])
    rank = F.struct(*[F.col(c) for c in order])
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    border = (
        sliced.groupBy(*keys, "_slice").agg(F.max_by(packed, rank).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")))
        .drop("_last")
    )
    found = (
        sliced.withColumn("_prev", F.lag(packed).over(local))
        .join(border, keys + ["_slice"])
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
    )
    for out in cols:
        found = found.withColumn(out, F.col(f"_prev.{out}"))
    return found.drop("_prev", "_carry", "_slice")


def with_running(df: DataFrame, keys: Keys, order: Sequence[str], bucket: Column,
                 aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` up to and including the row, per key."""
    keys = list(keys)
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    join2 = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + b,
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
    }
    sliced = df.withColumn("_slice", bucket)
    local = (Window.partitionBy(*keys, "_slice").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = (Window.partitionBy(*keys).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = sliced.groupBy(*keys, "_slice").agg(
        *[fns[fn](src).alias(f"_t_{out}") for out, (fn, src) in aggs.items()]
    )
    for out, (fn, _) in aggs.items():
        totals = totals.withColumn(f"_c_{out}", fns[fn](f"_t_{out}").over(before))
    totals = totals.drop(*[f"_t_{out}" for out in aggs])
    result = sliced
    for out, (fn, src) in aggs.items():
        result = result.withColumn(out, fns[fn](src).over(local))
    result = result.join(totals, keys + ["_slice"])
    for out, (fn, _) in aggs.items():
        result = result.withColumn(out, join2[fn](F.col(f"_c_{out}"), F.col(out)))
    return result.drop("_slice", *[f"_c_{out}" for out in aggs])


def exact_quantiles(df: DataFrame, keys: Keys, value: str, points: Sequence[float],
                    names: Sequence[str]) -> DataFrame:
    """Linear-interpolated quantiles per key from value counts; no per-key buffer.

    Equal values are merged before anything is ranked, then the rank of each value is a
    running sum over value slices.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counted = with_group_value(counted, keys, F.sum("_n"), "_total", value)
    sliced = value_slices(counted, keys, value, out="_vs")
    ranked = with_running(sliced, keys, [value], F.col("_vs"), {"_upto": ("sum", "_n")}).drop("_vs")
    last = F.col("_upto") - 1
    first = F.col("_upto") - F.col("_n")
    picks = []
    for i, q in enumerate(points):
        target = F.lit(float(q)) * (F.col("_total") - 1)
        lo, hi = F.floor(target), F.ceil(target)
        picks.append(F.max(F.when((first <= lo) & (lo <= last), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.max(F.when((first <= hi) & (hi <= last), F.col(value))).alias(f"_hi{i}"))
        picks.append(F.max(target - F.floor(target)).alias(f"_w{i}"))
    out = ranked.groupBy(*keys).agg(*picks)
    return out.select(*keys, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(name)
        for i, name in enumerate(names)
    ])


def split_by_group_size(df: DataFrame, keys: Keys, bound: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups with at most ``bound`` rows, and rows of larger groups."""
    keys = list(keys)
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > bound).drop("_n")
    return df.join(big, keys, "left_anti"), df.join(big, keys, "left_semi")
