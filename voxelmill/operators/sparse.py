"""Sparse-grid neighbourhoods: kernel pairs, pooling, weighted sums, dense scatter.

Kernel offsets are exploded per voxel (a fixed factor), so nothing is paired across a
whole frame; the following aggregates combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.operators import raster as rs
from voxelmill.operators.voxels import CELL, VoxelGrid
from voxelmill.skew import shuffled_join

c = F.col
OUT = ["frame_id", "ox", "oy", "oz"]


def _offsets(kernel: Sequence[int]) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("kernel"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("d"))
        for n, (a, b, d) in enumerate(product(*[range(k) for k in kernel]))]))


def _with_offsets(voxels: DataFrame, kernel: Sequence[int]) -> DataFrame:
    return voxels.withColumn("_o", _offsets(kernel)).withColumn("kernel", c("_o.kernel"))


def conv_pairs(voxels: DataFrame, shape: Sequence[int], kernel: Sequence[int], stride: int = 1,
               padding: int = 0, dilation: int = 1) -> DataFrame:
    """(input voxel, kernel offset, output voxel) of a strided kernel."""
    df = _with_offsets(voxels, kernel)
    test = F.lit(True)
    for k, off, size, n in zip("xyz", "abd", kernel, shape):
        out_n = (n + 2 * padding - dilation * (size - 1) - 1) // stride + 1
        num = c(f"c{k}") + padding - c(f"_o.{off}") * dilation
        df = df.withColumn(f"_n{k}", num)
        test = test & (c(f"_n{k}") >= 0) & (c(f"_n{k}") % stride == 0) & (F.floor(c(f"_n{k}") / stride) < out_n)
    df = df.where(test)
    for k in "xyz":
        df = df.withColumn(f"o{k}", F.floor(c(f"_n{k}") / stride)).drop(f"_n{k}")
    return df.drop("_o")


def submanifold_pairs(voxels: DataFrame, shape: Sequence[int], kernel: Sequence[int]) -> DataFrame:
    """As ``conv_pairs`` with stride 1, keeping only outputs that are active voxels.

    Active voxels are packed into words along z, so a voxel is sent to the columns of its kernel, not to every
    offset, and finds the active outputs of a column in one word. Kernels reach ``rs.HALO`` voxels along z at most.
    """
    pad = kernel[0] // 2
    halo = max(pad, kernel[2] - 1 - pad)
    if halo > rs.HALO:
        raise ValueError(f"a kernel may reach {rs.HALO} voxels along z")
    words = rs.to_words(voxels.select("frame_id", c("cx").alias("ox"), c("cy").alias("row"), c("cz").alias("col")), ["frame_id", "ox"], halo)
    sent = voxels.withColumn("_block", F.shiftright(c("cz").cast("bigint"), 5))
    out_n = [n + 2 * pad - size + 1 for size, n in zip(kernel, shape)]
    for k, size, n in zip("xy", kernel, out_n):
        sent = sent.withColumn(f"o{k}", F.explode(F.sequence(c(f"c{k}") + (pad - size + 1), c(f"c{k}") + pad).cast("array<bigint>")))
        sent = sent.where(c(f"o{k}").between(0, n - 1))
    met = shuffled_join(sent, words.withColumnRenamed("row", "oy"), ["frame_id", "ox", "oy", "_block"])
    met = met.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(kernel[2] - 1))))
    met = met.withColumn("oz", (c("cz") + pad - c("_d")).cast("bigint")).where(c("oz").between(0, out_n[2] - 1))
    met = met.where(F.getbit("_word", (c("oz") - c("_block") * rs.WORD + rs.HALO).cast("int")) == 1)
    number = ((c("cx") + pad - c("ox")) * kernel[1] + c("cy") + pad - c("oy")) * kernel[2] + c("_d")
    return met.select(*voxels.columns, number.cast("bigint").alias("kernel"), "ox", "oy", "oz")


def transposed_pairs(voxels: DataFrame, shape: Sequence[int], kernel: Sequence[int], stride: int,
                     padding: int, dilation: int = 1, out_padding: int = 0) -> DataFrame:
    df = _with_offsets(voxels, kernel)
    test = F.lit(True)
    for k, off, size, n in zip("xyz", "abd", kernel, shape):
        out_n = (n - 1) * stride - 2 * padding + size + out_padding
        df = df.withColumn(f"o{k}", c(f"c{k}") * stride - padding + c(f"_o.{off}") * dilation)
        test = test & (c(f"o{k}") >= 0) & (c(f"o{k}") < out_n)
    return df.where(test).drop("_o")


def max_pool(pairs: DataFrame, feature: str) -> DataFrame:
    """Largest feature per output voxel; outputs start at zero."""
    return pairs.groupBy(*OUT).agg(F.greatest(F.max(feature), F.lit(0.0)).alias(feature))


def conv_sum(pairs: DataFrame, feature: str, weights: Sequence[float]) -> DataFrame:
    """Sum of feature times the weight of its kernel offset; weights are a fixed literal array."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    return pairs.groupBy(*OUT).agg(F.sum(c(feature) * table[c("kernel").cast("int")]).alias(feature))


def sparsity(cells: DataFrame, g: VoxelGrid) -> DataFrame:
    lattice = float(g.shape[0] * g.shape[1] * g.shape[2])
    return cells.select(*CELL).distinct().groupBy("frame_id").agg((F.count("*") / lattice).alias("sparsity"))


def radar_decorate(cells: DataFrame, g: VoxelGrid, features: Sequence[str]) -> DataFrame:
    """Offset to the cell centre, coordinates scaled to 0..1, missing values as zero."""
    out = {f"p{k}": c(k) - ((c(f"c{k}") + 0.5) * g.size[i] + g.range[i]) for i, k in enumerate("xy")}
    out.update({f"s{k}": (c(k) - g.range[i]) / (g.range[i + 3] - g.range[i]) for i, k in enumerate("xyz")})
    out.update({f: F.coalesce(F.nanvl(c(f), F.lit(0.0)), F.lit(0.0)) for f in features})
    return cells.withColumns(out)


def _steps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def to_dense(frames: DataFrame, voxels: DataFrame, g: VoxelGrid, feature: str) -> DataFrame:
    """Full lattice per frame, zero where there is no voxel."""
    nx, ny, nz = g.shape
    lattice = frames.withColumn("cx", _steps(nx)).withColumn("cy", _steps(ny)).withColumn("cz", _steps(nz))
    return (shuffled_join(lattice, voxels.select(*CELL, feature), CELL, "left")
            .withColumn(feature, F.coalesce(feature, F.lit(0.0))))


def pillar_scatter(frames: DataFrame, pillars: DataFrame, g: VoxelGrid, feature: str) -> DataFrame:
    nx, ny, _ = g.shape
    lattice = frames.withColumn("cx", _steps(nx)).withColumn("cy", _steps(ny))
    return (shuffled_join(lattice, pillars, ["frame_id", "cx", "cy"], "left")
            .withColumn(feature, F.coalesce(feature, F.lit(0.0))))
