"""Chains of named steps, bundles of tables, and SQL names of common expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from voxelmill.operators import degrade, voxels

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}
TABLES = ("frames", "points", "boxes", "poses")

# SQL helpers: name -> (arguments, result type, expression).
SQL_HELPERS = {
    "wrap_angle": ("a DOUBLE", "DOUBLE", "a - floor((a + pi()) / (2 * pi())) * 2 * pi()"),
    "turn_x": ("x DOUBLE, y DOUBLE, a DOUBLE", "DOUBLE", "x * cos(a) - y * sin(a)"),
    "turn_y": ("x DOUBLE, y DOUBLE, a DOUBLE", "DOUBLE", "x * sin(a) + y * cos(a)"),
    "grid_cell": ("v DOUBLE, low DOUBLE, size DOUBLE", "BIGINT", "CAST(floor((v - low) / size) AS BIGINT)"),
}


def step(name: str) -> Callable[[Step], Step]:
    """Register ``fn(df, **parameters)`` as a step."""

    def register(fn: Step) -> Step:
        if name in STEPS:
            raise ValueError(f"step {name} is registered twice")
        STEPS[name] = fn
        return fn

    return register


def resolve(chain: Sequence[Mapping[str, Any]]) -> Callable[[DataFrame], DataFrame]:
    """A function of one table from a list such as ``[{"step": "voxel_mean", "grid": g}]``. Names
    and parameters are checked at once; the result is one lazy plan."""
    parts = []
    for entry in chain:
        parameters = dict(entry)
        name = parameters.pop("step")
        if name not in STEPS:
            raise KeyError(f"no step named {name}; known are {', '.join(sorted(STEPS))}")
        parts.append((STEPS[name], parameters))

    def run(df: DataFrame) -> DataFrame:
        for fn, parameters in parts:
            df = fn(df, **parameters)
        return df

    return run


def bundle(spark: SparkSession, folder: str, names: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """The tables of a data set that was written as one Parquet folder each."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_bundle(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def register_sql_helpers(spark: SparkSession) -> None:
    """Make ``SQL_HELPERS`` callable from SQL. They are SQL functions, so the optimizer sees through."""
    for name, (arguments, result, body) in SQL_HELPERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


@step("keep_where")
def keep_where(df: DataFrame, condition: str) -> DataFrame:
    return df.where(condition)


@step("with_columns")
def with_columns(df: DataFrame, **columns: str) -> DataFrame:
    return df.selectExpr("*", *[f"{text} AS {name}" for name, text in columns.items()]) if not set(columns) & set(df.columns) else \
        df.selectExpr(*[n for n in df.columns if n not in columns], *[f"{text} AS {name}" for name, text in columns.items()])


@step("voxel_mean")
def voxel_mean(df: DataFrame, grid: voxels.VoxelGrid, features: Sequence[str]) -> DataFrame:
    return voxels.voxel_mean(df, grid, features)


@step("rot_scale_trans")
def rot_scale_trans(df: DataFrame, seed: int, turn: Sequence[float], scale: Sequence[float], shift: float, epoch: int = 0) -> DataFrame:
    drawn = degrade.augmentation_parameters(df, seed, turn, scale, shift, epoch)
    return degrade.rot_scale_trans_points(drawn).select(*df.columns)


@step("flip")
def flip(df: DataFrame, seed: int) -> DataFrame:
    return degrade.random_flip_points(degrade.flip_parameters(df, seed)).select(*df.columns)


@step("degrade_density")
def degrade_density(df: DataFrame, ratio: float, seed: int) -> DataFrame:
    return degrade.degrade_density(df, ratio, seed)
