"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.session import scratch_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Let the session's Arrow batches hold about ``size`` bytes, unless they are smaller: the usual
    64 MB of texts, and as much again in Python, are too much for a task with little memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(filter(str.isdigit, spark.conf.get(name)))) > size:
        spark.conf.set(name, str(size))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, as (doc_id long, text string). A null text counts as
    empty; all other columns stay behind, so their names cannot clash with the operator's own."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones, so that a task holds the Python strings of few rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def blocks_for(rows: int, rows_per_block: int) -> int:
    """Number of blocks or buckets that keeps each near ``rows_per_block`` rows."""
    return max(1, -(-rows // rows_per_block))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and continue from the written table."""
    folder = scratch_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_listed(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``; rows without id stay."""
    (listed,) = fresh(docs, "listed")
    return docs.join(ids.toDF(listed).distinct(), F.col(id_col).cast("long") == F.col(listed), "left_anti")
