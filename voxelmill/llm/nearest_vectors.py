"""Largest inner products by collision counting on single projections.

Vectors get one more component that gives all the same length, so that the largest inner product is
the nearest point. Every block of vectors is projected on ``projections`` random lines and keeps a sorted
array for each. A query opens a window around its own projection in every array; a vector collides
once for each window it lies in. The first window holds most vectors at least once, so in practice it is
the only one (it is doubled if too few collide), and the vectors whose collisions reach a quantile
of the block, the threshold that leaves enough of them, are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.llm.common import blocks_for, bound_batches

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class ProjectedBlock:
    """Vectors of one block with a sorted array of their places on each line."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, projections: int, seed: int):
        self.ids, self.vectors = ids, vectors
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        wide = vectors.astype(float)
        rest = np.sqrt(np.maximum(longest**2 - (wide**2).sum(1), 0))
        places = np.column_stack([wide, rest]) @ self.lines / longest
        self.order = np.argsort(places, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(places, self.order, 0).T.copy()
        self.order = self.order.T.copy()
        self.longest = longest

    def candidates(self, query: np.ndarray, width: float, enough: int) -> np.ndarray:
        """Vectors that collide often enough with the query."""
        if enough >= len(self.ids):
            return np.arange(len(self.ids))
        centre = query / np.linalg.norm(query) @ self.lines[:-1]
        while True:
            low = [np.searchsorted(row, c - width) for row, c in zip(self.sorted, centre)]
            high = [np.searchsorted(row, c + width, "right") for row, c in zip(self.sorted, centre)]
            hits = np.concatenate([row[a:b] for row, a, b in zip(self.order, low, high)])
            collisions = np.bincount(hits, minlength=len(self.ids))
            if np.count_nonzero(collisions) >= enough:
                break
            width *= 2
        at_least = np.cumsum(np.bincount(collisions, minlength=len(centre) + 1)[::-1])[::-1]  # by number of collisions
        threshold = np.flatnonzero(at_least >= enough)[-1]
        return np.flatnonzero(collisions >= threshold)

    def nearest(self, query_id: int, query: np.ndarray, k: int, width: float, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the best ``k`` candidates other than the query."""
        query = query.astype(float)
        at = self.candidates(query, width, enough)
        at = at[self.ids[at] != query_id]
        score = (self.vectors[at].astype(float) * query).sum(1)
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[best]], score[best]


def nearest_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20,
    projections: int = 64, width: float = 1.1, share: float = 0.25, least: int = 400, block_rows: int = 8192, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows with
    another id. Scores are inner products of the original vectors in double precision; ties go to
    the smaller id. Vectors that are null, zero, empty, or hold null or non-finite components, rows
    without an id, and vectors whose length is not the most common one take no part. Of rows with
    one id the least vector counts. With fewer than ``k`` candidates all are returned; an empty table
    gives no rows; other columns are ignored. In each block ``least`` + ``share`` of its vectors are
    compared, which finds nine tenths of the true neighbours or more (see the tests).
    """
    bound_batches(vectors.sparkSession)
    value = F.col("vector")
    sound = (F.size(value) > 0) & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector")).filter("vec_id is not null and vector is not null").filter(sound)
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    is_query = F.col("vec_id") % query_every == 0
    shapes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries"), F.max(length).alias("longest"))
    shape = shapes.orderBy(F.desc("n"), "size").first() or {"size": 0, "n": 0, "queries": 0, "longest": 1.0}
    size, longest = shape["size"], float(shape["longest"])
    data_blocks, query_blocks = blocks_for(shape["n"], block_rows), blocks_for(shape["queries"], block_rows)

    rows = rows.filter(F.size("vector") == size)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(data_blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    data = rows.select("vec_id", "vector", F.lit(False).alias("is_query"), block.alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.filter(is_query).select("vec_id", "vector", F.lit(True).alias("is_query"), every(data_blocks).alias("block"), query_block.alias("query_block"))

    def search(table):
        ids = table["vec_id"].to_numpy()
        values = np.asarray(table["vector"].combine_chunks().flatten(), np.float32).reshape(len(ids), size)
        asks = table["is_query"].to_numpy()
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if asks.any() and not asks.all():
            index = ProjectedBlock(ids[~asks], values[~asks], longest, projections, seed)
            enough = least + int(share * len(index.ids))
            for i in np.flatnonzero(asks):
                found, score = index.nearest(ids[i], values[i], k, width, enough)
                for column, part in zip(out, (np.full(len(found), ids[i]), found, score)):
                    column.append(part)
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=FOUND)

    found = data.union(queries).groupBy("block", "query_block").applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
