"""Blocks of consecutive rows that send entries to hash buckets and get answers back.

A block is known by a hash of its ids and texts, so that a repeated scan finds the same blocks however
its rows are dealt out; a block without its answers is an error, never a silent gap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.wordhash import byte_chunks, bytes_of

RECORD = "block long, bucket long, payload binary"
RECORD_TYPE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary())])
PACKED = "block long, ids array<long>, ends array<long>, data binary"


def row_blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(block, ids, offsets, data) of runs of rows of about ``block_bytes`` of text."""
    for part in byte_chunks(batches, block_bytes):
        data, offsets = bytes_of(part.column(1))
        ids = part.column(0)
        seed = xxhash.xxh3_64_intdigest(np.asarray(ids.fill_null(-1)).tobytes() + offsets.tobytes())
        yield xxhash.xxh3_64_intdigest(data, seed=seed) >> 1, ids, offsets, data


def packed_blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row for each block, its texts compressed, for the way through a shuffle. The second level
    takes an eighth less room than the first for little more time."""
    codec = pa.Codec("zstd", compression_level=2)
    for block, ids, offsets, data in row_blocks(batches, block_bytes):
        yield pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())),
            pa.array([codec.compress(data.tobytes(), asbytes=True)], pa.binary())], names=["block", "ids", "ends", "data"])


def block_rows(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, data, offsets) of a packed block."""
    offsets = np.array(row["ends"], np.int64)
    data = np.frombuffer(pa.decompress(row["data"], int(offsets[-1]), "zstd", asbytes=True) if offsets[-1] else b"", np.uint8)
    return pa.array(row["ids"], pa.int64()), data, offsets


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
        if b > a:
            yield int(bucket[a]), int(a), int(b)


def record_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(RECORD_TYPE)], schema=RECORD_TYPE)


def gathered(replies: DataFrame, name: str) -> DataFrame:
    """The answers to each block in one row; they are bounded by what the block has sent."""
    return replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))
