"""Token ids in length-delimited binary files with an offset index.

A shard ``<name>.rec`` starts with 8 bytes (``HEADER``, then the width of an id in bytes). A record is

    length of the payload   unsigned 64 bit
    checksum of the length  unsigned 32 bit
    payload                 ids, unsigned, ``width`` bytes each
    checksum of the payload unsigned 32 bit

all little-endian. A checksum is the CRC-32 of the bytes, masked by a rotation and a constant, so
that a checksum stored among data that is summed again stays meaningful. ``<name>.idx`` holds one
``INDEX`` entry for each record, by which a reader can fetch records in any order.

Tasks write under names of their own and return them; the manifest lists the files of the tasks
that succeeded. A repeated or lost task leaves only a file that no manifest names.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelmill.llm.common import id_text, pieces
from voxelmill.llm.pretokens import encoder_of

# The mask that framed record formats add to a rotated checksum.
MASK_ROTATION, MASK_DELTA = 15, 0xA282EAD8
HEADER = b"LDREC1\0"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "?"), ("offset", "<u8"), ("tokens", "<u8")])
MANIFEST = "first_id long, file string, n_docs long, n_tokens long"


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> MASK_ROTATION) | (crc << (32 - MASK_ROTATION))) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_checksum(length)), payload, struct.pack("<I", masked_checksum(payload))))


def unframe(stream) -> bytes:
    """The payload of the record that starts at the position of ``stream``; checks both sums."""
    length = stream.read(8)
    if len(length) < 8 or struct.unpack("<I", stream.read(4))[0] != masked_checksum(length):
        raise ValueError("record length is damaged")
    payload = stream.read(struct.unpack("<Q", length)[0])
    if struct.unpack("<I", stream.read(4))[0] != masked_checksum(payload):
        raise ValueError("record payload is damaged")
    return payload


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, seen from a task, and the path in it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write_records(
    docs: DataFrame, folder: str, vocabulary_path: str, pattern: str, *, end_id: int | None = 0,
    id_col: str = "doc_id", text_col: str = "text", cache_size: int = 400_000,
) -> DataFrame:
    """Write the ids of every text to ``folder`` in ascending id order; return the manifest.

    ``folder`` must be shared by all executors. Null texts are empty and have the end id alone; null
    ids come first; rows with one id follow each other in text order; an empty table writes no
    record. Shards are the partitions of a range shuffle, whose size the session sets.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(spec).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    kind = f"<u{width}"
    end = b"" if end_id is None else np.array([end_id], kind).tobytes()
    shared = docs.sparkSession.sparkContext.broadcast({"json": spec, "known": {}, "cache_size": cache_size})

    def pack(ids: list[int]) -> bytes:
        return np.array(ids, kind).tobytes()

    def write(batches):
        out, index, first, total, offset = None, [], None, 0, len(HEADER) + 1
        encoder = encoder_of(shared.value, pattern, pack)
        for batch in pieces(batches, 128):
            if out is None and batch.num_rows:
                store, base = open_store(folder)
                name, first = uuid.uuid4().hex, batch.column(0)[0].as_py()
                out = store.open_output_stream(f"{base}/{name}.rec")
                out.write(HEADER + bytes([width]))
            for doc_id, parts in zip(batch.column(0).to_pylist(), encoder.values(batch.column(1).to_pylist())):
                record = frame(b"".join(parts) + end)
                out.write(record)
                tokens = (len(record) - 16) // width
                index.append((doc_id or 0, doc_id is not None, offset, tokens))
                offset += len(record)
                total += tokens
        if out is not None:
            out.close()
            with store.open_output_stream(f"{base}/{name}.idx") as side:
                side.write(np.array(index, INDEX).tobytes())
            yield pa.RecordBatch.from_pylist([{"first_id": first, "file": name, "n_docs": len(index), "n_tokens": total}],
                                             schema=pa.schema([("first_id", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    ordered = id_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record: ``ids`` as little-endian unsigned 32-bit
    integers, ``start`` the number of ids before the record in the whole folder."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy(F.asc_nulls_first("first_id")).rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                store, base = open_store(folder)
                with store.open_input_file(f"{base}/{shard['file']}.idx") as side:
                    index = np.frombuffer(side.read(), INDEX)
                starts = shard["start"] + np.concatenate([[0], np.cumsum(index["tokens"])])[:-1].astype("i8")
                with store.open_input_stream(f"{base}/{shard['file']}.rec", buffer_size=1 << 20) as data:
                    head = data.read(len(HEADER) + 1)
                    if head[:-1] != HEADER:
                        raise ValueError(f"{shard['file']} is no record file")
                    for at in range(0, len(index), 256):
                        part = index[at : at + 256]
                        ids = [np.frombuffer(unframe(data), f"<u{head[-1]}").astype("<u4").tobytes() for _ in range(len(part))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["doc_id"], mask=~part["has_id"]), pa.array(starts[at : at + 256]), pa.array(part["tokens"].astype("i8")), pa.array(ids, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"])

    return shards.repartition(max(1, manifest.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_at(folder: str, file: str, position: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in a shard's index: (doc_id, ids), for shuffled reads."""
    store, base = open_store(folder)
    with store.open_input_file(f"{base}/{file}.idx") as side:
        side.seek(position * INDEX.itemsize)
        entry = np.frombuffer(side.read(INDEX.itemsize), INDEX)[0]
    with store.open_input_file(f"{base}/{file}.rec") as data:
        data.seek(len(HEADER))
        width = data.read(1)[0]
        data.seek(int(entry["offset"]))
        return int(entry["doc_id"]) if entry["has_id"] else None, np.frombuffer(unframe(data), f"<u{width}")
