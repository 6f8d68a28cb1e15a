"""Repeated byte strings across documents, by hashes of content-chosen grams, then of whole strings.

This is not prefix doubling: no position-rank pairs are sorted and no offset grows. The first round names
only positions that the content itself chooses: of each string of ``length`` bytes the least gram
of ``gram`` bytes. Ranks are 64-bit names of the content. Positions whose name is unique drop out;
the rest are ranked again by all strings of ``length`` bytes around them, which ends the
search. Every string goes to the task of its gram, so equal strings always meet; all different
strings around one frequent gram meet there too, without a bound.

Texts are handled in blocks of consecutive rows. A block sends names to the buckets and gets one bit
back for each; equal entries of a block are sent once. A block is known by a hash of its rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.anchors import gram_hashes, window_groups
from voxelmill.llm.blocks import PACKED, RECORD, block_rows, by_bucket, gathered, packed_blocks, record_batch, row_blocks
from voxelmill.llm.common import blocks_for, fresh, id_text
from voxelmill.llm.wordhash import U, mix

class Block:
    """Texts of consecutive rows and their runs of strings."""

    def __init__(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, length: int, gram: int, buckets: int):
        self.ids, self.data, self.offsets, self.length = ids, data, offsets, length
        known = np.asarray(ids.is_valid())
        number = np.asarray(ids.fill_null(0))
        start, count, gram_hash = window_groups(data, offsets, length, gram)
        row = np.searchsorted(offsets, start, "right") - 1
        use = known[row]
        self.start, self.count, self.doc = start[use], count[use], number[row[use]]
        self.name = gram_hash[use] >> U(16)
        self.bucket = (self.name % U(buckets)).astype(np.int64)

    def names(self) -> tuple[np.ndarray, ...]:
        """Distinct names by bucket: (bucket, name, whether several ids have it), and for each run
        the place of its name."""
        order = np.lexsort((self.doc, self.name, self.bucket))
        name, doc, bucket = self.name[order], self.doc[order], self.bucket[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.empty(0, bool)
        place = np.empty(len(name), np.int64)
        place[order] = np.cumsum(new) - 1
        return bucket[first], name[first], several, place

    def regions(self, live: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct contents of the live runs by bucket: (bucket, start, count, least id), the live
        runs, and for each of these the place of its content."""
        runs = np.flatnonzero(live)
        start, count = self.start[runs], self.count[runs]
        total = np.empty(len(self.data) + 1, U)
        total[0] = 0
        first_string = gram_hashes(self.data, self.length)
        content = mix(first_string[start] + U(7) * first_string[start + count - 1] + count.astype(U)) if len(runs) else np.empty(0, U)
        # Strings between the first and the last one are joined in as sums over the run.
        np.cumsum(mix(first_string), out=total[1 : len(first_string) + 1]) if len(first_string) else None
        content = mix(content + (total[start + count] - total[start])) if len(runs) else content
        order = np.lexsort((self.doc[runs], content, self.bucket[runs]))
        new = np.ones(len(runs), bool)
        new[1:] = content[order][1:] != content[order][:-1]
        first = order[new]
        place = np.empty(len(runs), np.int64)
        place[order] = np.cumsum(new) - 1
        return self.bucket[runs][first], start[first], count[first], self.doc[runs][first], runs, place


def bits(payloads: list[dict] | None, bucket: np.ndarray) -> np.ndarray:
    """The answers of the buckets in the order of the entries sent."""
    out = np.zeros(len(bucket), bool)
    answers = {p["bucket"]: p["payload"] for p in payloads or []}
    for k, a, b in by_bucket(bucket):
        out[a:b] = np.unpackbits(np.frombuffer(answers[k], np.uint8), count=b - a)
    return out


def repeated_spans(
    docs: DataFrame, *, length: int = 50, gram: int = 24, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, span_starts, span_stops, text_sha, kept) of every row.

    A byte is removed when a string of ``length`` bytes that covers it also starts in a document
    with a smaller id; strings are judged on the input and never cross documents. ``kept`` has the
    other bytes, the arrays the maximal removed runs, ``text_sha`` the SHA-256 of the whole text. Null and empty texts have no bytes. Rows
    without an id neither remove nor lose bytes; rows of one id remove nothing from each other. An
    empty table gives no rows; other columns are ignored.
    """
    texts = id_text(docs, id_col, text_col)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = blocks_for(size, bucket_bytes)

    def send_names(batches):
        for block, ids, offsets, data in row_blocks(batches, block_bytes):
            bucket, name, several, _ = Block(ids, data, offsets, length, gram, buckets).names()
            short = np.ascontiguousarray(name).view(np.uint16).reshape(-1, 4)[:, :3]  # 48 bits
            rows = [(block, k, np.uint32(b - a).tobytes() + short[a:b].tobytes() + np.packbits(several[a:b]).tobytes()) for k, a, b in by_bucket(bucket)]
            if rows:
                yield record_batch(rows)

    def compare_names(table):
        names, several, sizes = [], [], []
        for p in table["payload"].to_pylist():
            n = int(np.frombuffer(p, np.uint32, 1)[0])
            wide = np.zeros((n, 4), np.uint16)
            wide[:, :3] = np.frombuffer(p, np.uint16, 3 * n, 4).reshape(n, 3)
            names.append(wide.reshape(-1).view(U))
            several.append(np.unpackbits(np.frombuffer(p, np.uint8, offset=4 + 6 * n), count=n).astype(bool))
            sizes.append(n)
        _, place, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        any_several = np.zeros(len(count), bool)
        any_several[place[np.concatenate(several)]] = True
        live = ((count > 1) | any_several)[place]
        return answers(table, live, sizes)

    def answers(table, found, sizes):
        ends = np.cumsum(sizes)
        rows = [(b, k, np.packbits(found[e - n : e]).tobytes()) for b, k, n, e in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), sizes, ends)]
        return pa.Table.from_batches([record_batch(rows)])

    def pack(batches):
        yield from packed_blocks(batches, block_bytes)

    def unpack(row) -> Block:
        return Block(*block_rows(row), length, gram, buckets)

    def rows_of(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.slice(k, 1).to_pylist()[0]

    def send_regions(batches):
        for row in rows_of(batches):
            block = unpack(row)
            bucket, _, _, place = block.names()
            bucket, start, count, doc, _, _ = block.regions(bits(row["live"], bucket)[place])
            rows = []
            for k, a, b in by_bucket(bucket):
                n = count[a:b] + length - 1
                at = np.repeat(start[a:b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                body = count[a:b].astype(np.uint16).tobytes() + doc[a:b].astype(np.int64).tobytes() + block.data[at].tobytes()
                rows.append((row["block"], k, np.array([b - a, len(body)], np.uint32).tobytes() + pa.compress(body, "zstd", asbytes=True)))
            if rows:
                yield record_batch(rows)

    def compare_regions(table):
        data, starts, owners, sizes, at = [], [], [], [], 0
        for p in table["payload"].to_pylist():
            n, whole = (int(x) for x in np.frombuffer(p, np.uint32, 2))
            body = pa.decompress(p[8:], whole, "zstd", asbytes=True)
            count = np.frombuffer(body, np.uint16, n).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(count + length - 1)[:-1]]) + at
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts.append(np.repeat(first, count) + within)
            owners.append(np.repeat(np.frombuffer(body, np.int64, n, 2 * n), count))
            data.append(np.frombuffer(body, np.uint8, offset=10 * n))
            at += len(data[-1])
            sizes.append(int(count.sum()))
        start, owner = np.concatenate(starts), np.concatenate(owners)
        name = gram_hashes(np.concatenate(data), length)[start]
        order = np.argsort(name, kind="stable")
        new = np.ones(len(name), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
        earlier = np.empty(len(name), bool)
        earlier[order] = least[np.cumsum(new) - 1] < owner[order]
        return answers(table, earlier, sizes)

    def remove(batches):
        for row in rows_of(batches):
            block = unpack(row)
            bucket, _, _, place = block.names()
            bucket, _, count, doc, runs, entry = block.regions(bits(row["live"], bucket)[place])
            ends = np.cumsum(count)
            found = bits(row["earlier"], np.repeat(bucket, count))
            n = block.count[runs]
            owner = np.repeat(np.arange(len(runs)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            strings = block.start[runs][owner] + within
            gone = found[(ends - count)[entry][owner] + within] | (block.doc[runs] > doc[entry])[owner]
            edge = np.zeros(len(block.data) + 1, np.int64)
            np.add.at(edge, strings[gone], 1)
            np.add.at(edge, strings[gone] + length, -1)
            yield from results(block, np.cumsum(edge[:-1]) > 0)

    def results(block, removed):
        offsets = block.offsets
        kept = block.data[~removed].tobytes()
        before = np.concatenate([[0], np.cumsum(~removed)])[offsets]
        start = removed.copy()
        start[1:] &= ~removed[:-1]
        bounds = offsets[:-1][np.diff(offsets) > 0]
        start[bounds] = removed[bounds]
        stop = removed.copy()
        stop[:-1] &= ~removed[1:]
        stop[bounds[1:] - 1] = removed[bounds[1:] - 1]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        row = np.searchsorted(offsets, starts, "right") - 1
        cut = np.searchsorted(row, np.arange(len(offsets)))
        base = offsets[row]
        for a in range(0, len(block.ids), 1024):
            b = min(a + 1024, len(block.ids))
            part = pa.array((cut[a : b + 1] - cut[a]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(part, pa.array((x - base)[cut[a] : cut[b]], pa.int64())) for x in (starts, stops)]
            size = np.diff(offsets[a : b + 1])
            left = np.diff(before[a : b + 1])
            yield pa.RecordBatch.from_arrays([
                block.ids.slice(a, b - a), pa.array(size), pa.array(size - left), *lists,
                pa.array([hashlib.sha256(block.data[i:j]).hexdigest() for i, j in zip(offsets[a:b], offsets[a + 1 : b + 1])], pa.string()),
                pa.array([kept[i:j] for i, j in zip(before[a:b], before[a + 1 : b + 1])], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "span_starts", "span_stops", "text_sha", "kept"])

    live = gathered(texts.mapInArrow(send_names, RECORD).groupBy("bucket").applyInArrow(compare_names, RECORD), "live")
    packed = texts.mapInArrow(pack, PACKED).join(live, "block", "left")
    earlier = gathered(packed.mapInArrow(send_regions, RECORD).groupBy("bucket").applyInArrow(compare_regions, RECORD), "earlier")
    schema = "doc_id long, n_bytes long, n_removed long, span_starts array<long>, span_stops array<long>, text_sha string, kept binary"
    return packed.join(earlier, "block", "left").mapInArrow(remove, schema)


def cut_spans(text: bytes, starts: list[int], stops: list[int]) -> str:
    """The text without the spans. A character that a span covers in part stays whole."""
    out, at = [], 0
    for a, b in zip(starts, stops):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode()


def without_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the found spans cut out of the text, and ``size_col`` (if the table has it) set
    to the new length. Rows without a span stay as they are; a text may become empty. Rows that
    share an id are told apart by their bytes, so each loses only its own spans."""
    doc, sha, mine, begins, ends = fresh(docs, "doc", "sha", "mine", "begins", "ends")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    marked = spans.filter(F.size("span_starts") > 0).select("doc_id", "text_sha", "span_starts", "span_stops").toDF(doc, sha, begins, ends).dropDuplicates([doc, sha])
    joined = docs.withColumn(mine, digest).join(marked, (F.col(id_col).cast("long") == F.col(doc)) & (F.col(mine) == F.col(sha)), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else cut_spans((t or "").encode(), list(a), list(b)) for t, a, b in zip(text, starts, stops)], dtype=object)

    text = F.when(F.col(begins).isNull(), F.col(text_col)).otherwise(cut(text_col, begins, ends))
    out = joined.withColumn(text_col, text)
    if size_col and size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.col(begins).isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(docs.schema[size_col].dataType))
    return out.select(*docs.columns)
