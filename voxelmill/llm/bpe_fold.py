"""Byte-level BPE by folding ranked merges with Spark's higher-order functions.

Blocks of texts send their distinct words to hash buckets, where each distinct word of the corpus
is folded once: Spark merges its array of byte ids by the ranks, which each bucket's row carries as two
arrays, so that no plan spells them out. The blocks get the ids of their words back and lay them out along their texts; decoding joins the binary pieces of
the ids.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.blocks import PACKED, RECORD, block_rows, gathered, packed_blocks, record_batch, row_blocks
from voxelmill.llm.common import blocks_for, id_text, pieces
from voxelmill.llm.pretokens import splitter

ID_BITS = 17
NO_RANK = (1 << ID_BITS) - 1
LOW = (1 << 2 * ID_BITS) - 1  # place and id of a piece
GROUPS, SLOTS = 1 << 15, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The rank of every pair of ids whose joined bytes are a piece."""
    return {(ranks[piece[:i]], ranks[piece[i:]]): rank for piece, rank in ranks.items() for i in range(1, len(piece)) if piece[:i] in ranks and piece[i:] in ranks}


def place_keys(pairs: dict[tuple[int, int], int]) -> tuple[int, list[int], list[int]]:
    """A hash table without collisions: (factor, shift of each group, entries).

    A pair belongs to a group; its slot is its hash plus the shift of the group. Groups are placed
    from the largest to the smallest, each with the first shift that hits free slots only.
    """
    for factor in range(7919, 1 << 20, 2 * 7919):
        groups = defaultdict(list)
        for (a, b), rank in pairs.items():
            groups[(a * 40_503 + b) % GROUPS].append(((a * factor + b * 31) % SLOTS, (a << ID_BITS | b) << ID_BITS | rank))
        shifts, entries = [0] * GROUPS, [0] * SLOTS
        for group, keys in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len({h for h, _ in keys}) < len(keys):
                break
            shift = next((d for d in range(SLOTS) if not any(entries[(h + d) % SLOTS] for h, _ in keys)), None)
            if shift is None:
                break
            shifts[group] = shift
            for h, entry in keys:
                entries[(h + shift) % SLOTS] = entry
        else:
            return factor, shifts, entries
    raise ValueError("too many pairs for the table")


def rank_tables(ranks: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """The ranks of pairs of ids: factor, shifts and entries. A lookup reads one entry."""
    factor, shifts, entries = place_keys(pair_ranks(ranks))
    return factor, np.array(shifts, np.int64), np.array(entries, np.int64)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def fold_merges(letters: Column, tables: Column) -> Column:
    """Ids of one word from the ids of its bytes: merge the leftmost pair of lowest rank until no
    pair has a rank.

    The state is an array of longs, one for each piece: from the high bits the rank of the pair with
    the next piece, the place of the piece in the word and its id. Its minimum is the pair to merge.
    """
    def id_of(x):
        return x.bitwiseAND(F.lit(NO_RANK))

    def place_of(x):
        return F.shiftright(x, ID_BITS).bitwiseAND(F.lit(NO_RANK))

    def rank_of(left, right):
        """Shifted to the high bits."""
        shift = F.get(tables["shifts"], ((left * 40_503 + right) % GROUPS).cast("int"))
        entry = F.get(tables["entries"], ((left * tables["factor"] + right * 31 + shift) % SLOTS).cast("int"))
        pair = left * (1 << ID_BITS) + right
        return let(entry, lambda e: F.when(F.shiftright(e, ID_BITS) == pair, e.bitwiseAND(F.lit(NO_RANK))).otherwise(F.lit(NO_RANK))) * (1 << 2 * ID_BITS)

    def with_next(x, after):
        """The piece ``x`` (place and id) before the piece ``after``, which is null at the end."""
        return x + F.when(after.isNull(), F.lit(NO_RANK << 2 * ID_BITS)).otherwise(rank_of(id_of(x), id_of(after)))

    start = F.transform(letters, lambda x, k: with_next(k.cast("long") * (1 << ID_BITS) + x.cast("long"), F.get(letters, k + 1).cast("long")))

    def merge(state, _):
        def at(low):
            def with_place(i):
                merged = place_of(low) * (1 << ID_BITS) + F.shiftright(low, 2 * ID_BITS)
                rest = F.filter(state, lambda x, k: k != i)
                return F.transform(rest, lambda x, k: F.when(k == i - 1, with_next(merged, F.get(state, i + 1)))
                                   .when(k == i - 2, with_next(x.bitwiseAND(F.lit(LOW)), merged)).otherwise(x))

            return F.when(F.shiftright(low, 2 * ID_BITS) < NO_RANK, let(F.size(F.filter(state, lambda x: x.bitwiseAND(F.lit(LOW)) <= low.bitwiseAND(F.lit(LOW)))), with_place)).otherwise(state)

        return let(F.array_min(state), at)

    folded = F.aggregate(F.slice(letters, 2, F.size(letters)), start, merge)
    return F.transform(folded, lambda x: id_of(x).cast("int"))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word in n log n steps, with a heap of pairs."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    start, after, before = list(range(n + 1)), list(range(1, n + 2)), list(range(-1, n))
    end = [i + 1 for i in range(n)]

    def rank(i: int) -> int | None:
        j = after[i]
        return ranks.get(word[i : end[j]]) if j < n else None

    heap = [(r, i, end[after[i]]) for i in range(n) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop or ranks.get(word[i:stop]) != _:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[word[i : end[i]]] for i in start[:n] if alive[i]]


def encode_decode(
    docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = 4 << 20, bucket_bytes: int = 3 << 20, fold_bytes: int = 256,
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: the ids as little-endian unsigned 32-bit
    integers and the bytes decoded from them.

    Ids are those of the rank file's library for the whole text without special tokens: each match
    of ``pattern`` is encoded apart. Null and empty texts have no ids; null ids stay null; repeated
    rows are encoded each; an empty table gives no rows; other columns are ignored. Words of more
    than ``fold_bytes`` bytes are merged with a heap in the tasks, as a fold over their arrays would
    take the square of their length; the merges are the same.
    """
    texts = id_text(docs, id_col, text_col)
    ranks = read_ranks(rank_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    factor, shifts, entries = rank_tables(ranks)
    tables = docs.sparkSession.sparkContext.broadcast((shifts, entries))
    del shifts, entries
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = blocks_for(size, bucket_bytes)
    narrow = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
    width = np.dtype(narrow).itemsize

    def split(data: np.ndarray, offsets: np.ndarray, find):
        """The words of each text."""
        text = data.tobytes()
        return [find(text[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def distinct(found: list[list[str]]) -> list[str]:
        """The distinct words, in any order."""
        return list(set().union(*found))

    def sent(words: list[bytes]) -> dict[int, list[bytes]]:
        """The words to fold, by bucket: those that are no piece themselves and not too long. They are
        sorted, as neighbours that begin alike travel in less room, and so do their ids."""
        out, table, crc32 = defaultdict(list), shared.value, zlib.crc32
        for w in words:
            if w not in table and len(w) <= fold_bytes:
                out[crc32(w) % buckets].append(w)
        for ws in out.values():
            ws.sort()
        return out

    def send(batches):
        find = splitter(pattern, by_ranks=True)
        for block, _, offsets, data in row_blocks(batches, block_bytes):
            rows = [(block, k, pack(np.array([len(w) for w in ws], np.uint16).tobytes() + b"".join(ws), len(ws))) for k, ws in sent([w.encode() for w in distinct(split(data, offsets, find))]).items()]
            if rows:
                yield record_batch(rows)

    def meet(table):
        """One row for each bucket: its distinct words, for each block the places of its words, and the ranks."""
        words, places = {}, []
        for p in table["payload"].to_pylist():
            n, body = unpack(p)
            ends = (np.cumsum(np.frombuffer(body, np.uint16, n), dtype=np.int64) + 2 * n).tolist()
            places.append(np.fromiter((words.setdefault(body[a:b], len(words)) for a, b in zip([2 * n, *ends], ends)), np.int32, n).tobytes())
        byte_ids = np.array([shared.value[bytes([i])] for i in range(256)], np.int16)
        ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
        letters = pa.ListArray.from_arrays(pa.array(ends), pa.array(byte_ids[np.frombuffer(b"".join(words), np.uint8)]))
        shifts, entries = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in tables.value)
        return pa.table([table["bucket"].slice(0, 1), pa.array([table["block"].to_pylist()], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.binary())),
                         pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), letters), shifts, entries], names=["bucket", "blocks", "places", "words", "shifts", "entries"])

    def answer(batches):
        for batch in pieces(batches, 1):
            row = dict(zip(batch.schema.names, batch.columns))
            flat = row["words"].flatten()
            size = np.diff(flat.offsets.to_numpy())
            start = np.cumsum(size) - size
            ids = flat.flatten().to_numpy(zero_copy_only=False).astype(narrow)
            for block, places in zip(row["blocks"][0].as_py(), row["places"][0].as_py()):
                at = np.frombuffer(places, np.int32)
                n = size[at]
                take = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield record_batch([(block, row["bucket"][0].as_py(), pack(n.astype(np.uint16).tobytes() + ids[take].tobytes(), len(at)))])

    def lay_out(batches):
        find = splitter(pattern, by_ranks=True)
        table = shared.value
        spelled = [b""] * (max(table.values()) + 1)
        for piece, rank in table.items():
            spelled[rank] = piece
        spelled = pa.array(spelled, pa.large_binary())
        for batch in pieces(batches, 1):
            row = batch.to_pylist()[0]
            doc_ids, data, offsets = block_rows(row)
            found = split(data, offsets, find)
            spellings = distinct(found)
            words = [w.encode() for w in spellings]
            answers = {a["bucket"]: unpack(a["payload"]) for a in row["answers"] or []}
            folded = {}
            for k, ws in sent(words).items():
                n, body = answers.pop(k)
                ends = (width * np.cumsum(np.frombuffer(body, np.uint16, n), dtype=np.int64) + 2 * n).tolist()
                folded.update(zip(ws, (body[a:b] for a, b in zip([2 * n, *ends], ends))))
            own = table.get
            ids = {}
            for word, w in zip(spellings, words):
                rank = own(w)
                ids[word] = folded.get(w) or (rank.to_bytes(width, "little") if rank is not None else np.array(merge_long(w, table), narrow).tobytes())
            del folded, words
            for a in range(0, len(doc_ids), 256):
                coded = [b"".join(map(ids.__getitem__, ws)) for ws in found[a : a + 256]]
                ends = np.cumsum([0, *map(len, coded)]) // width
                flat = np.frombuffer(b"".join(coded), narrow).astype("<u4")
                taken = spelled.take(pa.array(flat))
                letters = np.frombuffer(taken.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(a, 256), pa.array(np.diff(ends)), joined(4 * ends, pa.py_buffer(flat.tobytes())), joined(letters[ends], taken.buffers()[2])],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    met = texts.mapInArrow(send, RECORD).groupBy("bucket").applyInArrow(
        meet, "bucket long, blocks array<long>, places array<binary>, words array<array<short>>, shifts array<long>, entries array<long>")
    own_tables = F.struct(F.lit(factor).cast("long").alias("factor"), "shifts", "entries")
    folded = met.select("bucket", "blocks", "places", let(own_tables, lambda t: F.transform("words", lambda w: fold_merges(w, t))).alias("words"))
    packed = texts.mapInArrow(lambda batches: packed_blocks(batches, block_bytes), PACKED)
    return packed.join(gathered(folded.mapInArrow(answer, RECORD), "answers"), "block", "left").mapInArrow(lay_out, "doc_id long, n_tokens long, ids binary, decoded binary")


def joined(ends: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    """One binary value from each end to the next, over bytes that lie side by side."""
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), data or pa.py_buffer(b"")])
    return whole.cast(pa.binary())


def pack(body: bytes, n: int) -> bytes:
    return np.array([n, len(body)], np.uint32).tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpack(payload: bytes) -> tuple[int, bytes]:
    n, size = (int(x) for x in np.frombuffer(payload, np.uint32, 2))
    return n, pa.decompress(payload[8:], size, "zstd", asbytes=True)
