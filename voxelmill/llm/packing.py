"""Documents packed into token windows of one size by multiway differencing.

Every document becomes its ids and an end id. Whole windows are cut off its front; the rests of a group
of documents are dealt to windows by Karmarkar-Karp differencing: each rest begins as a partial partition
(itself in one window, all others empty), and the two partitions with the largest imbalance are merged,
the fullest window of one with the emptiest of the other, until one is left. Its windows are nearly equal.
If one exceeds the capacity, the group is dealt again with more windows. Last, the emptiest windows are
taken apart: their rests fill the others to the brim, and what then remains forms sequences whose lengths
are powers of two, which need no padding either.
"""

from __future__ import annotations

import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from voxelmill.llm.common import id_text, pieces
from voxelmill.llm.pretokens import byte_letters

# The split pattern of public lower-case vocabularies with word ends, and what it means on
# texts of the characters below, whose classes and lower case are the same everywhere.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ȹȻ-ȽȿɁɃ-ɏ"
OTHER = re.compile(f"[^\x00-\x1b\x20-\x7e{LETTERS}]")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}ⱥⱦ]+|[0-9]|[^\s{LETTERS}ⱥⱦ0-9]+")

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SCHEMA_TYPE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                         ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class WordEncoder:
    """Ids of whole texts as the tokenizer library gives them, as little-endian unsigned 32-bit integers.

    Texts of plain characters are split and looked up word by word, words that are new come from the
    library's merge model; all other texts, and those with a special string, go to the library whole.
    """

    def __init__(self, tokenizer_json: str, cache_size: int = 400_000, longest_cached: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.cache, self.cache_size, self.longest = Tokenizer.from_str(tokenizer_json), {}, cache_size, longest_cached
        self.letters = byte_letters()
        spec = json.loads(tokenizer_json)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": WORD_PATTERN}
        self.specials = [x["content"] for x in spec.get("added_tokens") or []]

    def word(self, word: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_word or OTHER.search(text) or any(s in text for s in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = WORDS.findall(text.lower())
        found = list(map(self.cache.get, words))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    word = words[i]
                    known = self.cache.get(word) or self.word(word)
                    if len(self.cache) < self.cache_size and len(word) <= self.longest:
                        self.cache[word] = known
                    found[i] = known
        return b"".join(found)


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, so that the windows' sums are nearly equal."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    heap = [(-int(s), k) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merged: list[tuple[int, int, np.ndarray]] = []

    def of(node: int) -> np.ndarray:
        if node >= n:
            return sums.pop(node)
        alone = np.zeros(windows, np.int64)
        alone[0] = sizes[node]
        return alone

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = of(a) + of(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order] - both[order[-1]]
        node = n + len(merged)
        merged.append((a, b, order.astype(np.int32)))
        sums[node] = both
        heapq.heappush(heap, (-int(both[0]), node))
    window = np.zeros(n, np.int64)
    places = {heap[0][1]: np.arange(windows)}
    for node in range(n + len(merged) - 1, n - 1, -1):
        a, b, order = merged[node - n]
        here = np.empty(windows, np.int64)
        here[order] = places.pop(node)
        for child, at in ((a, here), (b, here[::-1])):
            if child < n:
                window[child] = at[0]
            else:
                places[child] = at
    return window


def balanced(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The pieces of each window; the number of windows rises until none exceeds the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, windows)
        most = int(np.bincount(window, sizes, windows).max())
        if most <= capacity:
            break
        windows = max(windows + 1, windows * most // capacity)
    members: list[list[int]] = [[] for _ in range(windows)]
    for k, w in enumerate(window.tolist()):
        members[w].append(k)
    return members


def sequences(sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, from, length). All are full but for the last, whose lengths are powers of two."""
    members = sorted(balanced(sizes, capacity), key=lambda ks: -int(sizes[ks].sum()))
    total = int(sizes.sum())
    full, rest = divmod(total, capacity)
    room = [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    out = [[(k, 0, int(sizes[k])) for k in ks] for ks in members[:full]] + [[] for _ in room[full:]]
    left = [(k, 0, int(sizes[k])) for ks in members[full:] for k in ks]
    for parts, most in zip(out, room):
        lack = most - sum(p[2] for p in parts)
        while lack:
            k, at, size = left.pop()
            take = min(lack, size)
            parts.append((k, at, take))
            lack -= take
            if take < size:
                left.append((k, at + take, size - take))
    return out


def pack_documents(
    docs: DataFrame, vocabulary_path: str, *, end_id: int, capacity: int = 2048, group_windows: int = 256,
    id_col: str = "doc_id", text_col: str = "text", cache_size: int = 400_000,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece: ``ids`` as
    little-endian unsigned 32-bit integers, ``start`` the ids of its document before it, ``doc_tokens``
    all ids of the document with the end id, ``offset`` the ids of its sequence before it.

    A task packs its own rows, ``group_windows`` windows of rests at a time, so nothing is shuffled and
    memory holds one group and one text. Null and empty texts are the end id alone; rows without id keep a
    null id; rows that share an id are documents of their own; an empty table gives no rows; other
    columns are ignored. Sequence ids are unique, those of a task rise; they are not consecutive.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast({"json": spec})
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches):
        if "words" not in shared.value:
            shared.value["words"] = WordEncoder(shared.value["json"], cache_size)
        encode, sequence = shared.value["words"].ids, TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held, rests, waiting = 0, [], 0

        def emit(parts):
            nonlocal sequence, held
            offset = 0
            for doc_id, ids, start, length in parts:
                rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset))
                offset += length
            held += offset
            sequence += 1

        def ready(least):
            nonlocal rows, held
            if rows and held >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), SCHEMA_TYPE)], schema=SCHEMA_TYPE)
                rows, held = [], 0

        def settle():
            nonlocal rests, waiting
            sizes = np.array([len(ids) // 4 - start for _, ids, start in rests], np.int64)
            for parts in sequences(sizes, capacity):
                emit([(rests[k][0], rests[k][1], rests[k][2] + at, size) for k, at, size in parts])
                yield from ready(1 << 19)
            rests, waiting = [], 0

        for batch in pieces(batches, 128):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n - capacity + 1, capacity):
                    emit([(doc_id, ids, start, capacity)])
                    yield from ready(1 << 19)
                if n % capacity:
                    rests.append((doc_id, ids, n - n % capacity))
                    waiting += n % capacity
                if waiting >= capacity * group_windows:
                    yield from settle()
        if rests:
            yield from settle()
        yield from ready(0)

    return id_text(docs, id_col, text_col).mapInArrow(pack, SCHEMA)
