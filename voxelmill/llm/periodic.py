"""Runs of repeated words in documents, found with suffix trees.

A run is a stretch of consecutive words with a smallest period that no neighbouring word extends. A task
first marks the stretches of a document that can hold one: with four periods or more, every three
words in a row of a run occur three times or more in its document. Each such stretch gets two suffix trees by
Ukkonen's rule, one of the words and one of their reversal. Their Euler tours, cut down to the leaves and the
nodes between neighbouring leaves, answer longest common extensions with two look-ups. The longest Lyndon
word from each place, in both orders of the words, is a candidate root; extended to both sides it gives
its run. Every run is found from one of its Lyndon roots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import id_text
from voxelmill.llm.wordhash import byte_chunks, mix

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUNS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA_TYPE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS_TYPE), ("collapsed", pa.string())])


def ukkonen(text: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """The suffix tree of ``text``, whose last symbol occurs once: for each node where its edge label
    begins and ends, and the child of (node << 32 | symbol). Node 0 is the root."""
    n = len(text)
    first, last, link, child = [0], [0], [0], {}
    node = edge = length = waiting = 0
    for i, symbol in enumerate(text):
        waiting += 1
        inner = 0
        while waiting:
            if not length:
                edge = i
            key = node << 32 | text[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                if inner:
                    link[inner] = node
                    inner = 0
            else:
                size = last[below] - first[below]
                if length >= size:
                    node, edge, length = below, edge + size, length - size
                    continue
                at = first[below] + length
                if text[at] == symbol:
                    length += 1
                    if inner:
                        link[inner] = node
                    break
                split = len(first)
                first += (first[below], i)
                last += (at, n)
                link += (0, 0)
                child[key] = split
                child[split << 32 | symbol] = split + 1
                child[split << 32 | text[at]] = below
                first[below] = at
                if inner:
                    link[inner] = split
                inner = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return first, last, child


class Extensions:
    """Ranks of all suffixes of ``text`` and the length that any two have in common."""

    def __init__(self, text: list[int]):
        n = len(text)
        first, last, child = ukkonen(text)
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)  # by node, then by symbol
        kids = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        ends = np.searchsorted(keys[order] >> 32, np.arange(len(first) + 1)).tolist()
        rank, between, depth = [0] * n, [], [0] * len(first)
        stack, met = [0], 0
        while stack:  # the Euler tour; ~node stands for coming back to a node before its next child
            node = stack.pop()
            if node < 0:
                between.append(depth[~node])
                continue
            a, b, here = ends[node], ends[node + 1], depth[node]
            if a == b:
                rank[n - here] = met
                met += 1
                continue
            for k in range(b - 1, a - 1, -1):
                kid = kids[k]
                depth[kid] = here + last[kid] - first[kid]
                stack.append(kid)
                if k > a:
                    stack.append(~node)
        self.rank_list, self.rank = rank, np.array(rank, np.int64)
        self.low = [np.array(between, np.int32)]
        while 1 << len(self.low) <= len(between):
            half = 1 << (len(self.low) - 1)
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes i and j, which differ."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            low = self.low[k]
            out[at] = np.minimum(low[a[at]], low[b[at] - (1 << k)])
        return out


def next_below(rank: list[int]) -> list[int]:
    """For each place the next one of smaller rank, or the end."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(symbols: np.ndarray, least_length: int, least_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``symbols`` (at least 1) that are long enough, in order."""
    n = len(symbols)
    ahead = Extensions([*symbols.tolist(), 0])
    back = Extensions([*symbols[::-1].tolist(), 0])
    smaller = np.array(next_below(ahead.rank_list))
    larger = np.array(next_below([n - r for r in ahead.rank_list]))
    at = np.tile(np.arange(n), 2)
    period = np.concatenate([smaller[:n], larger[:n]]) - at
    use = (at + period <= n) & (period * least_periods <= n)  # a root that holds the end mark is none
    at, period = at[use], period[use]
    right = ahead.common(at, at + period)
    left = back.common(n - at, n - at - period)
    length = period + left + right
    good = (length >= least_length) & (length >= least_periods * period)
    return sorted(set(zip((at - left)[good].tolist(), length[good].tolist(), period[good].tolist())), key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, row: np.ndarray, least_length: int) -> list[tuple[int, int]]:
    """(from, to) of the parts of joined documents in which every three words in a row occur three times
    or more in their document; all runs of four periods and six words lie inside."""
    if len(hashes) < least_length:
        return []
    three = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:]) + mix(row[2:].astype(np.uint64))
    inside = row[:-2] == row[2:]
    order = np.argsort(three)
    ranked = three[order]
    same = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.cumsum(same) - 1
    often = np.empty(len(three), bool)
    often[order] = (np.bincount(group) >= 3)[group]
    often &= inside
    edges = np.diff(np.concatenate([[0], often.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0) + 2
    # Two documents can meet only where no three words lie across their border.
    return [(a, b) for a, b in zip(begin.tolist(), end.tolist()) if b - a >= least_length]


def periodic_runs(docs: DataFrame, *, least_length: int = 6, least_periods: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    Words are runs of bytes other than space and 0x09-0x0D. ``runs`` holds all runs of at least
    ``least_length`` words (6 or more) and ``least_periods`` periods (4 or more) by start and period;
    ``collapsed`` is the text without the words that a run repeats, the others joined by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``; a null id stays null; repeated
    rows are answered each; an empty table gives no rows; other columns are ignored. Rows are treated one by
    one, so nothing is shuffled; memory grows with the longest repetitive stretch of one text, by about 400
    bytes a word.
    """
    if least_length < 6 or least_periods < 4:
        raise ValueError("stretches are found for six words and four periods or more")

    def run(batches):
        for batch in byte_chunks(batches, 1 << 18):
            texts = [t.encode().split() for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            row = np.repeat(np.arange(len(texts)), sizes)
            hashes = np.concatenate([np.fromiter(map(hash, t), np.int64, len(t)) for t in texts]).view(np.uint64)
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for a, b in stretches(hashes, row, least_length):
                k = int(row[a])
                base = a - int(starts[k])
                numbers: dict[bytes, int] = {}
                symbols = np.array([numbers.setdefault(w, len(numbers) + 1) for w in texts[k][base : base + b - a]], np.int64)
                found[k] += [(base + s, n, p) for s, n, p in runs_of(symbols, least_length, least_periods)]
            kept = []
            for words, runs in zip(texts, found):
                if runs:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for s, n, p in runs:
                        drop[s + p] += 1
                        drop[s + n] -= 1
                    words = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
                kept.append(b" ".join(words).decode())
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(rows, RUNS_TYPE), pa.array(kept, pa.string())], schema=SCHEMA_TYPE)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def sharpest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first, null without any."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    better = lambda best, r: best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted_period(id_col: Column, text: Column) -> Column:
    """Test texts with known runs: where the CRC-32 h of the decimal id is a multiple of 10, the words from
    the a-th on repeat the p words there, with g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = (F.floor((n - a) / p) + 1).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when(h % 10 == 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)
