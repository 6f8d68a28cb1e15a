"""Benchmark items inside documents: word n-grams as seeds, then local alignment.

Every n-gram of every item is a seed, however common it is. A choice of the rarest ones would lose
edited copies: the n-grams that an edit touches are the rarest, and the copy does not hold them. Where
a document holds seeds and enough of the item's words, its words around them are aligned with the
item (Smith-Waterman over words), which scores edited copies too. Seeds travel to the documents in
slices of ``slice_seeds``; a larger benchmark takes more passes over the text, not more memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import drop_listed, id_text, materialize
from voxelmill.llm.wordhash import U, Words, byte_chunks, bytes_of

MATCH, MISMATCH, GAP = 2, -1, -1
HIT = "doc_id long, item_id long, score double, item_words int, first_byte long, last_byte long"


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of the runs of ``n`` words inside a text."""
    full = len(words.hash) - n + 1
    if full <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    places = np.flatnonzero(words.row[:full] == words.row[n - 1 :])
    total = words.hash[places] * U(n)
    for k in range(1, n):
        total = (total ^ (total >> U(29))) * U(0xBF58476D1CE4E5B9) + words.hash[places + k]
    return total ^ (total >> U(32)), places


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: (score, first, last word in ``text``)."""
    row, origin = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    best = (0, 0, 0)
    at = np.arange(1, len(text) + 1)
    for word in item:
        gain = np.where(text == word, MATCH, MISMATCH)
        diagonal, up = row[:-1] + gain, row[1:] + GAP
        score = np.maximum(np.maximum(diagonal, up), 0)
        start = np.where(score == 0, at, np.where(diagonal >= up, origin[:-1], origin[1:]))
        reach = score - GAP * at  # a gap in the item lowers a score by one for each word
        top = np.maximum.accumulate(reach)
        place = np.maximum.accumulate(np.where(reach == top, np.arange(len(at)), 0))
        score = np.maximum(top + GAP * at, 0)
        start = np.where(score == 0, at, start[place])
        row[1:], origin[1:] = score, start
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k)
    return best


def find_items(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    n: int = 3, least_score: float = 0.5, slice_seeds: int = 200_000,
) -> DataFrame:
    """(doc_id, item_id, score, item_words, first_byte, last_byte): the documents that hold an item.

    ``score`` is the best local alignment over the words (runs of letters, lower-cased) as a share of
    the whole item's own, at least ``least_score``; the bytes bound the copy in the lower-cased text.
    An item of fewer than ``n`` words is its own seed; one without words is found nowhere. Null and
    empty texts hold nothing. Rows that share an id give one row for each item, the best. Null ids
    are reported as null. Empty tables give no rows; other columns are ignored.
    """
    texts = id_text(docs, id_col, text_col).withColumn("text", F.lower("text"))
    tests = id_text(items, item_col, item_text).select(F.col("doc_id").alias("item_id"), F.lower("text").alias("text"))

    def item_seeds(batches):
        for part in byte_chunks(batches):
            words = Words(*bytes_of(part.column(1)), letters_only=True)
            counts = np.diff(words.first)
            for size in np.unique(np.minimum(counts, n)):
                if size == 0:
                    continue
                hashes, places = ngrams(words, int(size))
                row = words.row[places]
                use = np.minimum(counts, n)[row] == size
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row[use])), pa.array((places - words.first[row])[use]), pa.array(np.full(use.sum(), size, np.int32)), pa.array(hashes[use].view(np.int64))],
                    names=["item_id", "place", "size", "seed"])

    seeds = materialize(tests.mapInArrow(item_seeds, "item_id long, place long, size int, seed long"), "seeds")

    def sliced(seeds: DataFrame):
        """(slice, size -> sorted hashes) of the distinct seeds, each of bounded size."""
        distinct = seeds.select("size", "seed").distinct()
        slices = max(1, -(-distinct.count() // slice_seeds))
        for k in range(slices):
            rows = distinct.filter(F.pmod(F.xxhash64("seed"), F.lit(slices)) == k).collect()  # about slice_seeds rows
            yield k, slices, {s: np.sort(np.array([r.seed for r in rows if r.size == s], np.int64).view(U)) for s in sorted({r.size for r in rows})}

    def quick(tables):
        """Table of hash beginnings, to reject most n-grams before the search."""
        out = {}
        for size, table in tables.items():
            seen = np.zeros(1 << 22, bool)
            seen[(table >> U(42)).astype(np.int64)] = True
            out[size] = seen
        return out

    def hits(words, tables, seen):
        for size, table in tables.items():
            hashes, places = ngrams(words, size)
            may = seen[size][(hashes >> U(42)).astype(np.int64)]
            hashes, places = hashes[may], places[may]
            k = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            found = table[k] == hashes
            yield size, hashes[found], places[found]

    spark = docs.sparkSession
    found = None
    for k, slices, tables in sliced(seeds):
        part = seeds.filter(F.pmod(F.xxhash64("seed"), F.lit(slices)) == k).join(tests, "item_id").groupBy("item_id").agg(
            F.collect_set(F.struct("size", "seed", "place")).alias("seeds"), F.first("text").alias("text")).collect()  # items of one slice
        shared = spark.sparkContext.broadcast({"tables": tables, "items": [(r.item_id, r.text, [(s.size, s.seed, s.place) for s in r.seeds]) for r in part]})

        def search(batches, shared=shared):
            tables, items = shared.value["tables"], shared.value["items"]
            seen = quick(tables)
            item_words = Words(*bytes_of(pa.array([t for _, t, _ in items], pa.string())), letters_only=True) if items else None
            owners = {}
            for i, (_, _, own) in enumerate(items):
                for size, seed, place in own:
                    owners.setdefault((size, seed), []).append((i, place))
            for part in byte_chunks(batches):
                words = Words(*bytes_of(part.column(1)), letters_only=True)
                starts = {}
                for size, hashes, places in hits(words, tables, seen):
                    for seed, place in zip(hashes.view(np.int64).tolist(), places.tolist()):
                        for item, offset in owners.get((size, seed), ()):
                            starts.setdefault((int(words.row[place]), item), []).append(place - offset)
                out = []
                for (row, item), begins in starts.items():
                    sequence = item_words.hash[item_words.first[item] : item_words.first[item + 1]]
                    length, begins = len(sequence), sorted(begins)
                    best = (0, 0, 0)
                    at = 0
                    while at < len(begins):  # copies that lie apart are aligned apart
                        end = at
                        while end + 1 < len(begins) and begins[end + 1] - begins[end] <= length:
                            end += 1
                        low = max(int(words.first[row]), begins[at] - length // 2 - 4)
                        high = min(int(words.first[row + 1]), begins[end] + length + length // 2 + 4)
                        at = end + 1
                        if np.isin(sequence, words.hash[low:high]).sum() < least_score * length:
                            continue  # a score has at most MATCH for each word of the item that is there at all
                        score, first, last = align(sequence, words.hash[low:high])
                        if score > best[0]:
                            best = (score, low + first, low + last)
                    if best[0] >= least_score * MATCH * length:
                        base = int(offsets_start(part, row))
                        out.append((row, items[item][0], best[0] / (MATCH * length), length, int(words.start[best[1]]) - base, int(words.end[best[2]]) - base))
                if out:
                    rows, *rest = zip(*out)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(rest[0], pa.int64()), pa.array(rest[1]), pa.array(rest[2], pa.int32()), pa.array(rest[3], pa.int64()), pa.array(rest[4], pa.int64())],
                                                     names=["doc_id", "item_id", "score", "item_words", "first_byte", "last_byte"])

        part = texts.mapInArrow(search, HIT)
        found = part if found is None else found.union(part)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "item_words", "first_byte", "last_byte")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def offsets_start(part: pa.RecordBatch, row: int) -> int:
    return bytes_of(part.column(1))[1][row]


def without_items(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    return drop_listed(docs, found.select("doc_id"), id_col)
