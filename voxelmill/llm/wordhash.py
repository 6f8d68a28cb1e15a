"""Vectorised hashes of words and word sequences, inside tasks, on the bytes of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEED = 0x9E3779B97F4A7C15


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U) * U(SEED))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit integers over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """``base`` to the power 0 .. n-1, modulo 2**64."""
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_chunks(batches: Iterable[pa.RecordBatch], size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose second column holds about ``size`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(1))[1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    """Offsets of a text column without nulls, from 0."""
    if not len(column):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets - offsets[0]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without nulls, and the offsets of its rows."""
    offsets = offsets_of(column)
    if not offsets[-1]:
        return np.empty(0, np.uint8), offsets
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    first = int(np.frombuffer(column.buffers()[1], kind)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + int(offsets[-1])], offsets


class Words:
    """The words of many texts: runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.

    ``hash``: a 64-bit value for each word; ``row``: its text; ``start`` and ``end``: its bytes in
    the joined data; ``first``: for each text the place of its first word, and the end of the last;
    ``prefixes``: pairs of a length in bytes and the hashes of that much of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters_only: bool = False, prefixes: tuple[int, ...] = ()):
        table = byte_values()
        table[65:91] = table[97:123]
        keep = np.ones(256, bool)
        keep[[0x20, 9, 10, 11, 12, 13]] = False
        if letters_only:  # ASCII marks and digits end a word too
            keep[:128] = False
            keep[65:91] = keep[97:123] = True
        rows = len(offsets) - 1
        inside = keep[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        bounds = offsets[:-1][np.diff(offsets) > 0]
        begins[bounds] = inside[bounds]
        self.start = np.flatnonzero(begins)
        if len(self.start):
            at = np.flatnonzero(inside)
            word = np.cumsum(begins[at]) - 1
            place = at - self.start[word]
            terms = table[data[at]] * powers(int(place.max()) + 1)[place]
            first = np.searchsorted(at, self.start)
            self.hash = mix(np.add.reduceat(terms, first))
            self.prefixes = [(k, mix(np.add.reduceat(np.where(place < k, terms, U(0)), first) + U(k))) for k in prefixes]
            self.end = np.append(at[first[1:] - 1], at[-1]) + 1
        else:
            self.hash, self.end = np.empty(0, U), np.empty(0, np.int64)
            self.prefixes = [(k, self.hash) for k in prefixes]
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(rows + 1))

    def sequences(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every run of ``n`` words inside a text; the whole sequence of a text with
        fewer words. Runs of different lengths have different hashes."""
        if not len(self.hash):
            return np.empty(0, U), np.empty(0, np.int64)
        counts = np.diff(self.first)
        full = len(self.hash) - n + 1
        if full > 0:
            total = self.hash[:full] * U(3)
            for k in range(1, n):
                total = mix(total + self.hash[k : full + k] * U(2 * k + 3))
            whole = self.row[:full] == self.row[n - 1 :]
            hashes, rows = total[whole], self.row[:full][whole]
        else:
            hashes, rows = np.empty(0, U), np.empty(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < n))
        extra = np.empty(len(short), U)
        for i, row in enumerate(short):
            value = U(SEED - 1) ^ U(counts[row])
            for h in self.hash[self.first[row] : self.first[row + 1]]:
                value = mix(np.array([value], U) + h)[0]
            extra[i] = value
        if len(short):
            hashes, rows = np.concatenate([hashes, extra]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            hashes, rows = hashes[order], rows[order]
        return hashes, rows


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted in the row, and the offsets of the rows."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.searchsorted(rows[new], np.arange(n_rows + 1))
