"""Content-chosen positions of byte strings, inside tasks."""

from __future__ import annotations

import numpy as np

from voxelmill.llm.wordhash import U, byte_values, mix, powers

BASE = 0xD6E8FEB86659FD93
PLACE_BITS = 22
INVERSE = pow(BASE, -1, 1 << 64)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each position that has as many."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, U)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum(byte_values()[data] * powers(len(data), BASE), out=total[1:])
    return mix((total[width:] - total[:n]) * powers(n, INVERSE))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    out, step = values, 1
    while step * 2 <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def window_groups(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Strings of ``length`` bytes inside one text, in runs that share their least gram.

    Returns for each run the start of its first string, the number of strings, and the hash of the
    gram that is the least (then leftmost) of every string of the run. Equal strings have equal
    grams, wherever they stand.
    """
    starts, counts, hashes = [], [], []
    step = (1 << PLACE_BITS) - length
    for a, b in zip(offsets[:-1], offsets[1:]) if np.diff(offsets).max(initial=0) > step else [(0, int(offsets[-1]))]:
        for at in range(int(a), int(b), step):
            stop = min(int(b), at + step + length - 1)
            bounds = np.clip(offsets, at, stop) - at
            part = data[at:stop]
            if len(part) < length:
                continue
            grams = gram_hashes(part, gram)
            places = np.arange(len(grams), dtype=U)
            least = sliding((grams >> U(PLACE_BITS)) << U(PLACE_BITS) | places, length - gram + 1, np.minimum)
            valid = np.flatnonzero(inside(bounds, length))
            if not len(valid):
                continue
            place = (least[valid] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
            new = np.ones(len(valid), bool)
            new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)
            first = np.flatnonzero(new)
            starts.append(valid[first] + at)
            counts.append(np.diff(np.append(first, len(valid))))
            hashes.append(grams[place[first]])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(hashes)


def inside(offsets: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes in the joined data, whether one text holds it."""
    n = int(offsets[-1]) - length + 1
    out = np.zeros(max(n, 0), bool)
    for a, b in zip(offsets[:-1], offsets[1:]):
        out[a : max(a, b - length + 1)] = True
    return out
