"""Reproducible draws from integer arithmetic on row keys.

The same keys and seed give the same draw whatever the partitioning, so a lost and
recomputed task returns the same rows. All steps stay below 2**63.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MOD = 2147483647
_PRIMES = (7919, 104729, 1299709, 15485863)


def draw(seed: int, *keys: str | Column) -> Column:
    """Integer in ``[0, 2**31 - 1)``."""
    total = F.lit(seed * 32452843 + 12345).cast("bigint")
    for key, prime in zip(keys, _PRIMES):
        col = F.col(key) if isinstance(key, str) else key
        total = total + col.cast("bigint") * prime
    a = F.pmod(total, F.lit(MOD)) * 48271 % MOD
    low = a % 46337
    return (low * low + a) % MOD * 16807 % MOD


def uniform(seed: int, *keys: str | Column) -> Column:
    """Double in ``[0, 1)``."""
    return draw(seed, *keys).cast("double") / float(MOD)


def normal(seed: int, *keys: str | Column) -> Column:
    """Standard normal value from two uniform draws."""
    u = (draw(2 * seed + 1000003, *keys).cast("double") + 1.0) / float(MOD)
    return F.sqrt(F.log(u) * -2.0) * F.cos(uniform(2 * seed + 1000004, *keys) * (2 * math.pi))


def slice_of(draw_col: Column, slices: int = 4096) -> Column:
    """Order-preserving slice of a draw, for ranking by hash in many tasks."""
    return F.floor(draw_col / (MOD // slices + 1))


def hash_uniform(seed: int, *keys: str | Column) -> Column:
    """As ``uniform`` with the built-in 64-bit hash: one node, for expressions that draw often."""
    word = F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.shiftrightunsigned(word, 11).cast("double") * (1.0 / 9007199254740992.0)


def hash_normal(seed: int, *keys: str | Column) -> Column:
    u = 1.0 - hash_uniform(2 * seed, *keys)
    return F.sqrt(F.log(u) * -2.0) * F.cos(hash_uniform(2 * seed + 1, *keys) * (2 * math.pi))


def _mixed(word: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    word = (word ^ (word >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    word = (word ^ (word >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return word ^ (word >> np.uint64(31))


def key_words(seed: int, *keys: np.ndarray) -> np.ndarray:
    """One 64-bit word for each row of integer keys, for ``array_uniform``."""
    word = np.full(len(keys[0]), seed % (1 << 64), np.uint64)
    for key in keys:
        word = _mixed(word + np.uint64(0x9E3779B97F4A7C15)) ^ key.astype(np.int64).view(np.uint64)
    return _mixed(word + np.uint64(0x9E3779B97F4A7C15))


def array_uniform(words: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Double in ``[0, 1)`` for each word (rows) and number of the draw (columns): draws inside tasks, as many as are needed."""
    steps = (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (_mixed(words[:, None] + steps) >> np.uint64(11)).astype(float) * (1.0 / 9007199254740992.0)


def array_normal(words: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Standard normal value from the uniform draws ``number`` and ``number + 1``."""
    u = 1.0 - array_uniform(words, number)
    return np.sqrt(np.log(u) * -2.0) * np.cos(array_uniform(words, number + 1) * (2 * math.pi))
