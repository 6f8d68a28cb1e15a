"""SQL text of the draws in ``voxelmill.functions.random``."""

from __future__ import annotations

from voxelmill.functions.random import _PRIMES, MOD


def draw(seed: int, *keys: str) -> str:
    total = " + ".join([f"{seed * 32452843 + 12345}::BIGINT"] + [f"CAST({k} AS BIGINT) * {p}" for k, p in zip(keys, _PRIMES)])
    a = f"((({total}) % {MOD} + {MOD}) % {MOD} * 48271 % {MOD})"
    return f"((({a} % 46337) * ({a} % 46337) + {a}) % {MOD} * 16807 % {MOD})"


def uniform(seed: int, *keys: str) -> str:
    return f"(CAST({draw(seed, *keys)} AS DOUBLE) / {MOD}.0::DOUBLE)"


def normal(seed: int, *keys: str) -> str:
    u = f"((CAST({draw(2 * seed + 1000003, *keys)} AS DOUBLE) + 1.0) / {MOD}.0::DOUBLE)"
    return f"(sqrt(ln({u}) * -2.0) * cos({uniform(2 * seed + 1000004, *keys)} * (2 * pi())))"
