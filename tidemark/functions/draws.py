"""Reproducible draws from whole numbers by modular arithmetic, the same on any engine and on every retry.

No random state: a task that is run again after a lost executor draws the same values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647
#: Up to so many places one draw of ``PRIME`` values is even to a part in 2,000.
FEW = 1 << 20


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) for the seed and the whole numbers given.

    The rounds are a fold over an array: nested in one plain expression, each round would triple its input,
    and filters that the optimizer infers on the result would copy all of it. Numbers of ``PRIME`` and more are told
    apart by further rounds with their quotients. There are ``PRIME`` different draws; ``pick`` has enough for any count.
    """
    whole = [p.cast("long") for p in parts]
    steps = F.array(*whole, F.lit(0).cast("long"), F.lit(0).cast("long"))
    if parts:
        high = F.array(*[F.round((p - p % PRIME) / PRIME).cast("long") for p in whole])
        steps = F.when(F.greatest(*[F.abs(p) for p in whole], F.lit(0).cast("long")) < PRIME, steps).otherwise(F.concat(steps, high))

    def mix(h: Column, p: Column) -> Column:
        x = (h * 48271 + p % PRIME + 1) % PRIME
        return (x * x % PRIME + x * 40692 + 12345) % PRIME

    return F.aggregate(steps, F.lit(seed % PRIME).cast("long"), mix) / F.lit(float(PRIME))


def with_uniform(df: DataFrame, out: str, seed: int, *parts: Column) -> DataFrame:
    return df.withColumn(out, uniform(seed, *parts))


def pick(n: Column, seed: int, *parts: Column) -> Column:
    """A whole number in [0, n): ``floor(u * n)``, from a draw of twice the rounds where ``n`` is over ``FEW``."""
    u = uniform(seed, *parts)
    fine = u + uniform(seed + 1_000_003, *parts) / F.lit(float(PRIME))
    return F.when(n <= FEW, F.floor(u * n)).otherwise(F.least(F.floor(fine * n), n - 1)).cast("long")


def uniform_array(seed: int, *parts: np.ndarray) -> np.ndarray:
    """The same for arrays of whole numbers, which are broadcast against one another."""
    whole = [np.asarray(p, "i8") for p in parts]
    h = np.full(np.broadcast_shapes(*[p.shape for p in whole]), seed % PRIME, "i8")

    def mix(h: np.ndarray, p) -> np.ndarray:
        x = (h * 48271 + np.fmod(p, PRIME) + 1) % PRIME
        return (x * x % PRIME + x * 40692 + 12345) % PRIME

    for p in (*whole, np.int64(0), np.int64(0)):
        h = mix(h, p)
    large = np.zeros(h.shape, bool)
    for p in whole:
        large |= np.abs(p) >= PRIME
    if large.any():
        g = h
        for p in whole:
            g = mix(g, (p - np.fmod(p, PRIME)) // PRIME)
        h = np.where(large, g, h)
    return h / float(PRIME)


def poisson1_array(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts at the given quantiles, for arrays."""
    edges, total = [], 0.0
    for k in range(18):
        total += math.exp(-1) / math.factorial(k)
        edges.append(total)
    return np.searchsorted(edges, u, "right")


def uniform_sql(seed: int, *parts: str) -> str:
    """The same in SQL, for whole numbers below ``PRIME``."""
    steps = ", ".join(f"CAST({p} AS BIGINT)" for p in (seed % PRIME, *parts, 0, 0))
    x = f"((h * 48271 + p % {PRIME} + 1) % {PRIME})"
    return f"(list_reduce([{steps}], lambda h, p: ({x} * {x} % {PRIME} + {x} * 40692 + 12345) % {PRIME}) / CAST({PRIME} AS DOUBLE))"


def poisson1(u: Column) -> Column:
    """Poisson(1) count at the given quantile, by its distribution function."""
    total, out = 0.0, None
    for k in range(18):
        total += math.exp(-1) / math.factorial(k)
        out = (F if out is None else out).when(u < total, k)
    return out.otherwise(18)


def poisson1_sql(u: str) -> str:
    total, parts = 0.0, []
    for k in range(18):
        total += math.exp(-1) / math.factorial(k)
        parts.append(f"WHEN {u} < CAST({total!r} AS DOUBLE) THEN {k}")
    return "CASE " + " ".join(parts) + " ELSE 18 END"
