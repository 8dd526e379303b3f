"""Column functions that operators share: guarded division, tests of proportions, buckets, seeded numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return F.when(F.abs(b) > eps, a / b)


def gate(value: Column, support: Column, least: int) -> Column:
    return F.when(support >= least, value)


def over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def bucket(x: Column, edges_: tuple) -> Column:
    out = F.lit(edges_[-1][1])
    for top, name in reversed(edges_[:-1]):
        out = F.when(x <= top, name).otherwise(out)
    return out


def uniform(seed: int, *ids: str) -> Column:
    """A number from 0 up to 1 from a seed and ids."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 52)) / F.lit(float(1 << 52))


#: A published expansion of the complementary error function, of a relative error under 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided(z: Column) -> Column:
    """Two-sided p of a normal deviate."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def two_proportion_z(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Normal deviate of a of n against b of m, with a pooled deviation; 0 where that is 0."""
    p = (a + b) / F.nullif(n + m, F.lit(0))
    se = F.sqrt(p * (1 - p) * (1 / F.nullif(n, F.lit(0)) + 1 / F.nullif(m, F.lit(0))))
    return F.coalesce((a / F.nullif(n, F.lit(0)) - b / F.nullif(m, F.lit(0))) / F.nullif(se, F.lit(0.0)), F.lit(0.0))


def cliffs_delta(auc: Column) -> Column:
    return 2 * auc - 1


def effect(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").otherwise("large")
