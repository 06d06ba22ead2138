"""Seeded random numbers that belong to a row, not to a partition.

A draw is addressed by (seed, stream, keys...).  The same address gives the same number under any
partitioning, after a retry of a lost task, and in any engine that has md5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2**52)


def _as_column(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def uniform(seed: int, stream: str, *keys) -> Column:
    """Uniform number in [0, 1).  Keys must be integers or strings (text forms of doubles differ)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[_as_column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_SCALE)


def uniform_index(size, seed: int, stream: str, *keys) -> Column:
    """Uniform integer in [0, size)."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.floor(uniform(seed, stream, *keys) * size).cast("bigint")


def normal(seed: int, stream: str, *keys) -> Column:
    """Standard normal number from two uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, stream + ".r", *keys)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, stream + ".a", *keys))


def weighted_choice(u: Column, labels, weights) -> Column:
    """The label whose cumulative weight interval holds ``u``; the last label closes the range."""
    total = float(sum(weights))
    running, choice = 0.0, None
    for label, weight in list(zip(labels, weights))[:-1]:
        running += weight / total
        choice = F.when(u < running, F.lit(label)) if choice is None else choice.when(u < running, F.lit(label))
    return F.lit(labels[-1]) if choice is None else choice.otherwise(F.lit(labels[-1]))


def poisson(u: Column, rate: Column, largest: int) -> Column:
    """Poisson number by cumulative thresholds, closed at ``largest``."""
    term = F.exp(-rate)
    cumulative = term
    count = F.when(u < cumulative, F.lit(0))
    for k in range(1, largest):
        term = term * rate / F.lit(float(k))
        cumulative = cumulative + term
        count = count.when(u < cumulative, F.lit(k))
    return count.otherwise(F.lit(largest))
