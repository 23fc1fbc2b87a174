"""Row-local column helpers that carry the missing-value contract.

Missing is NULL everywhere; NaN and infinities are turned into NULL once, at
ingest or at the end of a projection, and never carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

PROBABILITY_FLOOR = 1e-7


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Quotient, missing where the divisor is 0 or the result overflows."""
    return finite_or_null(F.try_divide(col(a).cast("double"), col(b).cast("double")))


def indicator(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it fails or cannot be assessed."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def absent(c: Column | str) -> Column:
    return F.isnull(col(c)).cast("double")


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def right_closed_bin(c: Column | str, edges: Sequence[float], labels: Sequence) -> Column:
    """Label of the right-closed interval ``(edge[i-1], edge[i]]`` holding the value.

    ``edges`` are the interior ones, so there is one more label than edges.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need exactly one more label than interior edges")
    c = col(c)
    chain = F.when(c.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        chain = chain.when(c <= F.lit(edge), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def clipped(c: Column | str, low: float, high: float) -> Column:
    """Clamp to [low, high]; missing stays missing."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def probability(c: Column | str) -> Column:
    return clipped(c, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)


def logit(c: Column | str) -> Column:
    p = probability(c)
    return F.ln(p / (F.lit(1.0) - p))


def latest(value: Column, at: Column) -> Column:
    """Aggregate: the non-missing value at the largest ``at`` (a fixed-size buffer, hashed)."""
    return F.max_by(value, F.when(value.isNotNull(), at))


def earliest(value: Column, at: Column) -> Column:
    """Aggregate: the non-missing value at the smallest ``at``."""
    return F.min_by(value, F.when(value.isNotNull(), at))


def bin_of(value: Column, interior_edges: Column) -> Column:
    """Number of interior edges at or below the value (left-closed bins).

    ``interior_edges`` is a short sorted array column.
    """
    return F.size(F.filter(interior_edges, lambda e: e <= value))
