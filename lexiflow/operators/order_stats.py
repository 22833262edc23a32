"""Exact order statistics by counted ranges.

A value of given rank is found without sorting and without a state that grows
with the values: the span of the values is cut into ``BINS`` ranges, which are
counted with partial aggregation (at most ``BINS`` counts per task), and only
the range that holds the rank goes on, now between its own smallest and largest
value. It ends when one value is left or the range holds at most ``SMALL`` rows,
which are then read in order. Every round is one scan of one column.

Nulls do not count. Infinite values and NaN are counted apart (NaN last).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
SMALL = 4096


def values_at(df: DataFrame, col: str, ranks: list[int]) -> list[float | None]:
    """The values at the given ranks (from 0) of the ascending order; null beyond the last."""
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    ends = x.groupBy(F.when(F.isnan("x"), "nan").when(F.col("x") == math.inf, "+").when(F.col("x") == -math.inf, "-").otherwise("x").alias("kind")
                     ).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = {r.kind: r for r in ends.collect()}          # at most four rows

    def size(kind):
        return ends[kind].n if kind in ends else 0

    out = []
    for rank in ranks:
        if rank < 0 or rank >= sum(r.n for r in ends.values()):
            out.append(None)
        elif rank < size("-"):
            out.append(-math.inf)
        elif rank < size("-") + size("x"):
            out.append(_narrow(x, ends["x"].lo, ends["x"].hi, size("x"), rank - size("-")))
        else:
            out.append(math.inf if rank < size("-") + size("x") + size("+") else math.nan)
    return out


def _narrow(x: DataFrame, lo: float, hi: float, n: int, rank: int) -> float:
    v = F.col("x")
    while lo < hi:
        here = x.where(v.between(lo, hi))
        if n <= SMALL:
            return here.orderBy("x").limit(rank + 1).agg(F.max("x")).first()[0]
        half = hi / 2 - lo / 2                          # half, so that the span cannot overflow
        at = F.least(F.lit(BINS - 1), F.floor((v / 2 - lo / 2) / half * BINS)) if half > 0 else F.when(v == lo, 0).otherwise(1)
        cells = here.groupBy(at.cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for cell in sorted(cells.collect()):            # at most BINS rows
            if rank < cell.n:
                lo, hi, n = cell.lo, cell.hi, cell.n
                break
            rank -= cell.n
    return lo


def median(df: DataFrame, col: str) -> float | None:
    """The middle value, or the mean of the two middle ones; null for no values."""
    n = df.select(F.count(col)).first()[0]
    if not n:
        return None
    ranks = sorted({(n - 1) // 2, n // 2})
    found = values_at(df, col, ranks)
    return sum(v / len(found) for v in found)
