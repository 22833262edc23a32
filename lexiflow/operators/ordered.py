"""Running values along a total order of any size.

Rows are dealt to ranges of the order and sorted in each range; a running value
is taken within a range by a window and completed by what earlier ranges hand
over, which is one row per range. So no task holds more than a range, however
many rows share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.session import stage

PART, AT = "_order_part", "_order_at"


def in_order(df: DataFrame, keys: list, name: str = "ordered") -> DataFrame:
    """``df`` staged in ranges of ``keys`` (nulls first; ties in the order read), with each row's range and place."""
    x = df.withColumn(AT, F.monotonically_increasing_id())
    x = x.repartitionByRange(*keys, AT).sortWithinPartitions(*keys, AT).withColumn(AT, F.monotonically_increasing_id())
    return stage(x.withColumn(PART, F.shiftright(AT, 33)), name)


def running_sum(ordered: DataFrame, value: Column, out: str) -> DataFrame:
    """``ordered`` plus the sum of ``value`` up to and including each row."""
    total = ordered.groupBy(PART).agg(F.sum(value).alias("_s"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)       # one row per range
    handed = total.select(PART, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_handed"))
    here = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumn(out, F.coalesce(F.sum(value).over(here), F.lit(0)))
    return local.join(handed, PART).withColumn(out, F.col(out) + F.col("_handed")).drop("_handed")


def running_last(ordered: DataFrame, value: Column, out: str, forward: bool = True) -> DataFrame:
    """``ordered`` plus the last non-null ``value`` up to and including each row; with ``forward`` False the next one."""
    sign = F.col(AT) if forward else -F.col(AT)
    order = F.col(PART) if forward else -F.col(PART)
    mine = F.max_by(value, F.when(value.isNotNull(), sign))
    tail = ordered.groupBy(PART).agg(mine.alias("_v"))
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)      # one row per range
    handed = tail.select(PART, F.last("_v", ignorenulls=True).over(before).alias("_handed"))
    here = Window.partitionBy(PART).orderBy(sign).rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumn(out, F.last(value, ignorenulls=True).over(here))
    return local.join(handed, PART).withColumn(out, F.coalesce(out, "_handed")).drop("_handed")
