"""Time slicing.

The set of slices is small (one row per period), so per-slice lookups use a
scalar subquery holding the sorted slice array: it is computed once, bounded
by the number of periods, and evaluated in the row without any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.cleaning import rank_rows
from lexiflow.operators.ordered import in_order, running_last


def _micros(c: str) -> Column:
    """Microseconds since epoch of a TIMESTAMP or TIMESTAMP_NTZ column (session zone UTC)."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def slice_label(ts: Column, period: str = "month") -> Column:
    """Z01: 'yyyy-MM' for months, 'yyyyQn' for quarters."""
    if period == "month":
        return F.date_format(ts, "yyyy-MM")
    if period == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
    raise ValueError(period)


def slice_start(ts: Column, period: str = "month") -> Column:
    """First instant of the period (a TIMESTAMP)."""
    return F.date_trunc(period, ts)


def valid_slices(df: DataFrame, slice_col: str, min_docs: int = 10) -> DataFrame:
    """(slice, n_docs) for slices with at least ``min_docs`` rows."""
    return (df.groupBy(slice_col).agg(F.count(F.lit(1)).alias("n_docs"))
              .filter(F.col("n_docs") >= min_docs))


def keep_valid_slices(df: DataFrame, slice_col: str, min_docs: int = 10) -> DataFrame:
    """Rows of slices that have at least ``min_docs`` rows (semi join)."""
    return df.join(valid_slices(df, slice_col, min_docs).select(slice_col), slice_col, "left_semi")


def slice_index(slices: DataFrame, slice_col: str, out_col: str = "t") -> DataFrame:
    """Dense 0-based index of the sorted distinct slices.

    The ranking window runs over distinct slice labels only.
    """
    d = slices.select(slice_col).distinct()
    return d.select(slice_col, (F.dense_rank().over(Window.orderBy(slice_col)) - 1).cast("bigint").alias(out_col))


def nearest_slice(df: DataFrame, ts_col: str, slices: DataFrame, slice_ts_col: str,
                  out_col: str = "t") -> DataFrame:
    """Index of the slice timestamp closest to each row; earliest wins ties.

    The sorted slice timestamps form one scalar array; each row finds its
    nearest entry with array functions (first minimum = earliest).
    """
    arr = slices.select(F.sort_array(F.collect_set(_micros(slice_ts_col)))).scalar()
    x = df.withColumn("_slices", arr).withColumn("_x", _micros(ts_col))
    diffs = F.transform("_slices", lambda a: F.abs(a - F.col("_x")))
    return (x.withColumn(out_col, (F.array_position(diffs, F.array_min(diffs)) - 1).cast("bigint"))
             .drop("_slices", "_x"))


def nearest_slice_asof(df: DataFrame, ts_col: str, slices: DataFrame, slice_ts_col: str,
                       out_col: str = "t") -> DataFrame:
    """Z04 for slice tables of any size: the result of ``nearest_slice`` by an as-of merge.

    Rows and numbered slice timestamps are merged in ranges of time; the last
    slice at or before a row and the next one after it are carried along the
    order, over range borders too, and the nearer one is taken (the earlier on a
    tie). Rows without a time get none; no slice table is held in a row or task.
    """
    kept = df.columns
    marks = slices.select(_micros(slice_ts_col).alias("_x")).where(F.col("_x").isNotNull()).distinct()
    marks = rank_rows(marks, ["_x"], name="_t")
    mark = F.struct(F.col("_x").alias("x"), F.col("_t").alias("t"))
    rows = df.select(F.struct(*kept).alias("_row"), _micros(ts_col).alias("_x"), F.lit(None).cast("struct<x:bigint,t:bigint>").alias("_mark"))
    merged = rows.unionByName(marks.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_x", mark.alias("_mark")))
    o = in_order(merged, ["_x", F.col("_row").isNotNull()], "asof")      # a slice comes before the rows of its own time
    o = running_last(o, F.col("_mark"), "_before")
    o = running_last(o, F.col("_mark"), "_after", forward=False).where(F.col("_row").isNotNull())
    later = F.col("_before").isNull() | (F.col("_after.x") - F.col("_x") < F.col("_x") - F.col("_before.x"))
    t = F.when(F.col("_x").isNull(), None).when(F.col("_after").isNotNull() & later, F.col("_after.t")).otherwise(F.col("_before.t"))
    return o.select("_row.*", t.cast("bigint").alias(out_col))


def equal_width_bins(df: DataFrame, ts_col: str, nr_bins: int, out_col: str = "bin") -> DataFrame:
    """``nr_bins`` equal-width bins over the time span, last edge inclusive."""
    lo = df.select(F.min(_micros(ts_col))).scalar()
    hi = df.select(F.max(_micros(ts_col))).scalar()
    x = _micros(ts_col)
    width = (hi - lo) / F.lit(float(nr_bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(F.floor((x - lo) / width))
    return df.withColumn(out_col, F.least(b, F.lit(nr_bins - 1)).cast("bigint"))
