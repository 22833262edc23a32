"""Row filters, time parsing, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.hashing import hash32
from lexiflow.session import cut_lineage


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` plus ``name``, a costly ``value`` that is computed once per row: the filters and expressions above read a
    generated column, while the optimizer copies the expression of a plain one into each of them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def filter_min_length(df: DataFrame, text_col: str, n: int) -> DataFrame:
    """Keep rows whose text has at least ``n`` characters (code points)."""
    return df.filter(F.length(F.col(text_col)) >= n)


def drop_empty(df: DataFrame, text_col: str, time_col: str) -> DataFrame:
    """Drop rows with null time or null/empty text."""
    return df.filter(F.col(time_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != ""))


def parse_time_coerce(x: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Invalid timestamps become null."""
    return F.try_to_timestamp(x, F.lit(fmt))


def parse_time_strict(x: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """P10: invalid timestamps raise (ANSI mode)."""
    return F.to_timestamp(x, fmt)


def tag_source(df: DataFrame, name: str, col: str = "platform") -> DataFrame:
    """Literal source column, applied before a union."""
    return df.withColumn(col, F.lit(name))


def calendar_parts(df: DataFrame, ts_col: str) -> DataFrame:
    """Year, month and 'yyyy-MM' label."""
    ts = F.col(ts_col)
    return (df.withColumn("year", F.year(ts).cast("bigint"))
              .withColumn("month", F.month(ts).cast("bigint"))
              .withColumn("year_month", F.date_format(ts, "yyyy-MM")))


def sample_exact_n(df: DataFrame, n: int, id_col: str, seed: int = 42,
                   time_col: str | None = None) -> DataFrame:
    """Exactly min(n, rows) rows chosen by a seeded hash of the id.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n, so at most n rows per task ever reach the final merge.
    """
    key = hash32(F.col(id_col).cast("string"), seed)
    out = df.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")
    return out.orderBy(time_col, id_col) if time_col else out


def stratified_split(df: DataFrame, strata_col: str, id_col: str, test_frac: float = 0.1,
                     seed: int = 42, buckets: int = 4096) -> DataFrame:
    """Exact per-stratum split; ``round(test_frac * n_stratum)`` rows go to ``test``.

    Rows are ranked inside a stratum by a seeded hash. A stratum may be huge,
    so the rank is never taken over the whole stratum in one task: hashes are
    cut into ``buckets`` ranges, counted per (stratum, range) with partial
    aggregation, and only the one range holding the cut-off is ranked row by
    row. Its size is about n_stratum / buckets. Rows without a stratum form a
    stratum of their own; rows without an id are hashed as the empty id.
    """
    h = hash32(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed)
    x = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") * buckets / F.lit(2 ** 32)).cast("int"))
    cnt = x.groupBy(strata_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(strata_col).orderBy("_b")
    cnt = (cnt.withColumn("_cum", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_tot", F.sum("_n").over(Window.partitionBy(strata_col)))
              .withColumn("_k", F.round(F.col("_tot") * F.lit(test_frac)).cast("bigint"))
              .withColumn("_before", F.col("_cum") - F.col("_n"))
              .select(strata_col, "_b", "_k", "_before", "_cum"))
    cnt = cnt.select(F.col(strata_col).alias("_stratum"), F.col("_b").alias("_range"), "_k", "_before", "_cum")
    x = x.join(cnt, x[strata_col].eqNullSafe(cnt["_stratum"]) & x["_b"].eqNullSafe(cnt["_range"]))
    edge = (F.col("_before") < F.col("_k")) & (F.col("_k") < F.col("_cum"))
    # Rank only rows of the boundary range.
    rk = F.row_number().over(Window.partitionBy(strata_col, "_b").orderBy("_h", id_col))
    edge_rows = x.filter(edge).withColumn(
        "split", F.when(rk + F.col("_before") <= F.col("_k"), "test").otherwise("train"))
    rest = x.filter(~edge).withColumn(
        "split", F.when(F.col("_cum") <= F.col("_k"), "test").otherwise("train"))
    cols = df.columns + ["split"]
    return edge_rows.select(*cols).unionByName(rest.select(*cols))


def rank_rows(df: DataFrame, order: list, group: list | None = None, name: str = "_n") -> DataFrame:
    """``df`` plus ``name``: each row's place from 0 in the order of the columns
    ``order``, within its ``group`` if given (nulls first, null groups kept).

    Rows are dealt to ranges of (group, order), so neither a large group nor a
    dense run of ids is sorted in one task; rows that agree in all keys are
    dealt by where they were read. Only one row per group and range is
    prefix-summed.
    """
    group = group or []
    at, part, first, size, before = ("_rank_" + c for c in ("at", "part", "first", "size", "before"))
    keys = [*group, *order, at]
    x = (df.withColumn(at, F.monotonically_increasing_id())
           .repartitionByRange(*keys).sortWithinPartitions(*keys)
           .withColumn(at, F.monotonically_increasing_id()))     # partition << 33 | place in it
    x = cut_lineage(x.withColumn(part, F.shiftright(at, 33)))
    runs = x.groupBy(*group, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(size))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(before, F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    theirs = ["_rank_key" + str(i) for i in range(len(group))]
    runs = runs.select(*[F.col(g).alias(t) for g, t in zip(group, theirs)], F.col(part).alias("_rank_range"), first, before)
    same = F.col(part) == F.col("_rank_range")
    for g, t in zip(group, theirs):
        same = same & F.col(g).eqNullSafe(F.col(t))
    return x.join(runs, same).select(*df.columns, (F.col(at) - F.col(first) + F.col(before)).alias(name))


def number_rows(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` plus ``_n``: its place from 0 in the order of ``id_col`` (nulls first)."""
    return rank_rows(df, [id_col])
