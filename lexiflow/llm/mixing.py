"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every source gets a target number of words. Its documents stand in one fixed
order; the expected copies of each are prefix-summed, one random offset is
added, and a document is emitted once per integer boundary its interval
crosses. The order goes by size class, so that neighbours weigh alike and the
words taken come near the target even when a few documents are very long.

Prefix sums have three levels (size class in the source, salt in the class, row
in the salt), so no source is ordered in one task.

Defined results: null text counts no words; the null source is a source of its
own, last in order; a source without words has target 0; repeated rows are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2
SALTS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes per doubling of the size, by integer arithmetic."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.call_function("shiftright", size * 8, bits - 1).cast("int")


def _hex(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT) -> DataFrame:
    """(src, source_size, target) from (src, size): weights repeat along the
    sources in order; targets stop at ``max_repeat`` times the source's size and
    the excess goes to the others by weight. One row per source is ordered."""
    every = Window.orderBy("src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    s = (sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
         .withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
         .withColumn("ratio", F.col("cap") / F.col("w")))
    fill = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    s = (s.withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
         .withColumn("w_all", F.sum("w").over(all_rows))
         .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(fill), F.lit(0)))
                     / (F.col("w_all") - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))))
    level = F.max("level").over(all_rows)
    return s.select("src", "source_size",
                    F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"))


def systematic_copies(df: DataFrame, text_col="text", source_col="source", id_col="doc_id",
                      weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT, seed="mix") -> DataFrame:
    """(row STRUCT of df's columns, size, source_size, target, copies)."""
    src = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    size = word_count(F.col(text_col))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), src.alias("src"), size.alias("size"),
                     size_class(size).alias("cls"), (_hex(ident, 4) % SALTS).alias("salt"))
    slim = df.select(src.alias("src"), size.alias("size"), size_class(size).alias("cls"),
                     (_hex(ident, 4) % SALTS).alias("salt"))
    cells = slim.groupBy("src", "cls", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    before = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    classes = cells.groupBy("src", "cls").agg(F.sum("n").alias("n_cls"))
    classes = classes.select("src", "cls", F.coalesce(F.sum("n_cls").over(
        Window.partitionBy("src").orderBy("cls").rowsBetween(*before)), zero).alias("cls_start"))
    in_class = Window.partitionBy("src", "cls").orderBy("salt").rowsBetween(*before)
    starts = (cells.withColumn("salt_start", F.coalesce(F.sum("n").over(in_class), zero))
              .join(classes, ["src", "cls"])
              .join(source_targets(cells, weights, share, max_repeat), "src")
              .select("src", "cls", "salt", (F.col("cls_start") + F.col("salt_start")).alias("start"),
                      "source_size", "target"))
    order = Window.partitionBy("src", "cls", "salt").orderBy("size", F.col(f"row.{id_col}"))
    ranked = rows.withColumn("pos", F.row_number().over(order))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hex(F.concat(F.lit(f"{seed}:"), F.col("src")), 3) / F.lit(4096.0)
    end = F.col("start") + F.col("pos")
    copies = F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset)
    return (ranked.join(starts, ["src", "cls", "salt"])
            .select("row", "size", "source_size", "target",
                    F.greatest(zero, F.least(copies, F.lit(max_repeat).cast("long"))).alias("copies")))


def mix(df: DataFrame, **kw) -> DataFrame:
    """The mixed rows of ``df`` themselves, repeated or left out as sampled."""
    return (systematic_copies(df, **kw)
            .select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .select("row.*"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s0 AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(src)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
         ELSE 1.0::DOUBLE END AS w FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
         - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, encode(src)
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY 2 * source_size / w, encode(src)
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level FROM s1),
s AS (SELECT src, source_size, least((2 * source_size)::DOUBLE, (max(level) OVER ()) * w) AS target,
        ('0x' || substr(md5('mix:' || src), 1, 3))::INT / 4096.0::DOUBLE AS u FROM s2),
r AS (SELECT doc_id, src, size, row_number() OVER (PARTITION BY src ORDER BY
         length(bin(size)) * 16 + ((size * 8) >> (length(bin(size)) - 1)::BIGINT),
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INT % 256, size, doc_id) AS pos FROM d),
j AS (SELECT doc_id, size, source_size, target, u, pos,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM r JOIN s USING (src))
SELECT doc_id, size, source_size, target,
       (greatest(0, least(2, floor(pos * rate + u) - floor((pos - 1) * rate + u))) * size)::BIGINT AS taken
FROM j
"""
