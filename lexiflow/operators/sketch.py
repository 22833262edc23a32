"""Count-Min and Count Sketch document frequencies as Spark tables.

A sketch is a long table ``(row, bucket, cnt)`` with zero cells absent. It
is built from per-term document frequencies, so the depth-fold explode runs
over the vocabulary, not over tokens; cells are then summed with a partial
aggregate. Merging sketches is a union + sum (two-phase by construction).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.hashing import hash32


@dataclass(frozen=True)
class SketchSpec:
    kind: str            # "cms" or "cs"
    width: int
    depth: int
    seeds: tuple         # index seeds, one per row
    sign_seeds: tuple = ()  # Count Sketch only

    def check_mergeable(self, other: "SketchSpec") -> None:
        """Refuse to merge sketches of different kind, shape or seeds."""
        if self != other:
            raise ValueError(f"sketches differ: {self} vs {other}")


def cms_spec(epsilon: float = 0.01, delta: float = 0.01, seeds=None) -> SketchSpec:
    """Count-Min sizing: width ceil(e / eps^2), depth ceil(ln(1/delta)); seeds 1..depth."""
    width = math.ceil(math.e / epsilon ** 2)
    depth = math.ceil(math.log(1.0 / delta))
    seeds = tuple(seeds) if seeds else tuple(range(1, depth + 1))
    _check_seeds(seeds, depth)
    return SketchSpec("cms", width, depth, seeds)


def cs_spec(epsilon: float = 0.01, delta: float = 0.01, seeds=None, sign_seeds=None) -> SketchSpec:
    """Count Sketch sizing: width ceil(1 / eps^2), depth ceil(ln(1/delta));
    index seeds 1..depth, sign seeds depth+1..2*depth."""
    width = math.ceil(1.0 / epsilon ** 2)
    depth = math.ceil(math.log(1.0 / delta))
    seeds = tuple(seeds) if seeds else tuple(range(1, depth + 1))
    sign_seeds = tuple(sign_seeds) if sign_seeds else tuple(range(depth + 1, 2 * depth + 1))
    _check_seeds(seeds, depth)
    _check_seeds(sign_seeds, depth)
    return SketchSpec("cs", width, depth, seeds, sign_seeds)


def _check_seeds(seeds, depth):
    if len(seeds) < depth:
        raise ValueError("not enough seeds for the sketch depth")
    if len(set(seeds)) != len(seeds):
        raise ValueError("seeds must be distinct")


def _rows(spec: SketchSpec) -> Column:
    """Array of (row, seed, sign_seed) structs, one per sketch row."""
    sign = spec.sign_seeds or spec.seeds
    return F.array(*[F.struct(F.lit(r).alias("row"), F.lit(spec.seeds[r]).alias("seed"),
                              F.lit(sign[r]).alias("sign_seed")) for r in range(spec.depth)])


def _term_rows(terms: DataFrame, spec: SketchSpec) -> DataFrame:
    r = terms.withColumn("_r", F.explode(_rows(spec)))
    r = r.withColumn("row", F.col("_r.row")).withColumn(
        "bucket", F.pmod(hash32(F.col("term"), F.col("_r.seed")), F.lit(spec.width)))
    if spec.kind == "cs":
        r = r.withColumn("sign", F.when(hash32(F.col("term"), F.col("_r.sign_seed")) % 2 == 0, 1).otherwise(-1))
    return r.drop("_r")


def sketch_build(term_df: DataFrame, spec: SketchSpec, count_col: str = "df") -> DataFrame:
    """Cells (row, bucket, cnt) from (term, count)."""
    r = _term_rows(term_df.select("term", count_col), spec)
    val = F.col(count_col) * F.col("sign") if spec.kind == "cs" else F.col(count_col)
    return (r.groupBy("row", "bucket").agg(F.sum(val).cast("bigint").alias("cnt"))
             .filter(F.col("cnt") != 0))


def sketch_query(terms: DataFrame, cells: DataFrame, spec: SketchSpec) -> DataFrame:
    """(term, estimate). CMS: min over rows; CS: exact median of
    sign * cell. Missing cells count as 0 (left join)."""
    r = _term_rows(terms.select("term").distinct(), spec)
    j = r.join(cells, ["row", "bucket"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    if spec.kind == "cms":
        est = F.min("cnt").cast("double")
    else:
        est = F.median(F.col("cnt") * F.col("sign")).cast("double")
    return j.groupBy("term").agg(est.alias("estimate"))


def sketch_merge(cells: list[DataFrame], specs: list[SketchSpec]) -> DataFrame:
    """Cell-wise sum of sketches with identical kind, shape and seeds."""
    for s in specs[1:]:
        specs[0].check_mergeable(s)
    u = cells[0]
    for c in cells[1:]:
        u = u.unionByName(c)
    return u.groupBy("row", "bucket").agg(F.sum("cnt").cast("bigint").alias("cnt")).filter(F.col("cnt") != 0)


def sidf_weight(presence: Column, n_docs: Column, model: str = "bm25") -> Column:
    """0 if presence < 1; tfidf ln(N/p); bm25 with p capped at N:
    ln((N - p + .5) / (p + .5 + 1e-9)), which is negative when p > N/2."""
    if model == "bm25":
        p = F.least(presence, n_docs.cast("double"))
        w = F.log((n_docs - p + 0.5) / (p + 0.5 + 1e-9))
    else:
        w = F.log(n_docs / presence)
    return F.when(presence < 1, F.lit(0.0)).otherwise(w)


def builtin_cms(df: DataFrame, col: str, epsilon: float = 0.01, confidence: float = 0.99,
                seed: int = 42) -> DataFrame:
    """Spark's own count-min sketch aggregate (binary result, one row)."""
    return df.agg(F.count_min_sketch(F.col(col), F.lit(epsilon), F.lit(confidence), F.lit(seed)).alias("sketch"))
