"""Hard negatives by Kronecker-packed products.

Vectors are scaled and floored to integers. A candidate's components are biased to be
non-negative and several candidates are packed into separated bit fields of one wide integer per
component; each anchor component is multiplied once with this integer, and the fields of the
summed products, freed of the bias, are the exact scores of all packed candidates. The field
width follows from the largest sum that the block at hand can reach. Wide integers are doubles
while all fields fit their 53 exact bits (then the products are one matrix product), else Python
integers of any length.

The anchors are the stated query set: blocks of anchors meet blocks of candidates, each pair of
blocks in one task, and every block emits its best rows only. Blocks are dealt by a hash of the
id, so neither a hot label nor a group of copies makes a large block; the best over all blocks are
taken by a window whose limit is applied before its shuffle. First the positives are found (only
candidates of an anchor's label are multiplied), then the negatives in their score windows.

Defined results: rows with null id or label, null vector, or null or non-finite components take no
part; a shorter vector counts as padded with zeros; of rows that share an id, the one smallest in
label, then vector, stands for all; a row is never its own positive; scores beyond a long are held
at its ends; ties go to the smaller id; an anchor without a positive, and a pair without a negative,
give no row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import materialize

SCALE = 256
CELLS = 1 << 23        # components per block of candidates or anchors, at most
FEWEST = 2048          # rows per block, at least, where a table is split for parallel work alone
TILE = 64              # anchors multiplied at once
EXACT = 53             # bits of a double's integers
FIELDS = 8             # candidates in a Python integer
LONG = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _vectors(column, dim: int) -> np.ndarray:
    """Integer components as doubles, padded with zeros."""
    column = column.combine_chunks()
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


class Packed:
    """Candidates in the fields of wide integers, for the anchors given."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        low = candidates.min(initial=0)
        most = float(np.abs(anchors).sum(axis=1).max(initial=0)) * float(candidates.max(initial=0) - low)
        self.n, self.wide = len(candidates), not most < 1 << 50
        if self.wide:
            ints = np.vectorize(int, otypes=[object])
            candidates, self.anchors = ints(candidates), ints(anchors)
            low = int(low)
            most = max((sum(map(abs, a)) for a in self.anchors.tolist()), default=0) * (int(candidates.max(initial=0)) - low)
        else:
            self.anchors = anchors
        self.bias = -int(low)
        self.width = max(1, int(2 * most + 1).bit_length())      # sums from -most to most, and one to spare
        self.most = int(most)
        self.fields = FIELDS if self.wide else EXACT // self.width
        unit = 1 << self.width
        groups = -(-self.n // self.fields)
        self.packed = np.zeros((candidates.shape[1], groups), candidates.dtype)
        for i in range(self.fields):
            c = candidates[i::self.fields].T - low
            self.packed[:, :c.shape[1]] += c * (unit ** i if self.wide else float(unit ** i))

    def scores(self, lo: int, hi: int) -> np.ndarray:
        """Inner products of the anchors lo..hi with all candidates."""
        a = self.anchors[lo:hi]
        total = a @ self.packed
        if not self.wide:
            total = total.astype(np.int64)
        total = total + self.most * sum(1 << self.width * i for i in range(self.fields))
        own = self.most + self.bias * a.sum(axis=1)
        out = np.empty((len(a), self.packed.shape[1] * self.fields), np.int64)
        for i in range(self.fields):
            s = ((total >> self.width * i) & ((1 << self.width) - 1)) - own[:, None]
            out[:, i::self.fields] = np.clip(s, -LONG, LONG).astype(np.int64)
        return out[:, :self.n]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the smaller place."""
    at = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _codes(anchors: pa.Table, rows: pa.Table):
    """Labels of both tables as common integers."""
    both = pa.chunked_array(anchors.column("label").chunks + rows.column("label").chunks, anchors.schema.field("label").type)
    codes = both.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes[:len(anchors)], codes[len(anchors):]


def _block(rows: pa.Table, dim: int):
    rows = rows.sort_by("id")
    return rows, rows.column("id").to_numpy(), _vectors(rows.column("q"), dim)


def block_positives(anchors: pa.Table, rows: pa.Table, dim: int, k: int):
    """(anchor id, score, id): each anchor's k best rows of its label in one block."""
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(anchors) and len(rows):
        rows, ids, q = _block(rows, dim)
        aid, aq = anchors.column("id").to_numpy(), _vectors(anchors.column("q"), dim)
        ac, rc = _codes(anchors, rows)
        for label in np.unique(ac):
            mine, theirs = np.flatnonzero(ac == label), np.flatnonzero(rc == label)
            if not len(theirs):
                continue
            p = Packed(q[theirs], aq[mine])
            for lo in range(0, len(mine), TILE):
                for a, s in zip(mine[lo:lo + TILE], p.scores(lo, lo + TILE)):
                    at = best(s, k + 1)
                    at = at[ids[theirs[at]] != aid[a]][:k]
                    for c, v in zip(out, (np.full(len(at), aid[a]), s[at], ids[theirs[at]])):
                        c.append(v)
    return [np.concatenate(c) for c in out]


def block_negatives(anchors: pa.Table, rows: pa.Table, dim: int, k: int, low: int, high: int):
    """(anchor id, positive's place, score, id): each pair's k best rows of other labels in its score window in one block."""
    out = [], [], [], []
    if len(anchors) and len(rows):
        rows, ids, q = _block(rows, dim)
        ac, rc = _codes(anchors, rows)
        aid, asked = anchors.column("id").to_pylist(), anchors.column("positives").to_pylist()
        p = Packed(q, _vectors(anchors.column("q"), dim))
        for lo in range(0, len(anchors), TILE):
            for a, s in enumerate(p.scores(lo, lo + TILE), lo):
                spans = [(-(-low * x["score"] // 100), high * x["score"] // 100) for x in asked[a]]
                real = [w for w in spans if w[0] <= w[1]]
                if not real:
                    continue
                near = np.flatnonzero((s >= max(min(w[0] for w in real), -LONG)) & (s <= min(max(w[1] for w in real), LONG)) & (rc != ac[a]))
                v, found = s[near], {}
                for place, w in enumerate(spans):
                    if w not in found:
                        inside = np.flatnonzero((v >= max(w[0], -LONG)) & (v <= min(w[1], LONG))) if w[0] <= w[1] else np.zeros(0, np.int64)
                        found[w] = inside[best(v[inside], k)]
                    at = found[w]
                    for c, x in zip(out, ([aid[a]] * len(at), [place] * len(at), v[at].tolist(), ids[near[at]].tolist())):
                        c.extend(x)
    return out


def mine(df: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         id_col="vec_id", label_col="label", vec_col="embedding", scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``anchors`` holds for,
    and each of its nearest rows of the same label, the nearest rows of other labels whose score is ``low`` to ``high``
    percent of the positive's."""
    spark = df.sparkSession
    v, id_ = F.col("v"), F.col("id")
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"), anchors.alias("is_anchor"))
            .where(id_.isNotNull() & F.col("label").isNotNull() & v.isNotNull()
                   & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
    scaled = F.transform(v, lambda x: x.cast("double") * float(scale))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_anchor"), 1)).alias("anchors"), F.max(F.size("v")).alias("dim"),
                    F.max(F.array_max(F.transform(scaled, F.abs))).alias("largest")).first()
    if not seen.n:
        return spark.createDataFrame([], RESULT)
    dim = max(1, seen.dim)
    q = F.transform(scaled, lambda x: F.floor(x).cast("short")) if (seen.largest or 0) < 1 << 15 else scaled
    rows = (rows.select("id", F.struct("label", q.alias("q"), "is_anchor").alias("row")).groupBy("id").agg(F.min("row").alias("row"))
            .select("id", "row.*"))
    rows = materialize(rows, "hardneg-rows")
    most = max(1, CELLS // dim)
    slots = spark.sparkContext.defaultParallelism
    blocks = max(-(-seen.n // most), min(slots, -(-seen.n // FEWEST)))
    anchor_blocks = -(-seen.anchors // most) or 1

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))

    def dealt(n):
        return F.pmod(F.xxhash64("id"), F.lit(int(n))).cast("int")

    candidates = rows.select("id", "label", "q", dealt(blocks).alias("j"), every(anchor_blocks).alias("i")).groupBy("i", "j")

    def meet(asked, block_rows, schema):
        asked = asked.withColumn("i", dealt(anchor_blocks)).withColumn("j", every(blocks)).groupBy("i", "j")
        return asked.cogroup(candidates).applyInArrow(block_rows, schema)

    def positives(a: pa.Table, r: pa.Table) -> pa.Table:
        return pa.table([pa.array(c, pa.int64()) for c in block_positives(a, r, dim, n_positives)], ["anchor_id", "score", "id"])

    asked = rows.where("is_anchor").select("id", "label", "q")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    found = (meet(asked, positives, "anchor_id long, score long, id long").withColumn("nth", first).where(F.col("nth") <= n_positives)
             .groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "id"))).alias("positives")))
    asked = materialize(asked.join(found, id_ == F.col("anchor_id")).select("id", "label", "q", "positives"), "hardneg-positives")

    def negatives(a: pa.Table, r: pa.Table) -> pa.Table:
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
        return pa.table([pa.array(c, t) for c, t in zip(block_negatives(a, r, dim, n_negatives, low, high), kinds)],
                        ["anchor_id", "place", "negative_score", "negative_id"])

    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    out = (meet(asked, negatives, "anchor_id long, place int, negative_score long, negative_id long")
           .withColumn("rank", rank).where(F.col("rank") <= n_negatives))
    pair = asked.select(id_.alias("anchor_id"), F.posexplode("positives").alias("place", "p"))
    return (out.join(pair, ["anchor_id", "place"])
            .select("anchor_id", F.col("p.id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score"))


ORACLE = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10"""
