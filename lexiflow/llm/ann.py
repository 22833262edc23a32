"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the inverted
files of its ``POSTED`` nearest pivots; a query reads the files of its nearest pivots
until they hold enough postings, ranks these by the footrule distance between the
permutations, and reranks the best by the exact inner product. The footrule ranking goes
across files: a distance is worth the number of vectors of a bounded reference sample that
are nearer to the query, and one such number is the limit for all queries and files. How
many postings are enough and where the limit lies is measured on every table: a bounded
sample of the queries is searched by brute force, and both are set to hold ``TARGET`` of
the neighbours found so. The nearest files, up to ``k + 1`` classes, are reranked whole.
For the pivots only, vectors are scaled to the largest norm and completed to the unit
sphere, where nearness and inner product agree.

Equal vectors form one class with its ``k + 1`` smallest ids, which is all that a
result of ``k`` can use; equal queries are searched once. Large files are split into
blocks. Pivots come from a bounded sample (4 sqrt(classes), at most ``MAX_PIVOTS``);
every class is indexed.

Defined results: vectors null, zero, of another length than the longest, or holding
null or non-finite components take no part; a repeated (id, vector) row counts once;
ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import bounded_sample, materialize

MAX_PIVOTS = 4096
POSTED = 3             # files that a vector is posted in
ORDER = 32             # pivots in a permutation
REFERENCE = 1024       # vectors that footrule distances are compared with
SAMPLE = 128           # queries searched by brute force to measure the effort
TARGET = 0.96          # recall held on them
BLOCK = 20000          # postings per block of a file


def _matrix(column, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _sphere(x: np.ndarray, norm: float) -> np.ndarray:
    y = x / norm
    return np.hstack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1, keepdims=True)))])


def _permutations(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest pivots of each row, nearest first."""
    out = np.empty((len(x), n), np.int32)
    for i in range(0, len(x), 2048):
        s = -(x[i:i + 2048] @ pivots.T)
        part = np.argpartition(s, min(n, s.shape[1] - 1), axis=1)[:, :n] if n < s.shape[1] else np.argsort(s, axis=1)[:, :n]
        o = np.argsort(np.take_along_axis(s, part, 1), axis=1, kind="stable")
        out[i:i + 2048] = np.take_along_axis(part, o, 1)
    return out


def footrule(perms: np.ndarray, query: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distance of each row's truncated permutation to the query's; an absent pivot stands at the end."""
    n = len(query)
    place = np.full(pivots, n, np.int32)
    place[query] = np.arange(n)
    at = place[perms]
    both = np.abs(at - np.arange(n)).sum(axis=1)
    return both + (n * n - n * (n - 1) // 2) - np.where(at < n, n - at, 0).sum(axis=1)


def exact(classes: DataFrame, vectors: np.ndarray, k: int) -> list:
    """Rows (q, v): the ``k`` nearest classes of each of a few vectors, by brute force."""
    def run(batches):
        top = [[] for _ in vectors]
        for b in batches:
            if not b.num_rows:
                continue
            s = _matrix(b.column("v")) @ vectors.T
            best = np.argpartition(-s, min(k, len(s)) - 1, axis=0)[:k]
            cls, v = b.column("cls"), b.column("v")
            for q, rows in enumerate(best.T):
                found = [(-float(s[i, q]), cls[int(i)].as_py(), v[int(i)]) for i in rows if len(top[q]) < k or -s[i, q] <= top[q][-1][0]]
                top[q] = sorted(top[q] + found, key=lambda t: t[:2])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, t in enumerate(top) for _ in t], pa.int32()),
                                          *(pa.array([x[i] if i < 2 else x[i].as_py() for t in top for x in t], kind)
                                            for i, kind in enumerate((pa.float64(), pa.int64(), pa.list_(pa.float64()))))], ["q", "neg", "cls", "v"])

    nth = F.row_number().over(Window.partitionBy("q").orderBy("neg", "cls"))
    near = classes.select("cls", "v").mapInArrow(run, "q int, neg double, cls long, v array<double>")
    return near.withColumn("nth", nth).where(F.col("nth") <= k).collect()     # at most k rows for each vector


def depths(near: np.ndarray, query: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Postings in the files that a query has read when it meets each neighbour; ``near`` has the files these are
    posted in, ``query`` has all pivots, nearest first."""
    place = np.empty(len(query), np.int64)
    place[query] = np.arange(len(query))
    return np.cumsum(sizes[query])[place[near].min(axis=1)]


def nearer(reference: np.ndarray, query: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distances of the reference sample to a query, in order."""
    return np.sort(footrule(reference, query, pivots))


def measure(deep: np.ndarray, nearer_than: np.ndarray, worst: int) -> tuple[int, int]:
    """(postings to read, limit of the footrule ranking) that together keep ``TARGET`` of the neighbours."""
    enough = int(np.quantile(deep, (1 + TARGET) / 2, method="higher"))
    return enough, int(np.quantile(np.where(deep <= enough, nearer_than, worst), TARGET, method="higher"))


def search(df: DataFrame, queries: DataFrame, k: int = 20, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row, itself excluded."""
    v = F.col("v")

    def usable(d):
        d = d.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
        return d.where(v.isNotNull() & F.col("id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                       & F.exists(v, lambda x: x != 0))

    rows = usable(df)
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dim)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = materialize(rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
                          .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members"))
                          .select("v", "members", F.col("members")[0].alias("cls")), "ann-classes")
    own = materialize(usable(queries).where(F.size("v") == dim).distinct()
                      .join(classes.select("v", "cls"), "v").select("id", "cls"), "ann-queries")
    asked = own.select("cls").distinct().join(classes.select("cls", "v"), "cls")
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("norm")).first()
    m = int(min(MAX_PIVOTS, max(32, 4 * stats.n ** 0.5)))
    norm = stats.norm
    chosen = _sphere(np.array([r.v for r in bounded_sample(classes.select("cls", "v"), "cls", m + REFERENCE).collect()], np.float64), norm)
    pivots = chosen[:m]
    order, posted = min(ORDER, len(pivots)), min(POSTED, len(pivots))
    reference = _permutations(chosen[-REFERENCE:], pivots, order)

    def post(batches):
        for b in batches:
            if not b.num_rows:
                continue
            perm = _permutations(_sphere(_matrix(b.column("v")), norm), pivots, order)
            at = np.repeat(np.arange(b.num_rows), posted)
            t = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([t.column("cls"), t.column("members"), t.column("v"),
                                              pa.array(list(perm[at]), pa.list_(pa.int32())), pa.array(perm[:, :posted].reshape(-1))],
                                             ["cls", "members", "v", "perm", "file"])

    kind = classes.schema["v"].dataType.simpleString()
    postings = materialize(classes.select("cls", "members", "v").mapInArrow(
        post, f"cls long, members array<long>, v {kind}, perm array<int>, file int"), "ann-postings")
    sizes = np.zeros(len(pivots), np.int64)
    for r in postings.groupBy("file").count().collect():      # one row per pivot
        sizes[r["file"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK))

    def nearest(x):
        """All pivots in order for each query."""
        return _permutations(np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))]), pivots, len(pivots))

    whole = POSTED * (k + 1)        # so many postings are k + 1 classes at least
    enough, limit = whole, len(reference)
    tried = bounded_sample(asked, "cls", SAMPLE).collect()
    if tried:
        tx = np.array([r.v for r in tried], np.float64)
        true = [r for r in exact(classes, tx, k + 1) if r.cls != tried[r.q].cls]
        if true:
            tq, tp = nearest(tx), _permutations(_sphere(np.array([r.v for r in true]), norm), pivots, order)
            of = np.array([r.q for r in true])
            deep = np.concatenate([depths(tp[of == q, :posted], tq[q], sizes) for q in np.unique(of)])
            worth = np.concatenate([np.searchsorted(nearer(reference, tq[q, :order], len(pivots)), footrule(tp[of == q], tq[q, :order], len(pivots)))
                                    for q in np.unique(of)])
            enough, limit = measure(deep, worth, len(reference))
            enough = max(enough, whole)

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            perm = nearest(_matrix(b.column("v")))
            held = np.cumsum(sizes[perm], axis=1)
            n = np.minimum(len(pivots), (held < enough).sum(axis=1) + 1)
            at, file, block, cut = [], [], [], []
            for i in range(len(perm)):
                most = int(nearer(reference, perm[i, :order], len(pivots))[limit]) if limit < len(reference) else ORDER * (ORDER + 1)
                for j, f in enumerate(perm[i, :n[i]].tolist()):
                    if sizes[f]:
                        c = int(blocks[f])
                        at += [i] * c
                        file += [f] * c
                        block += range(c)
                        cut += [ORDER * (ORDER + 1) if held[i, j] - sizes[f] < whole else most] * c
            t = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column("cls"), t.column("v"), pa.array(list(perm[at, :order]), pa.list_(pa.int32())),
                                              pa.array(file, pa.int32()), pa.array(block, pa.int32()), pa.array(cut, pa.int32())],
                                             ["cls", "v", "perm", "file", "block", "cut"])

    def rank(q: pa.Table, p: pa.Table) -> pa.Table:
        out = [], []
        if len(q) and len(p):
            pv, pp = (_matrix(p.column(c).combine_chunks(), t) for c, t in (("v", np.float64), ("perm", np.int32)))
            qv, qp = (_matrix(q.column(c).combine_chunks(), t) for c, t in (("v", np.float64), ("perm", np.int32)))
            members = p.column("members").to_pylist()
            for cls, x, perm, cut in zip(q.column("cls").to_pylist(), qv, qp, q.column("cut").to_pylist()):
                near = np.flatnonzero(footrule(pp, perm, len(pivots)) <= cut)
                if not len(near):
                    continue
                s = (pv[near] * x).sum(axis=1)
                best = near if len(s) <= k + 1 else near[s >= np.partition(s, -(k + 1))[-(k + 1)]]
                out[0].append(cls)
                out[1].append(sorted((-float((pv[j] * x).sum()), i) for j in best for i in members[j])[:k + 1])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(hit))], ["cls", "hits"])

    hit = pa.struct([("neg", pa.float64()), ("vec_id", pa.int64())])
    n_blocks = F.element_at(F.lit([int(x) for x in blocks]), F.col("file") + 1)
    shelved = postings.withColumn("block", F.pmod(F.xxhash64("cls"), n_blocks).cast("int")) if blocks.max() > 1 else postings.withColumn("block", F.lit(0))
    probes = asked.mapInArrow(probe, f"cls long, v {kind}, perm array<int>, file int, block int, cut int")
    found = probes.groupBy("file", "block").cogroup(shelved.groupBy("file", "block")).applyInArrow(rank, "cls long, hits array<struct<neg: double, vec_id: bigint>>")
    # one row of at most k + 1 hits per file read; a hit comes from POSTED files at most
    first = F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, POSTED * (k + 1))
    best = found.groupBy("cls").agg(F.slice(F.array_distinct(first), 1, k + 1).alias("best"))
    best = materialize(best, "ann-best")
    mine = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return (own.join(best, "cls").select(F.col("id").alias("query_id"), F.posexplode(mine).alias("pos", "hit"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                    (-F.col("hit.neg")).alias("score")))
