"""Isolation forest outlier detection on a vector column.

Published method (Liu et al. 2008): ``n_trees`` random isolation trees, each
grown on ``min(256, N)`` sampled rows; the anomaly score is
``2 ** (-E[h(x)] / c(psi))``. The Spark plan:

1. Sampling without a row x tree explode: each row lists, inside the row, the
   trees whose seeded hash admits it (about 2 x psi rows per tree expected);
   a ``row_number() <= psi`` window (partial group limit) keeps exactly psi.
2. Each tree is grown by ``groupBy(tree).applyInPandas`` on its <= psi rows.
3. The forest (n_trees x < 2 psi nodes, bounded by parameters) is collected
   and broadcast; every vector is scored with ``mapInPandas`` on Arrow batches.
4. The contamination cut is a percentile of the scores (approximate, with a
   fine accuracy setting), never a global sort.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.hashing import hash32


def _c(n: int) -> float:
    """Average path length of an unsuccessful search in a BST of n nodes."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, max_depth: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    x = np.stack(pdf["v"].to_numpy())
    rng = np.random.default_rng(tree)
    nodes = []  # (node, feature, threshold, left, right, size)

    def build(idx, depth):
        nid = len(nodes)
        nodes.append(None)
        if depth >= max_depth or len(idx) <= 1:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx))
            return nid
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx))
            return nid
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = build(idx[sub[:, f] < thr], depth + 1)
        right = build(idx[sub[:, f] >= thr], depth + 1)
        nodes[nid] = (nid, f, thr, left, right, len(idx))
        return nid

    build(np.arange(len(x)), 0)
    out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size"])
    out.insert(0, "tree", tree)
    return out


def isolation_forest(vecs: DataFrame, n_trees: int = 100, psi: int = 256, contamination: float = 0.05,
                     seed: int = 42, id_col: str = "doc_id", vec_col: str = "vector") -> DataFrame:
    """(id, score, label) with label -1 for the ``contamination`` share of
    highest scores and 1 otherwise."""
    spark = vecs.sparkSession
    n_rows = vecs.count()
    psi = max(1, min(psi, n_rows))
    keep = min(1.0, 2.0 * psi / max(n_rows, 1))
    thr = int(keep * 2 ** 32)
    v = vecs.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: hash32(F.concat(t.cast("string"), F.lit(":"), F.col("id").cast("string")), seed) < thr)
    s = v.select("id", "v", F.explode(trees).alias("tree"))
    s = s.withColumn("_h", hash32(F.concat(F.col("tree").cast("string"), F.lit(":"), F.col("id").cast("string")), seed))
    s = s.withColumn("_rn", F.row_number().over(Window.partitionBy("tree").orderBy("_h", "id"))).filter(F.col("_rn") <= psi)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    schema = "tree int, node int, feature int, threshold double, left int, right int, size int"
    forest = s.select("tree", "v").groupBy("tree").applyInPandas(lambda p: _grow(p, max_depth), schema)
    # n_trees x (< 2 psi) nodes: a model of bounded size.
    model = forest.toPandas().sort_values(["tree", "node"])
    bc = spark.sparkContext.broadcast(model)
    c_psi = _c(psi)

    def score(batches):
        m = bc.value
        tabs = [(g[["feature", "threshold", "left", "right", "size"]].to_numpy()) for _, g in m.groupby("tree")]
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            total = np.zeros(len(pdf))
            for tab in tabs:
                node = np.zeros(len(pdf), dtype=int)
                depth = np.zeros(len(pdf))
                active = np.ones(len(pdf), dtype=bool)
                while active.any():
                    f = tab[node, 0].astype(int)
                    leaf = f < 0
                    done = active & leaf
                    if done.any():
                        depth[done] += np.array([_c(int(sz)) for sz in tab[node[done], 4]])
                    active &= ~leaf
                    if not active.any():
                        break
                    idx = np.flatnonzero(active)
                    go_left = x[idx, f[idx]] < tab[node[idx], 1]
                    node[idx] = np.where(go_left, tab[node[idx], 2], tab[node[idx], 3]).astype(int)
                    depth[idx] += 1
                total += depth
            yield pd.DataFrame({"id": pdf["id"], "score": 2.0 ** (-(total / len(tabs)) / c_psi)})

    scored = v.mapInPandas(score, "id long, score double")
    cut = scored.select(F.percentile_approx("score", 1.0 - contamination, 100000)).scalar()
    return scored.select(F.col("id").alias(id_col), "score",
                         F.when(F.col("score") > cut, F.lit(-1)).otherwise(F.lit(1)).alias("label"))


def filter_outliers(vecs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keep inlier rows (label 1)."""
    return vecs.join(labels.filter(F.col("label") == 1).select(id_col), id_col, "left_semi")
