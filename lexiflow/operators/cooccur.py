"""Counting requested words and word pairs in one pass.

The requests, (word, word) pairs, form a bounded dictionary whose size is checked.
It goes to every task; a batch of documents becomes one bit row per wanted word
(a bit per document), and a pair's count is the number of common bits. Each task
emits one partial count per pair that it met. The corpus is read once, no row of
it is shuffled, and no exchange is keyed by a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stage

MAX_REQUESTS = 2_000_000       # pairs sent to the tasks; more are counted by joins
DOCS = 4096                    # documents whose bits are held at once
CELLS = 1 << 23                # machine words compared at once


def _bits(rows: np.ndarray, words: np.ndarray, n_words: int, n_docs: int) -> np.ndarray:
    """(n_words, machine words): bit d of row w is set if document d holds word w."""
    held = np.zeros((n_words, -(-n_docs // 64) * 64), bool)
    held[words, rows] = True
    return np.packbits(held, axis=1, bitorder="little").view(np.uint64)


def count_requested(corpus: DataFrame, requests: DataFrame, by: str | None = None, tokens_col: str = "tokens") -> DataFrame:
    """([by], wi, wj, n): documents that hold both words, for every requested ([by], wi, wj) with n > 0. A request
    (w, w) counts the documents with w. With ``by`` only documents of that value count."""
    keys = [*([by] if by else []), "wi", "wj"]
    requests = stage(requests.select(*keys).distinct(), "requests")
    if requests.limit(MAX_REQUESTS + 1).count() > MAX_REQUESTS:
        return _by_joins(corpus, requests, keys, tokens_col)
    asked = requests.toArrow()
    wanted = pa.chunked_array([*asked.column("wi").chunks, *asked.column("wj").chunks], pa.string()).unique()
    i, j = (pc.index_in(asked.column(c), wanted).to_numpy() for c in ("wi", "wj"))
    groups = asked.column(by).unique() if by else None
    g = pc.index_in(asked.column(by), groups).to_numpy() if by else np.zeros(len(i), np.int64)
    step = max(1, CELLS // (DOCS // 64))
    schema = requests.schema.add("n", "long")

    def count(batches):
        total = np.zeros(len(i), np.int64)
        for b in batches:
            for k in range(0, b.num_rows, DOCS):
                part = b.slice(k, DOCS)
                tokens = part.column(tokens_col)
                words = pc.index_in(tokens.flatten(), wanted)
                rows = pc.list_parent_indices(tokens)
                known = pc.is_valid(words)
                held = _bits(rows.filter(known).to_numpy(), words.filter(known).to_numpy(), len(wanted), part.num_rows)
                inside = None
                if by:
                    group = pc.index_in(part.column(by).cast(groups.type), groups)
                    known = np.flatnonzero(pc.is_valid(group).to_numpy(zero_copy_only=False))
                    inside = _bits(known, group.drop_null().to_numpy(), len(groups), part.num_rows)
                for s in range(0, len(i), step):
                    both = held[i[s:s + step]] & held[j[s:s + step]]
                    if by:
                        both &= inside[g[s:s + step]]
                    total[s:s + step] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        met = pa.array(np.flatnonzero(total))
        found = asked.take(met).append_column("n", pa.array(total[total > 0]))
        yield from found.combine_chunks().to_batches()

    docs = corpus.select(*([by] if by else []), F.coalesce(tokens_col, F.array().cast("array<string>")).alias(tokens_col))
    return docs.mapInArrow(count, schema).groupBy(*keys).agg(F.sum("n").alias("n"))


def _by_joins(corpus: DataFrame, requests: DataFrame, keys: list[str], tokens_col: str) -> DataFrame:
    """The same for a request list of any size: the pairs join the (document, word) incidence on both words."""
    by = keys[:-2]
    needed = requests.select(*by, F.explode(F.array("wi", "wj")).alias("w")).distinct()
    held = corpus.select("doc_id", *by, F.explode(F.array_distinct(tokens_col)).alias("w")).join(needed, [*by, "w"], "left_semi")
    first = held.withColumnRenamed("w", "wi")
    second = held.withColumnRenamed("w", "wj")
    return (requests.join(first, [*by, "wi"]).join(second, [*by, "doc_id", "wj"], "left_semi")
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def pair_counts(corpus: DataFrame, pairs: DataFrame, by: str | None = None) -> DataFrame:
    """([by], wi, wj, c_i, c_j, c_ij) for the requested pairs that occur together."""
    g = [by] if by else []
    pairs = pairs.select(*g, "wi", "wj").distinct()
    alone = pairs.select(*g, F.explode(F.array("wi", "wj")).alias("wi")).distinct().withColumn("wj", F.col("wi"))
    n = stage(count_requested(corpus, pairs.unionByName(alone), by), "pair-counts")       # read as pairs and as words
    one = n.where("wi = wj")
    ci = one.select(*g, "wi", F.col("n").alias("c_i"))
    cj = one.select(*g, "wj", F.col("n").alias("c_j"))
    return n.join(pairs, [*g, "wi", "wj"], "left_semi").join(ci, [*g, "wi"]).join(cj, [*g, "wj"]).select(*g, "wi", "wj", "c_i", "c_j", F.col("n").alias("c_ij"))
