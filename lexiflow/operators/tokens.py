"""Token tables and term statistics.

A document is one row, so per-document work (token arrays, distinct terms,
document length) stays inside the row; only term-keyed statistics shuffle,
and those aggregate partially on the map side first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import stage

BROADCAST_IDS = 1_000_000


def explode_tokens(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Long form (doc_id, pos, term)."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.posexplode(tokens_col).alias("pos", "term"))


def doc_length(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Tokens per document."""
    return df.select(F.col(id_col).alias("doc_id"), F.size(tokens_col).cast("bigint").alias("dl"))


def avg_doc_length(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Corpus ``avg_dl`` = total tokens / documents; 1.0 for an empty corpus."""
    return df.agg(F.count(F.lit(1)).alias("n_docs"),
                  F.sum(F.size(tokens_col)).cast("bigint").alias("n_tokens")).select(
        "n_docs", "n_tokens",
        F.coalesce(F.col("n_tokens") / F.nullif(F.col("n_docs"), F.lit(0)), F.lit(1.0)).alias("avg_dl"))


def term_frequency(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, term, tf). A document's tokens share a task, so the
    partial aggregate already produces final counts before the shuffle."""
    return (df.select(F.col(id_col).alias("doc_id"), F.explode(tokens_col).alias("term"))
              .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))


def document_frequency(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(term, df): documents containing the term, each counted once.

    De-duplication happens in the row (``array_distinct``), so the only
    shuffle is the term-keyed partial aggregate.
    """
    return (df.select(F.explode(F.array_distinct(tokens_col)).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def by_repeated_id(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id is theirs alone, the other rows or None): only the latter must meet to be counted as one document."""
    ids = stage(df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id"), "repeated-ids")
    n = ids.limit(BROADCAST_IDS + 1).count()
    if not n:
        return df, None
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    return df.join(ids, same, "left_anti"), df.join(ids, same, "left_semi")


def pair_counts_of_rows(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, n, terms): how often each term occurs in each row of a batch; ``terms[code]`` is the term (a null term is one)."""
    found = tokens.flatten().dictionary_encode()
    terms = pa.concat_arrays([found.dictionary, pa.nulls(1, found.dictionary.type)])
    code = found.indices.fill_null(len(terms) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    key, n = np.unique(pc.list_parent_indices(tokens).to_numpy() * len(terms) + code, return_counts=True)
    return key // len(terms), key % len(terms), n, terms


def term_stats(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(term, tf, df) with corpus term frequency and document frequency.

    A batch of documents is counted in its task, which emits one row per term
    of the batch: neither a table nor a shuffle of (document, term) pairs is
    made. Rows that share an id are one document and are grouped by it.
    """
    alone, shared = by_repeated_id(df.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens")), "doc_id")

    def count(batches):
        for b in batches:
            _, code, n, terms = pair_counts_of_rows(b.column("tokens"))
            tf = np.bincount(code, n, len(terms)).astype(np.int64)
            met = np.flatnonzero(tf)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(met)), pa.array(tf[met]), pa.array(np.bincount(code, minlength=len(terms))[met])], names=["term", "tf", "df"])

    counts = alone.select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(count, "term string, tf long, df long")
    if shared is not None:
        counts = counts.unionByName(term_frequency(shared).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")))
    return counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
