"""Vocabulary, bag of words, corpus filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.tokens import by_repeated_id, pair_counts_of_rows, term_stats

BROADCAST_TERMS = 1_000_000


def build_vocabulary(df: DataFrame, tokens_col: str = "tokens", id_col: str = "doc_id",
                     min_df: int | float = 1, max_df: int | float = 1.0,
                     max_features: int | None = None) -> DataFrame:
    """(term_id, term, tf, df).

    Keep terms with ``df >= min_df`` and ``df <= max_df`` (a float is a share
    of the document count), then the ``max_features`` terms with the highest
    corpus frequency (ties: term ascending); ids follow alphabetical order.

    The document count is a scalar subquery. The top-k is a TakeOrdered (each
    task keeps k rows), so the id window sees at most ``max_features`` rows.
    """
    stats = term_stats(df, id_col, tokens_col)
    n_docs = df.select(F.count(F.lit(1))).scalar()
    lo = F.lit(min_df) if isinstance(min_df, int) else F.ceil(F.lit(min_df) * n_docs)
    hi = F.lit(max_df) if isinstance(max_df, int) else F.floor(F.lit(float(max_df)) * n_docs)
    kept = stats.filter((F.col("df") >= lo) & (F.col("df") <= hi))
    if max_features is not None:
        kept = kept.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    return kept.select(
        (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint").alias("term_id"),
        "term", F.col("tf").cast("bigint").alias("tf"), F.col("df").cast("bigint").alias("df"))


def bag_of_words(df: DataFrame, vocab: DataFrame, tokens_col: str = "tokens",
                 id_col: str = "doc_id", max_terms: int | None = None) -> DataFrame:
    """(doc_id, term_id, tf) over in-vocabulary tokens.

    ``max_terms`` is the row bound the vocabulary was cut to (its
    ``max_features``). Up to ``BROADCAST_TERMS`` it goes to every task, which
    counts a document's terms where it reads them; rows that share an id are
    one document and are grouped by it. A larger or unstated bound leaves the
    choice of a join to the planner's measured sizes.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens"))
    v = vocab.select("term", "term_id")
    if max_terms is None or max_terms > BROADCAST_TERMS:
        return _bag_by_joins(docs, v)
    listed = v.limit(max_terms).toArrow()
    known, ids = listed.column("term").combine_chunks(), listed.column("term_id").combine_chunks()
    alone, shared = by_repeated_id(docs, "doc_id")
    rows = alone.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    schema = rows.select("doc_id").schema.add("term_id", vocab.schema["term_id"].dataType).add("tf", "long")

    def count(batches):
        for b in batches:
            row, code, n, terms = pair_counts_of_rows(b.column("tokens"))
            place = pc.index_in(terms.cast(known.type), known, skip_nulls=True).take(pa.array(code))
            held = place.is_valid()
            keep = held.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[keep])), ids.take(place.filter(held)), pa.array(n[keep].astype(np.int64))], names=schema.names)

    bow = rows.mapInArrow(count, schema)
    return bow if shared is None else bow.unionByName(_bag_by_joins(shared, F.broadcast(v.limit(max_terms))))


def _bag_by_joins(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    toks = docs.select("doc_id", F.explode("tokens").alias("term"))
    return (toks.join(vocab, "term")
                .groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("tf")))


def filter_min_terms(bow: DataFrame, min_terms: int) -> DataFrame:
    """(doc_id, n_terms) for documents with at least ``min_terms`` in-vocabulary tokens."""
    return (bow.groupBy("doc_id").agg(F.sum("tf").cast("bigint").alias("n_terms"))
               .filter(F.col("n_terms") >= min_terms))


def time_word_frequency(bow: DataFrame, doc_slices: DataFrame, slice_col: str = "time_slice") -> DataFrame:
    """(time_slice, term_id, tf) summed over the documents of each slice."""
    return (bow.join(doc_slices.select("doc_id", slice_col), "doc_id")
               .groupBy(slice_col, "term_id").agg(F.sum("tf").cast("bigint").alias("tf")))
