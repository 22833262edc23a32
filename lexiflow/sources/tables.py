"""Adapters that present the driver's parquet tables in the shapes the
operators consume (comment tables, topic-labelled documents, vectors).

Only column projections and one key join happen here; Catalyst prunes the
parquet scan to the columns each query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.hashing import score01


# Text-heavy tables and their key: regex cleaning and tokenising are CPU
# bound, so these scans must have at least as many splits as task slots.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = TEXT_TABLES.get(name)
    if key is not None:
        df = spread(df, key)
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by ``key`` when the scan has fewer splits than the
    cluster has task slots (a few large files or row groups). Large inputs
    already scan in many splits and are left untouched; the hash layout is
    reused by later joins and aggregations on the same key."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots, key)
    return df


def platform_of(source_col) -> F.Column:
    """`srcN` -> YouTube for even N, Telegram for odd N."""
    s = F.col(source_col) if isinstance(source_col, str) else source_col
    n = s.substr(F.lit(4), F.length(s)).cast("int")
    return F.when(n % 2 == 0, F.lit("YouTube")).otherwise(F.lit("Telegram"))


def comments(spark: SparkSession, sf_dir: str, with_time: bool = True) -> DataFrame:
    """Comment table: (doc_id, comment, published_at, language, language_score, platform).

    The publication time comes from the order with the same key and is null
    where there is none. The join is an equi-join on a unique key, so it
    shuffles both sides once (or broadcasts orders when AQE finds it small).
    ``with_time`` False leaves the time, and with it the join, out.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if not with_time:
        return docs.select("doc_id", F.col("text").alias("comment"), F.col("lang").alias("language"),
                           score01(F.col("doc_id")).alias("language_score"), platform_of(F.col("source")).alias("platform"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("published_at"))
    return (docs.join(orders, "doc_id", "left")
            .select("doc_id",
                    F.col("text").alias("comment"),
                    "published_at",
                    F.col("lang").alias("language"),
                    score01(F.col("doc_id")).alias("language_score"),
                    platform_of(F.col("source")).alias("platform")))


def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, topic): the vector label when a vector exists, else -1 (outlier)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("topic"))


def documents_with_topics(spark: SparkSession, sf_dir: str, with_time: bool = True) -> DataFrame:
    """Comments plus (topic, probability); probability is a deterministic score."""
    c = comments(spark, sf_dir, with_time)
    return (c.join(topic_labels(spark, sf_dir), "doc_id", "left")
            .withColumn("topic", F.coalesce(F.col("topic"), F.lit(-1)))
            .withColumn("probability", score01(F.col("doc_id"), seed="p")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding ARRAY<FLOAT>, label)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
