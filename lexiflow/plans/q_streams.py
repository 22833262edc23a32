"""Queries: streaming jobs over the documents table used as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.plans.catalog import register
from lexiflow.plans.q_vectors import CMS
from lexiflow.sources import corpus_store
from lexiflow.sources.tables import table
from lexiflow.streaming import jobs as S


def _doc_stream(spark, sf_dir, whole=False):
    """The documents as they come, as many files at once as there are task slots; ``whole``: all files at once, where
    the result would hang on their order (a watermark)."""
    like = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return S.file_stream(spark, sf_dir, "documents.parquet", like, None if whole else spark.sparkContext.defaultParallelism)


@register("stream_clean")
def q_stream_clean(spark, sf_dir):
    root = S.stream_root(spark, "stream_clean")
    s = S.stream_clean(spark, _doc_stream(spark, sf_dir), "en", 15, X.ALPHABET_ANY)
    out = S.run_available(s, root)
    return spark.read.parquet(out).drop("batch_id")


@register("stream_language_counts")
def q_stream_language_counts(spark, sf_dir):
    root = S.stream_root(spark, "stream_language_counts")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"),
                                                   F.col("o_orderdate").cast("timestamp").alias("published_at"))
    s = _doc_stream(spark, sf_dir, whole=True).select("doc_id", F.col("lang").alias("language")).join(orders, "doc_id")
    counts = S.language_window_counts(s, "published_at", "30 days", "90 days")
    out = S.run_available(counts, root, output_mode="update")
    final = S.latest_per_key(spark.read.parquet(out), ["w", "language"])
    return final.select(F.col("w.start").alias("window_start"), "language", "n")


@register("stream_sketch")
def q_stream_sketch(spark, sf_dir):
    root = S.stream_root(spark, "stream_sketch")
    s = _doc_stream(spark, sf_dir).select("doc_id", X.tokenize_words("text").alias("tokens"))
    out = f"{root}/out"
    S.run_available(s, root, writer=S.sketch_writer(out, CMS))
    return S.merged_cells(spark, out, CMS).withColumn("row", F.col("row").cast("bigint"))


N_ARRIVALS = 5


@register("stream_windows_append")
def q_stream_windows_append(spark, sf_dir):
    """Five files of events, six days each; every 97th event of the first three comes with the last file. Days
    closed behind a watermark of three days, days still open, and the number of late rows."""
    root = S.stream_root(spark, "stream_windows_append")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    due = F.least(F.lit(N_ARRIVALS - 1), F.floor((F.dayofmonth("ts") - 1) / 6))
    e = e.withColumn("arrival", F.when((F.col("event_id") % 97 == 0) & (due < 3), N_ARRIVALS - 1).otherwise(due))
    path = S.arrivals(e, "arrival", N_ARRIVALS, f"{root}/in")
    stream = spark.readStream.schema(e.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = S.run_available(S.window_counts(stream, "ts", "event_type", "1 day", "3 days"), root)
    return S.settled_windows(spark, root, out, e.select(F.count(F.lit(1))).scalar())


@register("stream_sketch_ledger")
def q_stream_sketch_ledger(spark, sf_dir):
    """Five arrivals of documents, every micro-batch delivered twice as after a failure; the merged sketch."""
    root = S.stream_root(spark, "stream_sketch_ledger")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    write = S.ledger_sketch_writer(f"{root}/store", CMS)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    S.run_arrivals(d.withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(N_ARRIVALS))), "arrival", N_ARRIVALS, root,
                   lambda stream: stream.select("doc_id", X.tokenize_words("text").alias("tokens")), twice)
    return corpus_store.load(spark, f"{root}/store")["cells"].withColumn("row", F.col("row").cast("bigint"))
