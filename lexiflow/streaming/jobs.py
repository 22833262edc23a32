"""Structured Streaming versions of the batch operators.

Sources are file streams (new parquet files arrive in a folder). Sinks are
idempotent: every micro-batch writes its own ``batch_id=N`` folder with
overwrite, so a retried batch replaces its earlier attempt instead of
duplicating it. State and outputs live under the session's shared
``spark.checkpoint.dir``, never on a machine-local path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.operators import sketch as K
from lexiflow.operators import tokens as T
from lexiflow.session import ensure_checkpoint_dir
from lexiflow.sources import corpus_store


def stream_root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiflow-streams/{name}-{uuid.uuid4().hex[:12]}"


def file_stream(spark: SparkSession, folder: str, name: str, like: DataFrame,
                max_files_per_trigger: int | None = 1) -> DataFrame:
    """Parquet file stream over the table ``name`` of ``folder``, one file or a folder of files; schema taken from
    ``like``. With ``max_files_per_trigger`` None a micro-batch takes all files that are there."""
    reader = spark.readStream.schema(like.schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # as a pattern the path may name a file as well as a folder
    return reader.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def _batch_writer(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def run_available(stream: DataFrame, root: str, output_mode: str = "append", writer=None) -> str:
    """Process everything available now, then stop. Returns the output folder."""
    out = f"{root}/out"
    w = stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{root}/_checkpoint")
    q = w.foreachBatch(writer or _batch_writer(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def stream_clean(spark: SparkSession, docs: DataFrame, lang: str, min_len: int = 15,
                 alphabet: str = X.ALPHABET_RU_LATIN, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Stateless per-chunk filter (language) + clean (P06) + min length."""
    s = docs.filter(F.col(lang_col) == lang).select(
        "doc_id", X.clean_letters_normalized(F.col(text_col), alphabet).alias("clean"))
    return s.filter(F.length("clean") >= min_len)


def language_window_counts(stream: DataFrame, ts_col: str, window: str = "30 days",
                           watermark: str = "90 days", lang_col: str = "language") -> DataFrame:
    """Per tumbling window and language, late rows (behind the watermark) dropped."""
    return (stream.withWatermark(ts_col, watermark)
                  .groupBy(F.window(ts_col, window).alias("w"), F.col(lang_col).alias("language"))
                  .agg(F.count(F.lit(1)).alias("n")))


def latest_per_key(out: DataFrame, keys: list[str]) -> DataFrame:
    """Final table from update-mode batches: the row of the last batch per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return out.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk", "batch_id")


def sketch_writer(out: str, spec: K.SketchSpec, tokens_col: str = "tokens"):
    """Each micro-batch adds its documents' sketch cells under its batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        cells = K.sketch_build(T.document_frequency(batch, tokens_col), spec)
        cells.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def merged_cells(spark: SparkSession, out: str, spec: K.SketchSpec) -> DataFrame:
    """K06 over all batch outputs: equals a one-shot build over the same documents."""
    cells = spark.read.parquet(out).drop("batch_id")
    return K.sketch_merge([cells], [spec])


def arrivals(df: DataFrame, arrival_col: str, n: int, folder: str) -> str:
    """Write the rows of arrival 0..n-1 as files that come one after the other; returns the path to stream from."""
    for k in range(n):
        df.where(F.col(arrival_col) == k).drop(arrival_col).coalesce(1).write.parquet(f"{folder}/arrival-{k}")
    return f"{folder}/arrival-*"


def run_arrivals(df: DataFrame, arrival_col: str, n: int, root: str, stream_of, writer) -> None:
    """The rows of arrival 0..n-1 written, each by all tasks, and processed one arrival to a micro-batch: a run over the
    same checkpoint takes the files that are new, all at once. ``stream_of`` makes the stream of the read rows."""
    spark = df.sparkSession
    for k in range(n):
        df.where(F.col(arrival_col) == k).drop(arrival_col).write.parquet(f"{root}/in/arrival-{k}")
        stream = spark.readStream.schema(df.drop(arrival_col).schema).parquet(f"{root}/in/arrival-*")
        run_available(stream_of(stream), root, writer=writer)


def window_counts(stream: DataFrame, ts_col: str, key_col: str, window: str, delay: str) -> DataFrame:
    """X02 in append mode: (window_start, window_end, key, n), each window once, when the watermark has passed it; its
    state is dropped then, and rows of it that come in a later micro-batch are too. The watermark of a micro-batch
    follows the event times of those before it."""
    w = F.window(ts_col, window)
    return (stream.withWatermark(ts_col, delay).groupBy(w.alias("w"), F.col(key_col).alias("key")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "n"))


def open_windows(spark: SparkSession, root: str) -> DataFrame:
    """(window_start, window_end, key, n) of the windows that a finished ``window_counts`` run still holds in its state."""
    state = spark.read.format("statestore").load(f"{root}/_checkpoint")
    window, key = (F.col("key")[c] for c in state.schema["key"].dataType.names)
    return state.select(window["start"].alias("window_start"), window["end"].alias("window_end"), key.alias("key"),
                        F.col("value")[state.schema["value"].dataType.names[0]].alias("n"))


def settled_windows(spark: SparkSession, root: str, out: str, n_input) -> DataFrame:
    """Closed and open windows of a run, with ``closed``, and one row (nulls, 'late', n) for the rows that came behind the
    watermark: the ``n_input`` rows read less those counted."""
    closed = spark.read.parquet(out).drop("batch_id").withColumn("closed", F.lit(True))
    counted = closed.unionByName(open_windows(spark, root).withColumn("closed", F.lit(False)))
    late = counted.agg((n_input - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).select(
        F.lit(None).cast("timestamp").alias("window_start"), F.lit(None).cast("timestamp").alias("window_end"),
        F.lit("late").alias("key"), "n", F.lit(None).cast("boolean").alias("closed"))
    return counted.unionByName(late)


def ledger_sketch_writer(store: str, spec: K.SketchSpec, tokens_col: str = "tokens"):
    """X03 with a batch ledger: one merged sketch, published (``corpus_store``) together with the ids of the batches in
    it. A batch that the published ledger lists is skipped, so a retried merge changes nothing, and a merge that dies
    before its publication was never made. The cells are width x depth rows, whatever the stream holds."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = corpus_store.latest(spark, store)
        cells = K.sketch_build(T.document_frequency(batch, tokens_col), spec)
        ledger = spark.createDataFrame([(batch_id,)], "batch_id long")
        if seen is not None:
            held = corpus_store.load(spark, store, seen.version)
            if held["ledger"].where(F.col("batch_id") == batch_id).count():
                return
            cells = K.sketch_merge([held["cells"], cells], [spec, spec])
            ledger = held["ledger"].unionByName(ledger)
        corpus_store.publish({"cells": cells, "ledger": ledger}, store)
    return write
