"""Queries: sources and sinks, each as a write-then-read round trip through
the shared checkpoint folder (S01-S05, S07-S12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.operators import embed as E
from lexiflow.operators import sketch as K
from lexiflow.operators import tokens as T
from lexiflow.operators import vectors as N
from lexiflow.plans.catalog import register
from lexiflow.plans.q_vectors import CMS, CS, DIM, text_docs
from lexiflow.session import ensure_checkpoint_dir, stage
from lexiflow.sources import files as S
from lexiflow.sources.tables import comments, table


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiflow-io/{name}-{uuid.uuid4().hex[:12]}"


def _comments_csv(spark, sf_dir):
    p = _scratch(spark, "comments_csv")
    c = comments(spark, sf_dir).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
    S.sink_csv(c.select([f.name for f in S.COMMENT_SCHEMA.fields]), p)
    return p


@register("scan_comments")
def q_scan_comments(spark, sf_dir):
    """S07 then S01: comments written as CSV (multi-line texts quoted) and read back."""
    return S.scan_comments(spark, _comments_csv(spark, sf_dir)).select(
        "doc_id", "comment", F.to_timestamp("published_at").alias("published_at"), "language", "platform")


@register("scan_comments_lenient")
def q_scan_comments_lenient(spark, sf_dir):
    """The same file read line by line; rows broken by embedded newlines are kept as corrupt."""
    d = S.scan_comments_lenient(spark, _comments_csv(spark, sf_dir))
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count("doc_id").alias("n_with_id"),
                 F.count_if(F.col("_corrupt").isNotNull()).alias("n_corrupt"))


@register("scan_comments_recovered")
def q_scan_comments_recovered(spark, sf_dir):
    """The comments as CSV records over several lines, some one-line comments preceded by a record whose
    quote is never closed; all records read back, the malformed ones with their text."""
    p = _scratch(spark, "comments_damaged")
    c = comments(spark, sf_dir).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
    good = F.to_csv(F.struct(*[f.name for f in S.COMMENT_SCHEMA.fields]), {"escape": '"'})
    damaged = F.when((F.col("doc_id") % 7 == 0) & ~F.col("comment").contains("\n"),
                     F.concat(F.col("doc_id").cast("string"), F.lit(',"never closed '), F.col("language")))
    c.select(F.explode(F.array_compact(F.array(damaged, good))).alias("value")).write.text(p)
    r = S.scan_comments_recovered(spark, p)
    return r.select("doc_id", "comment", F.to_timestamp("published_at").alias("published_at"), "language", "platform", "malformed")


@register("scan_text_lines")
def q_scan_text_lines(spark, sf_dir):
    """Document texts written as text files and read back line by line."""
    p = _scratch(spark, "text_lines")
    table(spark, sf_dir, "documents").select("text").write.mode("overwrite").text(p)
    return S.scan_text_lines(spark, p).agg(F.count(F.lit(1)).alias("n_lines"),
                                           F.sum(F.length("line")).cast("bigint").alias("n_chars"))


@register("scan_text_documents")
def q_scan_text_documents(spark, sf_dir):
    """One .txt file per document (folder per doc_id), read as whole files."""
    p = _scratch(spark, "text_docs")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Tasks move their own files to the folder; with the default the driver moves them one by one.
    d.write.mode("overwrite").partitionBy("doc_id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(p)
    r = S.scan_text_documents(spark, p)
    return r.select(F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("bigint").alias("doc_id"),
                    F.col("size").cast("bigint").alias("size"),
                    F.length(F.regexp_replace("text", "\n$", "")).cast("bigint").alias("n_chars"))


@register("scan_jsonlines")
def q_scan_jsonlines(spark, sf_dir):
    """S05 after S08: labelled texts as JSON lines; unlabelled ones have no label field."""
    p = _scratch(spark, "jsonl")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    S.sink_json(d.join(lab, "doc_id", "left").select("label", "text"), p)
    return S.scan_jsonlines(spark, p).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("sink_csv")
def q_sink_csv(spark, sf_dir):
    """Token lists as CSV (arrays joined by comma), read back."""
    p = _scratch(spark, "tokens_csv")
    d = comments(spark, sf_dir, with_time=False).select("doc_id", "platform", F.slice(X.tokenize_words("comment"), 1, 20).alias("words"))
    S.sink_csv(d, p)
    return spark.read.schema("doc_id long, platform string, words string").option("header", True).option("escape", '"').csv(p)


@register("sink_json")
def q_sink_json(spark, sf_dir):
    """The same rows as JSON lines with the arrays kept, read back."""
    p = _scratch(spark, "tokens_json")
    d = comments(spark, sf_dir, with_time=False).select("doc_id", "platform", F.slice(X.tokenize_words("comment"), 1, 20).alias("words"))
    S.sink_json(d, p)
    r = spark.read.schema("doc_id long, platform string, words array<string>").json(p)
    return r.select("doc_id", "platform", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", "|").alias("words"))


@register("sink_parquet_batches")
def q_sink_parquet_batches(spark, sf_dir):
    """Pair rows written one folder per batch and read back per batch."""
    from lexiflow.operators import pairs as W
    from lexiflow.plans.q_pairs import manifest_files
    p = _scratch(spark, "batches")
    files = manifest_files(spark, sf_dir)
    pairs = W.skipgram_pairs(files, 1).join(W.file_batches(files.select("doc_id"), 100), "doc_id")
    S.sink_parquet_batches(pairs, p)
    return spark.read.parquet(p).groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_pairs"))


@register("persist_sketch")
def q_persist_sketch(spark, sf_dir):
    """Sketch cells + metadata saved, loaded, and queried."""
    docs = text_docs(spark, sf_dir)
    df = T.document_frequency(docs)
    p = _scratch(spark, "sketch")
    S.persist_sketch(spark, K.sketch_build(df, CMS), CMS, docs.count(), p)
    cells, spec, _ = S.load_sketch(spark, p)
    return K.sketch_query(df, cells, spec)


@register("persist_embeddings")
def q_persist_embeddings(spark, sf_dir):
    """Both embedding matrices with document names, built once, then loaded."""
    p = _scratch(spark, "emb")

    def build():
        docs = text_docs(spark, sf_dir)
        e = stage(E.embed_dual(docs, CMS, CS, model="bm25", dim=DIM), "embedded")     # read for both matrices
        cms, cs = (E.with_empty_docs(E.to_dense(e, w, DIM), docs, DIM).select("doc_id", F.col("vector").alias(w))
                   for w in ("w_cms", "w_cs"))
        return cms.join(cs, "doc_id").withColumn("name", F.concat(F.lit("document "), F.col("doc_id")))

    S.load_or_build(spark, p, build)
    m = S.load_or_build(spark, p, build)
    return m.select("doc_id", "name", F.round(N.l2_norm(F.col("w_cms")), 6).alias("norm_cms"),
                    F.round(N.l2_norm(F.col("w_cs")), 6).alias("norm_cs"))
