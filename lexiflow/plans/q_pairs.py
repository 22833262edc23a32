"""Queries: skip-gram pair builder (S06, W01-W07) over the manifest files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.operators import pairs as W
from lexiflow.plans.catalog import register
from lexiflow.sources.tables import table

# Seeds of the negative-sample permutations and of the hashes.
NEG_SEEDS = [101, 102, 103, 104, 105]
HASH_SEEDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def manifest_files(spark, sf_dir):
    """Files (documents) listed in the manifest: those labelled quality = 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return W.manifest_filter(docs, manifest)


@register("manifest_filter")
def q_manifest_filter(spark, sf_dir):
    return manifest_files(spark, sf_dir).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@register("file_batches")
def q_file_batches(spark, sf_dir):
    return W.file_batches(manifest_files(spark, sf_dir).select("doc_id"), 100)


@register("skipgram_pairs")
def q_skipgram_pairs(spark, sf_dir):
    return W.skipgram_pairs(manifest_files(spark, sf_dir), 1)


@register("skipgram_window_n")
def q_skipgram_window_n(spark, sf_dir):
    return W.skipgram_pairs(manifest_files(spark, sf_dir), 2)


@register("negative_samples")
def q_negative_samples(spark, sf_dir):
    return W.negative_samples(manifest_files(spark, sf_dir), NEG_SEEDS)


@register("label_pairs")
def q_label_pairs(spark, sf_dir):
    return W.label_pairs(W.negative_samples(manifest_files(spark, sf_dir), NEG_SEEDS), len(NEG_SEEDS))


@register("hash_features")
def q_hash_features(spark, sf_dir):
    lp = W.label_pairs(W.negative_samples(manifest_files(spark, sf_dir), NEG_SEEDS), len(NEG_SEEDS))
    return W.hash_features(lp, HASH_SEEDS).drop("center_word", "context_word")


@register("pmi_pairs")
def q_pmi_pairs(spark, sf_dir):
    return W.pmi_pairs(W.skipgram_pairs(manifest_files(spark, sf_dir), 1)).withColumn("pmi", F.round("pmi", 6))


@register("negative_samples_batch")
def q_negative_samples_batch(spark, sf_dir):
    return W.negative_samples_batch(manifest_files(spark, sf_dir), NEG_SEEDS, 100)
