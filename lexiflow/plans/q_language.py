"""Queries: language statistics and the comment filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.operators import language as L
from lexiflow.plans.catalog import register
from lexiflow.sources.tables import comments


@register("language_distribution")
def q_language_distribution(spark, sf_dir):
    return L.language_distribution(comments(spark, sf_dir, with_time=False))


@register("language_summary")
def q_language_summary(spark, sf_dir):
    return L.language_summary(comments(spark, sf_dir, with_time=False))


@register("language_confidence")
def q_language_confidence(spark, sf_dir):
    return L.language_confidence(comments(spark, sf_dir, with_time=False))


@register("language_crosstab")
def q_language_crosstab(spark, sf_dir):
    return L.language_crosstab(comments(spark, sf_dir, with_time=False))


@register("filter_language")
def q_filter_language(spark, sf_dir):
    c = comments(spark, sf_dir)
    return L.filter_language(c, "en").select("doc_id", "published_at", "platform",
                                             F.length("comment").cast("bigint").alias("n_chars"))


@register("detect_language")
def q_detect_language(spark, sf_dir):
    """Profiles trained on labelled documents, applied to every conversation turn."""
    from lexiflow.sources.tables import table
    train = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    return L.detect_language(train, turns).select("doc_id.conv_id", "doc_id.turn", "language", "confidence")
