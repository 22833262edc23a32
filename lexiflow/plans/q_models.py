"""Queries: topic models and model-based evaluation."""

from __future__ import annotations

import uuid

from pyspark.ml.clustering import LocalLDAModel
from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.operators import bundle as B
from lexiflow.operators import cleaning as C
from lexiflow.operators import corpus as V
from lexiflow.operators import models as ML
from lexiflow.operators import topics as M
from lexiflow.plans.catalog import register
from lexiflow.plans.q_text import prepared_corpus
from lexiflow.plans.q_topics import N_WORDS, topic_docs, topic_docs_once
from lexiflow.session import ensure_checkpoint_dir, stage
from lexiflow.sources.tables import documents_with_topics, table, vectors

K_TOPICS = 10
K_LDA = 20


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


@register("assign_topics")
def q_assign_topics(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return ML.assign_topics(v, k=K_TOPICS, n_components=16, min_size=15)


def _lda(spark, sf_dir, docs=None):
    docs = docs if docs is not None else topic_docs(spark, sf_dir)
    return ML.fit_lda(docs.select("doc_id", "tokens"), k=K_LDA, vocab_size=10000, min_df=5, max_df=0.9)


@register("fit_topics")
def q_fit_topics(spark, sf_dir):
    cv, lda, _ = _lda(spark, sf_dir)
    return ML.lda_top_words(spark, cv, lda, N_WORDS)


@register("infer_topics")
def q_infer_topics(spark, sf_dir):
    docs = topic_docs_once(spark, sf_dir).withColumn("slice", F.date_format("published_at", "yyyy-MM"))
    split = C.stratified_split(docs.select("doc_id", "slice"), "slice", "doc_id", 0.1, 42)
    d = docs.join(split.select("doc_id", "split"), "doc_id")
    cv, lda, _ = _lda(spark, sf_dir, d.filter(F.col("split") == "train"))
    test = cv.transform(d.filter(F.col("split") == "test").select("doc_id", "tokens"))
    return ML.theta(lda, test)


@register("save_topic_model")
def q_save_topic_model(spark, sf_dir):
    _, lda, _ = _lda(spark, sf_dir)
    path = ML.save_model(lda, f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiflow-models/lda-{uuid.uuid4().hex}")
    # The reloaded model's topics, so that what was written is what is read.
    return LocalLDAModel.load(path).describeTopics(N_WORDS).select(
        F.col("topic").cast("int").alias("topic"), F.size("termIndices").alias("n_words"),
        F.round(F.aggregate("termWeights", F.lit(0.0), lambda a, w: a + w), 6).alias("weight"))


@register("topic_activity")
def q_topic_activity(spark, sf_dir):
    docs = topic_docs_once(spark, sf_dir)
    th = ML.hashed_theta(docs.select("doc_id"), K_TOPICS)
    return ML.topic_activity(th, docs, "quarter").withColumn("activity", F.round("activity", 6)) \
             .withColumn("topic", F.col("topic").cast("bigint"))


@register("cluster_quality")
def q_cluster_quality(spark, sf_dir):
    a = documents_with_topics(spark, sf_dir).select("doc_id", "topic")
    return ML.cluster_quality(a, _labels(spark, sf_dir)).withColumn("value", F.round("value", 6))


@register("topic_classification")
def q_topic_classification(spark, sf_dir):
    docs = documents_with_topics(spark, sf_dir).select("doc_id")
    return ML.topic_classification(ML.hashed_theta(docs, K_TOPICS), _labels(spark, sf_dir), K_TOPICS)


def _static_topics(spark, sf_dir):
    docs = topic_docs_once(spark, sf_dir)
    return docs, M.topic_words(docs, N_WORDS)


@register("joint_coherence")
def q_joint_coherence(spark, sf_dir):
    docs, tw = _static_topics(spark, sf_dir)
    corpus = docs.select("doc_id", X.tokenize_whitespace("processed").alias("tokens"))
    vocab = V.build_vocabulary(docs.select("doc_id", "tokens"), max_features=5000).select(F.col("term").alias("w"))
    return ML.joint_coherence(tw, corpus, vocab).withColumn("coherence", F.round("coherence", 6))


@register("topic_diversity")
def q_topic_diversity(spark, sf_dir):
    _, tw = _static_topics(spark, sf_dir)
    return ML.topic_diversity(tw).withColumn("diversity", F.round("diversity", 6))


def _iforest(spark, sf_dir):
    from lexiflow.operators.outliers import isolation_forest
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return v, isolation_forest(v, n_trees=100, psi=256, contamination=0.05)


@register("isolation_forest")
def q_isolation_forest(spark, sf_dir):
    _, lab = _iforest(spark, sf_dir)
    return lab.withColumn("score", F.round("score", 6))


@register("filter_outliers")
def q_filter_outliers(spark, sf_dir):
    from lexiflow.operators.outliers import filter_outliers
    v, lab = _iforest(spark, sf_dir)
    return filter_outliers(v, lab).select("doc_id")


def _fitted_bundle(spark, sf_dir):
    """(bundle fitted on the train split of the prepared corpus, its documents with tokens)."""
    state, t = prepared_corpus(spark, sf_dir)
    docs = stage(t["docs"].select("doc_id", "slice", "split", X.tokenize_vectorizer("processed").alias("tokens")), "bundle-docs")
    cv, lda, _ = ML.fit_lda(docs.where(F.col("split") == "train").select("doc_id", "tokens"), k=K_LDA, vocab_size=10000, min_df=5, max_df=0.9)
    return B.TopicBundle(cv, lda, state.time_map.select("slice", "t")), docs


@register("topic_bundle")
def q_topic_bundle(spark, sf_dir):
    """The fitted bundle saved, reloaded, and used on the test split: per document the number and sum of its
    weights, and whether they equal those of the model in memory."""
    bundle, docs = _fitted_bundle(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiflow-models/bundle-{uuid.uuid4().hex}"
    B.save(bundle, root)
    test = docs.where(F.col("split") == "test")
    here = bundle.infer(test).withColumnRenamed("weight", "own")
    both = B.load(spark, root).infer(test).join(here.drop("t"), ["doc_id", "topic"])
    same = F.bool_and(F.abs(F.col("weight") - F.col("own")) < 1e-9)
    return both.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n_topics"), F.round(F.sum("weight"), 6).alias("total"), same.alias("same"))


@register("topic_activity_fitted")
def q_topic_activity_fitted(spark, sf_dir):
    """M06 on fitted weights: mean weight per (topic, slice) of the train split."""
    bundle, docs = _fitted_bundle(spark, sf_dir)
    train = docs.where(F.col("split") == "train")
    return ML.topic_activity(bundle.infer(train).drop("t"), train, "slice")


@register("topic_classification_fitted")
def q_topic_classification_fitted(spark, sf_dir):
    """M11 on fitted weights: accuracy and macro F1 of the labels predicted from the documents' topic weights."""
    bundle, docs = _fitted_bundle(spark, sf_dir)
    return ML.topic_classification(stage(bundle.infer(docs).drop("t"), "theta"), _labels(spark, sf_dir), K_LDA)
