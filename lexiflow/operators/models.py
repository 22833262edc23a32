"""Topic models and their evaluation.

Model fitting uses Spark ML estimators (distributed KMeans, logistic
regression) and an online LDA equal to Spark's (``lda``). Everything around them (assignment rules, activity
tables, contingency statistics, coherence) is plain DataFrame SQL.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.hashing import hash32
from lexiflow.operators import lda
from lexiflow.session import stage

EPS = 1e-10


def assign_topics(vecs: DataFrame, k: int = 10, n_components: int = 16, min_size: int = 15,
                  outlier_pct: float = 0.95, seed: int = 42, id_col: str = "doc_id",
                  vec_col: str = "vector") -> DataFrame:
    """(doc_id, topic, probability); -1 = outlier.

    PCA then KMeans on the vector column. A row is an outlier when its
    distance to its centre is above the cluster's ``outlier_pct`` quantile or
    its cluster has fewer than ``min_size`` members.
    """
    x = vecs.select(F.col(id_col).alias("doc_id"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    pca = PCA(k=n_components, inputCol="v", outputCol="p").fit(x)
    y = pca.transform(x)
    km = KMeans(k=k, seed=seed, featuresCol="p", predictionCol="c").fit(y)
    y = km.transform(y)
    # k centres of n_components doubles: a model parameter, not data.
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in km.clusterCenters()])
    pa = vector_to_array("p")
    d = F.sqrt(F.aggregate(F.zip_with(pa, centers[F.col("c")], lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda s, v: s + v))
    y = y.withColumn("dist", d)
    stats = y.groupBy("c").agg(F.count(F.lit(1)).alias("size"),
                               F.percentile_approx("dist", outlier_pct).alias("cut"))
    y = y.join(stats, "c")
    out = F.when((F.col("size") < min_size) | (F.col("dist") > F.col("cut")), F.lit(-1)).otherwise(F.col("c"))
    return y.select("doc_id", out.cast("int").alias("topic"), F.exp(-F.col("dist")).alias("probability"))


def fit_lda(docs: DataFrame, k: int = 20, vocab_size: int = 10000, min_df: float = 5, max_df: float = 0.9,
            max_iter: int = 10, seed: int = 42, tokens_col: str = "tokens"):
    """(count-vectorizer model, LDA model, features frame). Every
    iteration reads every document, so tokens and features are staged: the
    passes read them instead of cleaning the texts again."""
    docs = stage(docs, "lda-docs")
    cv = count_model(docs, vocab_size, min_df, max_df, tokens_col)
    feats = stage(cv.transform(docs).drop(tokens_col), "lda-features")
    return cv, lda.fit(feats, len(cv.vocabulary), k, max_iter, seed), feats


def count_model(docs: DataFrame, vocab_size: int, min_df: float, max_df: float, tokens_col: str = "tokens") -> CountVectorizerModel:
    """A fitted ``CountVectorizer``. Bounds that are shares are given to it as numbers of documents, counted without
    reading the tokens; with shares it would hold all tokens in memory and read them once more to count the rows."""
    n = docs.count() if min(min_df, max_df) < 1 else 0
    lo, hi = (b if b >= 1 else b * n for b in (min_df, max_df))
    if not 1 <= lo <= hi:
        lo, hi = min_df, max_df
    return CountVectorizer(inputCol=tokens_col, outputCol="features", vocabSize=vocab_size, minDF=lo, maxDF=hi).fit(docs)


def lda_top_words(spark, cv, model, n_words: int = 10) -> DataFrame:
    """(topic, rank, term, weight) from the fitted LDA topics."""
    vocab = spark.createDataFrame(list(enumerate(cv.vocabulary)), "idx int, term string")
    t = model.describeTopics(n_words).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "z"))
    return (t.select(F.col("topic").cast("int").alias("topic"), F.col("rank").cast("bigint").alias("rank"),
                     F.col("z.termIndices").alias("idx"), F.col("z.termWeights").alias("weight"))
             .join(F.broadcast(vocab), "idx").drop("idx"))


def theta(model, feats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, topic, weight) document-topic weights of a fitted model."""
    return lda.infer(model, feats, id_col).select(id_col, F.posexplode("weights").alias("topic", "weight"))


def hashed_theta(docs: DataFrame, k: int, seed: str = "theta", id_col: str = "doc_id") -> DataFrame:
    """Deterministic document-topic weights for fixtures: k hashed scores per
    document normalised to sum 1, computed inside the row."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: (hash32(
        F.concat(F.col(id_col).cast("string"), F.lit(":"), t.cast("string")), seed) % 1000 + 1).cast("double"))
    x = docs.select(id_col, raw.alias("_r"))
    tot = F.aggregate("_r", F.lit(0.0), lambda s, v: s + v)
    return x.select(id_col, F.posexplode(F.transform("_r", lambda v: v / tot)).alias("topic", "weight"))


def topic_activity(th: DataFrame, doc_slices: DataFrame, slice_col: str, id_col: str = "doc_id") -> DataFrame:
    """Mean document-topic weight per (topic, slice)."""
    return (th.join(doc_slices.select(id_col, slice_col), id_col)
              .groupBy("topic", slice_col).agg(F.avg("weight").alias("activity")))


def cluster_quality(assign: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Purity and NMI of argmax topic against a label.

    The contingency table has one row per (topic, label): the statistics
    aggregate that table, never the documents.
    """
    j = assign.select(id_col, "topic").join(labels.select(id_col, "label"), id_col)
    ct = j.groupBy("topic", "label").agg(F.count(F.lit(1)).alias("n"))
    n = ct.select(F.sum("n")).scalar()
    nk = ct.groupBy("topic").agg(F.sum("n").alias("nk"))
    nj = ct.groupBy("label").agg(F.sum("n").alias("nj"))
    purity = ct.groupBy("topic").agg(F.max("n").alias("m")).agg((F.sum("m") / n).alias("v"))
    hk = nk.agg((-F.sum(F.col("nk") / n * F.log(F.col("nk") / n))).alias("v"))
    hj = nj.agg((-F.sum(F.col("nj") / n * F.log(F.col("nj") / n))).alias("v"))
    mi = (ct.join(nk, "topic").join(nj, "label")
            .agg(F.sum(F.col("n") / n * F.log(n * F.col("n") / (F.col("nk") * F.col("nj")))).alias("v")))
    h = (hk.select("v").scalar() + hj.select("v").scalar()) / 2
    nmi = mi.select(F.when(h > 0, F.col("v") / h).otherwise(F.lit(0.0)).alias("v"))
    return (purity.select(F.lit("purity").alias("metric"), F.col("v").alias("value"))
            .unionByName(nmi.select(F.lit("nmi").alias("metric"), F.col("v").alias("value"))))


def topic_classification(th: DataFrame, labels: DataFrame, k: int, test_frac: float = 0.3, seed: int = 42,
                         id_col: str = "doc_id") -> DataFrame:
    """Classify labels from topic weights; (metric, value) for accuracy and macro F1."""
    w = th.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("topic", "weight"))).alias("_w"))
    x = (w.select(id_col, array_to_vector(F.col("_w.weight")).alias("features"))
          .join(labels.select(id_col, F.col("label").cast("double").alias("label")), id_col))
    is_test = (hash32(F.col(id_col).cast("string"), seed) % 1000) < int(test_frac * 1000)
    train, test = x.filter(~is_test), x.filter(is_test)
    model = LogisticRegression(maxIter=50).fit(train)
    pred = model.transform(test)
    return classification_scores(pred)


def classification_scores(pred: DataFrame) -> DataFrame:
    """(metric, value): accuracy and macro F1 of (label, prediction), from the
    confusion counts. Macro F1 is the plain mean over all labels seen on either
    side; a label that is never hit counts 0. No rows: both null."""
    cells = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.col("n"), F.lit(0).alias("side")),
        F.struct(F.col("prediction").alias("c"), F.col("n"), F.lit(1).alias("side")))).alias("s")).select("s.*")
    hits = cells.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("c"), F.col("n").alias("tp"))
    f1 = (sides.groupBy("c").agg(F.sum("n").alias("both")).join(hits, "c", "left")
          .agg(F.avg(2 * F.coalesce("tp", F.lit(0)) / F.col("both")).alias("value")))
    acc = cells.agg((F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("value"))
    return (acc.select(F.lit("accuracy").alias("metric"), "value")
            .unionByName(f1.select(F.lit("macro_f1").alias("metric"), "value")))


def joint_coherence(top_words: DataFrame, corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per topic, ln((P(all words together) + e) / (prod f_i + e)) with
    f_i = token count / N; topics with < 2 in-vocabulary words are skipped,
    0 when the words never occur together. Returns (topic, coherence)."""
    n = corpus.select(F.count(F.lit(1))).scalar()
    w = top_words.select("topic", F.col("term").alias("w")).join(vocab.select("w"), "w", "left_semi").distinct()
    nw = w.groupBy("topic").agg(F.count(F.lit(1)).alias("n_w")).filter(F.col("n_w") >= 2)
    w = w.join(nw, "topic")
    toks = corpus.select("doc_id", F.explode("tokens").alias("w")).join(w.select("w").distinct(), "w", "left_semi")
    f = toks.groupBy("w").agg((F.count(F.lit(1)) / n).alias("f"))
    inc = toks.distinct()
    together = (w.join(inc, "w").groupBy("topic", "doc_id", "n_w").agg(F.count(F.lit(1)).alias("c"))
                 .filter(F.col("c") == F.col("n_w")).groupBy("topic").agg(F.count(F.lit(1)).alias("together")))
    prod = w.join(f, "w", "left").groupBy("topic").agg(
        F.exp(F.sum(F.log(F.coalesce(F.col("f"), F.lit(0.0))))).alias("prod"),
        F.min(F.coalesce(F.col("f"), F.lit(0.0))).alias("fmin"))
    x = nw.join(together, "topic", "left").join(prod, "topic")
    score = F.when(F.coalesce(F.col("together"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.log((F.col("together") / n + EPS) / (F.when(F.col("fmin") > 0, F.col("prod")).otherwise(0.0) + EPS)))
    return x.select("topic", score.alias("coherence"))


def topic_diversity(top_words: DataFrame) -> DataFrame:
    """Distinct words / all words over the top words of all topics."""
    return top_words.agg(F.coalesce(F.count_distinct("term") / F.nullif(F.count("term"), F.lit(0)),
                                    F.lit(0.0)).alias("diversity"))


def save_model(model, path: str) -> str:
    """Persist a fitted model with the ML writer (shared storage path)."""
    model.write().overwrite().save(path)
    return path
