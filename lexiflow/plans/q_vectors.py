"""Queries: sketches, sketch IDF, hashed embeddings, vector search (K, E, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.operators import embed as E
from lexiflow.operators import sketch as K
from lexiflow.operators import tokens as T
from lexiflow.operators import vectors as N
from lexiflow.plans.catalog import register
from lexiflow.session import cut_lineage, stage
from lexiflow.sources.tables import table, vectors

CMS = K.cms_spec(0.01, 0.01)
CS = K.cs_spec(0.01, 0.01)
DIM = 300
QUERY_IDS = [0, 5]
TOP_K = 5


def text_docs(spark, sf_dir):
    """(doc_id, lang, tokens): lower-cased word tokens of each whole document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return d.select("doc_id", "lang", X.tokenize_words("text").alias("tokens"))


def _df(spark, sf_dir):
    return stage(T.document_frequency(text_docs(spark, sf_dir)), "document-frequency")     # built from and queried


def _cells(df):
    return df.withColumn("row", F.col("row").cast("bigint"))


@register("cms_build")
def q_cms_build(spark, sf_dir):
    return _cells(K.sketch_build(_df(spark, sf_dir), CMS))


@register("cs_build")
def q_cs_build(spark, sf_dir):
    return _cells(K.sketch_build(_df(spark, sf_dir), CS))


@register("cms_query")
def q_cms_query(spark, sf_dir):
    df = _df(spark, sf_dir)
    return K.sketch_query(df, K.sketch_build(df, CMS), CMS)


@register("cs_query")
def q_cs_query(spark, sf_dir):
    df = _df(spark, sf_dir)
    return K.sketch_query(df, K.sketch_build(df, CS), CS)


@register("sketch_merge")
def q_sketch_merge(spark, sf_dir):
    """Sketches of English and of other documents, merged cell-wise."""
    d = text_docs(spark, sf_dir)
    parts = [K.sketch_build(T.document_frequency(d.filter(c)), CMS)
             for c in (F.col("lang") == "en", F.col("lang") != "en")]
    return _cells(K.sketch_merge(parts, [CMS, CMS]))


@register("sidf_weight")
def q_sidf_weight(spark, sf_dir):
    df = _df(spark, sf_dir)
    n = table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    p_cms = K.sketch_query(df, K.sketch_build(df, CMS), CMS).withColumnRenamed("estimate", "p_cms")
    p_cs = K.sketch_query(df, K.sketch_build(df, CS), CS).withColumnRenamed("estimate", "p_cs")
    x = p_cms.join(p_cs, "term")
    return x.select("term",
                    F.round(K.sidf_weight(F.col("p_cms"), n, "bm25"), 6).alias("bm25_cms"),
                    F.round(K.sidf_weight(F.col("p_cs"), n, "bm25"), 6).alias("bm25_cs"),
                    F.round(K.sidf_weight(F.col("p_cms"), n, "tfidf"), 6).alias("tfidf_cms"))


def _emb(spark, sf_dir, model):
    return E.embed_dual(text_docs(spark, sf_dir), CMS, CS, model=model, dim=DIM)


@register("embed_tfidf")
def q_embed_tfidf(spark, sf_dir):
    return _emb(spark, sf_dir, "tfidf").select("doc_id", "bucket", F.round("w_cms", 6).alias("weight"))


@register("embed_bm25")
def q_embed_bm25(spark, sf_dir):
    return _emb(spark, sf_dir, "bm25").select("doc_id", "bucket", F.round("w_cms", 6).alias("weight"))


@register("embed_dual")
def q_embed_dual(spark, sf_dir):
    e = _emb(spark, sf_dir, "bm25")
    return e.select("doc_id", "bucket", F.round("w_cms", 6).alias("w_cms"), F.round("w_cs", 6).alias("w_cs"))


@register("embedding_pipeline")
def q_embedding_pipeline(spark, sf_dir):
    """Dense CMS vectors for every document (zeros for empty ones): size and norm."""
    docs = text_docs(spark, sf_dir)
    dense = E.with_empty_docs(E.to_dense(_emb(spark, sf_dir, "bm25"), "w_cms", DIM), docs, DIM)
    return dense.select("doc_id", F.size("vector").cast("bigint").alias("dim"),
                        F.round(N.l2_norm(F.col("vector")), 6).alias("norm"))


@register("normalize_vectors")
def q_normalize_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", N.normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("idx", "value")).select(
        "vec_id", F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value"))


@register("knn_l2")
def q_knn_l2(spark, sf_dir):
    return N.knn(vectors(spark, sf_dir), QUERY_IDS, TOP_K, metric="l2").withColumn("dist", F.round("dist", 6))


@register("knn_cosine")
def q_knn_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", N.normalize(F.col("embedding")).alias("embedding"))
    return N.knn(v, QUERY_IDS, TOP_K, metric="ip").withColumn("dist", F.round("dist", 6))


@register("farthest_k")
def q_farthest_k(spark, sf_dir):
    return (N.knn(vectors(spark, sf_dir), QUERY_IDS, TOP_K, metric="l2", farthest=True)
            .withColumn("dist", F.round("dist", 6)))


@register("knn_l2_blocks")
def q_knn_l2_blocks(spark, sf_dir):
    return N.knn_blocks(vectors(spark, sf_dir), QUERY_IDS, TOP_K, metric="l2").withColumn("dist", F.round("dist", 6))


@register("knn_cosine_blocks")
def q_knn_cosine_blocks(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", N.normalize(F.col("embedding")).alias("embedding"))
    return N.knn_blocks(v, QUERY_IDS, TOP_K, metric="ip").withColumn("dist", F.round("dist", 6))


@register("distance_correlation")
def q_distance_correlation(spark, sf_dir):
    """Correlation of pair distances between the CMS- and CS-weighted document
    vectors, on 1000 hash-sampled document pairs, for L2 and cosine."""
    docs = text_docs(spark, sf_dir)
    pairs = cut_lineage(N.sample_pairs(docs.select("doc_id"), 1000, 42))   # 1000 rows, read by two metrics
    drawn = F.broadcast(pairs.select(F.explode(F.array("i", "j")).alias("doc_id")).distinct())   # at most 2000 ids
    # Every document is embedded; only those drawn are made dense, once for four vector builds.
    e = stage(_emb(spark, sf_dir, "bm25").join(drawn, "doc_id", "left_semi"), "embedded")
    docs = docs.select("doc_id").join(drawn, "doc_id", "left_semi")
    v1 = stage(E.with_empty_docs(E.to_dense(e, "w_cms", DIM), docs, DIM), "cms-vectors")
    v2 = stage(E.with_empty_docs(E.to_dense(e, "w_cs", DIM), docs, DIM), "cs-vectors")
    l2 = N.distance_correlation(v1, v2, pairs, "l2").select(F.lit("l2").alias("metric"), "corr")
    n1 = v1.withColumn("vector", N.normalize(F.col("vector")))
    n2 = v2.withColumn("vector", N.normalize(F.col("vector")))
    cos = N.distance_correlation(n1, n2, pairs, "cosine").select(F.lit("cosine").alias("metric"), "corr")
    return l2.unionByName(cos).withColumn("corr", F.round("corr", 6))


@register("builtin_cms_estimate")
def q_builtin_cms_estimate(spark, sf_dir):
    t = text_docs(spark, sf_dir).select(F.explode(F.array_distinct("tokens")).alias("term"))
    return K.builtin_cms(t, "term")
