"""Queries: topic tables (M03-M09, M13) and dynamic-topic metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.operators import cleaning as C
from lexiflow.operators import corpus as V
from lexiflow.operators import dtm as D
from lexiflow.operators import slices as Z
from lexiflow.operators import topics as M
from lexiflow.plans.catalog import register
from lexiflow.session import cut_lineage, stage
from lexiflow.sources.tables import documents_with_topics

ALPHA = X.ALPHABET_ANY
N_WORDS = 10
TOP_TOPICS = 30


def topic_docs(spark, sf_dir, with_time=True):
    """Documents with topic labels, cleaned (letters only), length >= 15,
    vectorizer tokens for class TF-IDF and quarter/month slice starts."""
    d = documents_with_topics(spark, sf_dir, with_time)
    d = C.with_once(d, "processed", X.clean_letters("comment", ALPHA))
    d = C.with_once(C.filter_min_length(d, "processed", 15), "tokens", X.tokenize_vectorizer("processed"))
    if not with_time:
        return d
    return (d.withColumn("quarter", Z.slice_start(F.col("published_at"), "quarter"))
             .withColumn("month", Z.slice_start(F.col("published_at"), "month")))


def topic_docs_once(spark, sf_dir):
    """``topic_docs`` without the raw comments, staged: the metric queries read it in many branches."""
    return stage(topic_docs(spark, sf_dir).drop("comment"), "topic-docs")


def over_time(spark, sf_dir, slice_col="quarter", **kw):
    return M.topics_over_time(topic_docs(spark, sf_dir), slice_col, N_WORDS, **kw)


def _r(df: DataFrame, *cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _joined(df: DataFrame, col="words", sep=", ") -> DataFrame:
    return df.withColumn(col, F.array_join(col, sep))


@register("topic_words")
def q_topic_words(spark, sf_dir):
    w = M.topic_words(topic_docs(spark, sf_dir, False), N_WORDS)
    return _r(w.select("topic", F.col("rank").cast("bigint").alias("rank"), "term", "weight"), "weight")


@register("topic_info")
def q_topic_info(spark, sf_dir):
    docs = topic_docs(spark, sf_dir, False)
    return M.topic_info(docs, M.topic_words(docs, N_WORDS), 5)


@register("topic_similarity")
def q_topic_similarity(spark, sf_dir):
    return _r(M.topic_similarity(topic_docs(spark, sf_dir, False), 20), "similarity")


@register("topics_over_time")
def q_topics_over_time(spark, sf_dir):
    return _joined(over_time(spark, sf_dir))


@register("topics_over_time_tuned")
def q_topics_over_time_tuned(spark, sf_dir):
    return _joined(over_time(spark, sf_dir, global_tuning=True, evolution_tuning=True))


@register("topic_distribution")
def q_topic_distribution(spark, sf_dir):
    return M.topic_distribution(topic_docs(spark, sf_dir, False), 20)


@register("topics_per_platform")
def q_topics_per_platform(spark, sf_dir):
    return M.topics_per_platform(topic_docs(spark, sf_dir, False))


@register("topic_report")
def q_topic_report(spark, sf_dir):
    docs = topic_docs_once(spark, sf_dir)
    return M.topic_report(docs, M.topic_words(docs, N_WORDS))


def over_time_by_platform(spark, sf_dir):
    docs = topic_docs_once(spark, sf_dir)
    parts = [M.topics_over_time(docs.filter(F.col("platform") == p), "quarter", N_WORDS)
             .withColumn("platform", F.lit(p)) for p in ("YouTube", "Telegram")]
    return parts[0].unionByName(parts[1])


@register("over_time_summary")
def q_over_time_summary(spark, sf_dir):
    return M.over_time_summary(over_time_by_platform(spark, sf_dir))


# ------------------------------------------------------------ DTM inputs

def dtm_inputs(spark, sf_dir, variant: str, docs=None, ot=None):
    """(grid, corpus, vocab) for one preset, built from the fixture tables."""
    docs = docs if docs is not None else topic_docs_once(spark, sf_dir)
    if variant == "B":
        ot = ot if ot is not None else M.topics_over_time(docs, "month", N_WORDS)
        topics = D.select_topics_by_docs(docs, None)
    else:
        ot = ot if ot is not None else M.topics_over_time(docs, "quarter", N_WORDS)
        topics = (D.select_topics_by_frequency(ot, TOP_TOPICS) if variant == "D"
                  else D.select_topics_by_docs(docs, TOP_TOPICS))
    # Over-time rows (topics x slices) and the selected topics are small and
    # read by every metric branch: cut their lineage once.
    ot = cut_lineage(ot)
    topics = cut_lineage(topics.select("topic"))
    grid = D.topic_word_grid(ot, topics, N_WORDS,
                             strip_prefix="clustering " if variant == "A" else None)
    if variant == "D":
        corpus = D.topic_word_corpus(grid)
        vocab = grid.select(F.explode("words").alias("w")).distinct()
        return grid, corpus, vocab
    sel = docs if variant == "B" else docs.join(topics.select("topic"), "topic", "left_semi")
    corpus = sel.select("doc_id", X.tokenize_whitespace("processed").alias("tokens"))
    vt = sel.select("doc_id", "tokens")
    if variant == "A":
        vocab = V.build_vocabulary(vt, min_df=2, max_df=0.9, max_features=5000)
    elif variant == "B":
        vocab = V.build_vocabulary(vt, min_df=5, max_df=0.9, max_features=10000)
    else:
        vocab = V.build_vocabulary(vt, max_features=5000)
    # At most max_features rows.
    return grid, corpus, cut_lineage(vocab.select(F.col("term").alias("w")))


def dtm(spark, sf_dir, variant):
    grid, corpus, vocab = dtm_inputs(spark, sf_dir, variant)
    return D.dtm_metrics(grid, corpus, vocab, variant)


def _reg_dtm(variant):
    v = variant.lower()
    register(f"dtm_overall_{v}")(lambda s, d: _r(dtm(s, d, variant)["overall"], "value"))
    register(f"dtm_topic_time_{v}")(lambda s, d: _r(dtm(s, d, variant)["topic_time"], "ttc", "tts"))
    register(f"dtm_topic_{v}")(lambda s, d: _r(dtm(s, d, variant)["topic"], "ttq"))
    register(f"dtm_time_{v}")(lambda s, d: _r(dtm(s, d, variant)["time"], "tc", "td", "tq"))


for _v in "ABCD":
    _reg_dtm(_v)


@register("select_topics_by_docs")
def q_select_topics_by_docs(spark, sf_dir):
    return D.select_topics_by_docs(topic_docs(spark, sf_dir), TOP_TOPICS)


@register("select_topics_by_frequency")
def q_select_topics_by_frequency(spark, sf_dir):
    return D.select_topics_by_frequency(over_time(spark, sf_dir), TOP_TOPICS)


@register("topic_word_grid")
def q_topic_word_grid(spark, sf_dir):
    grid, _, _ = dtm_inputs(spark, sf_dir, "C")
    return _joined(grid)


@register("reference_corpus")
def q_reference_corpus(spark, sf_dir):
    _, _, vocab = dtm_inputs(spark, sf_dir, "A")
    return vocab


@register("topic_word_corpus")
def q_topic_word_corpus(spark, sf_dir):
    _, corpus, _ = dtm_inputs(spark, sf_dir, "D")
    return corpus.select("doc_id", F.array_join("tokens", " ").alias("text"))


def _pairs_and_counts(spark, sf_dir, variant):
    grid, corpus, vocab = dtm_inputs(spark, sf_dir, variant)
    v = D.VARIANTS[variant]
    needed = grid.select(F.explode("words").alias("w")).distinct().join(vocab, "w", "left_semi")
    pairs = (D.ttc_pair_rows(grid, v).select("wi", "wj").unionByName(D.tc_pair_rows(grid).select("wi", "wj"))
             .join(needed.select(F.col("w").alias("wi")), "wi", "left_semi")
             .join(needed.select(F.col("w").alias("wj")), "wj", "left_semi"))
    co = D.pair_cooccurrence(pairs, corpus)
    return co, corpus.select(F.count(F.lit(1))).scalar(), v


@register("pair_cooccurrence")
def q_pair_cooccurrence(spark, sf_dir):
    co, _, _ = _pairs_and_counts(spark, sf_dir, "A")
    return co.select("wi", "wj", "c_i", "c_j", "c_ij")


@register("coherence_pmi")
def q_coherence_pmi(spark, sf_dir):
    co, n, v = _pairs_and_counts(spark, sf_dir, "A")
    return _r(D.pair_scores(co, n, v), "score")


@register("coherence_npmi")
def q_coherence_npmi(spark, sf_dir):
    co, n, v = _pairs_and_counts(spark, sf_dir, "B")
    return _r(D.pair_scores(co, n, v), "score")


@register("temporal_evolution")
def q_temporal_evolution(spark, sf_dir):
    return _r(D.temporal_evolution(dtm(spark, sf_dir, "A")["topic_time"]), "mean_ttc", "mean_tts")


@register("quality_bands")
def q_quality_bands(spark, sf_dir):
    return _r(D.quality_bands(dtm(spark, sf_dir, "A")["overall"]), "value")


@register("rank_topics_and_slices")
def q_rank_topics_and_slices(spark, sf_dir):
    m = dtm(spark, sf_dir, "A")
    return _r(D.rank_topics_and_slices(m["topic"], m["time"]).withColumn("rank", F.col("rank").cast("bigint")),
              "value")


@register("integrated_profile")
def q_integrated_profile(spark, sf_dir):
    docs = topic_docs_once(spark, sf_dir)
    ot = M.topics_over_time(docs, "quarter", N_WORDS)
    grid, corpus, vocab = dtm_inputs(spark, sf_dir, "D", docs=docs, ot=ot)
    m = D.dtm_metrics(grid, corpus, vocab, "D")
    return _r(D.integrated_profile(ot, m["topic"]), "frequency_mean", "ttq")


@register("combined_report")
def q_combined_report(spark, sf_dir):
    """Over-time rows with TC/TD/TQ of their slice, TTQ of their topic,
    TTC/TTS of (topic, slice) and the overall metrics repeated."""
    docs = topic_docs_once(spark, sf_dir)
    ot = M.topics_over_time(docs, "quarter", N_WORDS)
    grid, corpus, vocab = dtm_inputs(spark, sf_dir, "C", docs=docs, ot=ot)
    m = D.dtm_metrics(grid, corpus, vocab, "C")
    st = D.slice_times(ot)
    overall = m["overall"].groupBy().pivot("metric", ["TTC", "TTS", "TTQ", "TC", "TD", "TQ", "DTQ"]).agg(F.first("value"))
    overall = overall.select(*[F.col(k).alias(f"overall_{k.lower()}") for k in overall.columns])
    rep = (ot.join(st, "timestamp").join(m["time"], "t", "left").join(m["topic"], "topic", "left")
             .join(m["topic_time"], ["topic", "t"], "left"))
    for k in overall.columns:
        rep = rep.withColumn(k, overall.select(k).scalar())
    out = rep.select("topic", "timestamp", F.array_join("words", ", ").alias("words"), "frequency",
                     "tc", "td", "tq", "ttq", "ttc", "tts", *overall.columns)
    return _r(out, "tc", "td", "tq", "ttq", "ttc", "tts", *overall.columns)


@register("platform_comparison")
def q_platform_comparison(spark, sf_dir):
    """Metric x platform (variant D per platform), 4 decimals."""
    docs = topic_docs_once(spark, sf_dir)
    parts = []
    for p in ("YouTube", "Telegram"):
        dp = docs.filter(F.col("platform") == p)
        grid, corpus, vocab = dtm_inputs(spark, sf_dir, "D", docs=dp, ot=M.topics_over_time(dp, "quarter", N_WORDS))
        parts.append(D.dtm_metrics(grid, corpus, vocab, "D")["overall"].select(
            "metric", F.round("value", 4).alias(p.lower())))
    return parts[0].join(parts[1], "metric", "full")


def _dynamic_inputs(spark, sf_dir):
    docs = topic_docs_once(spark, sf_dir)
    ot = M.topics_over_time(docs, "quarter", N_WORDS)
    grid, _, vocab = dtm_inputs(spark, sf_dir, "C", docs=docs, ot=ot)
    st = D.slice_times(ot)
    corpus = (docs.join(st.withColumnRenamed("timestamp", "quarter"), "quarter")
                  .select("doc_id", F.col("t").cast("int").alias("t"), X.tokenize_whitespace("processed").alias("tokens")))
    return grid, corpus, vocab


@register("dynamic_coherence")
def q_dynamic_coherence(spark, sf_dir):
    grid, corpus, vocab = _dynamic_inputs(spark, sf_dir)
    return _r(D.dynamic_coherence(grid, corpus, vocab), "tc")


@register("dynamic_diversity")
def q_dynamic_diversity(spark, sf_dir):
    grid, corpus, _ = _dynamic_inputs(spark, sf_dir)
    sw = corpus.select("t", F.explode("tokens").alias("w")).distinct()
    return _r(D.dynamic_diversity(grid, sw), "td")
