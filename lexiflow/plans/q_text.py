"""Queries: cleaning, tokenising, term statistics, vocabulary, time slices
(P02-P16, T01-T10, V01-V05, Z01-Z05)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.operators import cleaning as C
from lexiflow.operators import corpus as V
from lexiflow.operators import prepare as P
from lexiflow.operators import slices as Z
from lexiflow.operators import tokens as T
from lexiflow.operators.language import filter_language
from lexiflow.plans.catalog import register
from lexiflow.session import ensure_checkpoint_dir, stage
from lexiflow.sources.corpus_store import load, publish
from lexiflow.sources.tables import comments, documents_with_topics

# The fixture corpus is Latin-script, so cleaners keep any letter.
ALPHA = X.ALPHABET_ANY
# English function words used as the stopword list on fixtures.
EN_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it",
                "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def cleaned(spark, sf_dir, with_time=False):
    """Comments with the normalised letters-only text (P06) and its word tokens."""
    c = comments(spark, sf_dir, with_time)
    return (c.withColumn("clean", X.clean_letters_normalized("comment", ALPHA))
             .withColumn("tokens", X.tokenize_vectorizer("clean")))


def cleaned_once(spark, sf_dir, *cols):
    """The given columns of ``cleaned``, staged: vocabulary and counts both read them."""
    return stage(cleaned(spark, sf_dir, "published_at" in cols).select("doc_id", "tokens", *cols), "cleaned-comments")


def _text(name, fn):
    register(name)(lambda spark, sf_dir: comments(spark, sf_dir, with_time=False).select(
        "doc_id", fn(F.col("comment")).alias("clean")))


_text("clean_strict", lambda c: X.clean_strict(c, EN_STOPWORDS, ALPHA))
_text("clean_punct", lambda c: X.clean_punct(c, ALPHA))
_text("clean_light", lambda c: X.clean_light(c, ALPHA))
_text("clean_letters", lambda c: X.clean_letters(c, ALPHA))
_text("clean_letters_normalized", lambda c: X.clean_letters_normalized(c, ALPHA))


@register("filter_min_length")
def q_filter_min_length(spark, sf_dir):
    c = filter_language(comments(spark, sf_dir, with_time=False), "en")
    c = c.withColumn("clean", X.clean_letters_normalized("comment", ALPHA))
    return C.filter_min_length(c, "clean", 15).select("doc_id", F.length("clean").cast("bigint").alias("n_chars"))


@register("drop_empty")
def q_drop_empty(spark, sf_dir):
    c = comments(spark, sf_dir).withColumn("clean", X.clean_strict("comment", EN_STOPWORDS, ALPHA))
    return C.drop_empty(c, "clean", "published_at").select("doc_id", "clean")


@register("parse_time_coerce")
def q_parse_time_coerce(spark, sf_dir):
    c = comments(spark, sf_dir)
    return c.select("doc_id",
                    C.parse_time_coerce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).alias("parsed_ok"),
                    C.parse_time_coerce(F.substring("comment", 1, 19)).alias("parsed_bad"))


@register("parse_time_strict")
def q_parse_time_strict(spark, sf_dir):
    """P10: times written as text and parsed strictly (an invalid one would end the query)."""
    c = comments(spark, sf_dir).where(F.col("published_at").isNotNull())
    return c.select("doc_id", C.parse_time_strict(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).alias("parsed"))


@register("parse_topic_words")
def q_parse_topic_words(spark, sf_dir):
    """The comma-separated parts of a comment as a word list; the prefix 'the ' is stripped."""
    c = comments(spark, sf_dir, with_time=False)
    return c.select("doc_id", F.array_join(X.parse_topic_words("comment", 10, "the "), "|").alias("words"))


@register("add_model_prefix")
def q_add_model_prefix(spark, sf_dir):
    """Cleaned comments with the model's prefix, by digest."""
    c = comments(spark, sf_dir, with_time=False)
    return c.select("doc_id", F.md5(X.add_prefix(X.clean_letters_normalized("comment", ALPHA))).alias("digest"))


@register("calendar_parts")
def q_calendar_parts(spark, sf_dir):
    c = C.tag_source(comments(spark, sf_dir), "fixture", "source_name")
    return C.calendar_parts(c, "published_at").select("doc_id", "source_name", "year", "month", "year_month")


@register("sample_exact_n")
def q_sample_exact_n(spark, sf_dir):
    return C.sample_exact_n(comments(spark, sf_dir), 100, "doc_id", 42, "published_at").select("doc_id", "published_at")


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    c = comments(spark, sf_dir).withColumn("slice", Z.slice_label(F.col("published_at"), "month"))
    return C.stratified_split(c.select("doc_id", "slice"), "slice", "doc_id", 0.1, 42)


def _tok(name, fn):
    def q(spark, sf_dir):
        t = comments(spark, sf_dir, with_time=False).select("doc_id", fn(F.col("comment")).alias("tokens"))
        return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                        F.array_join("tokens", "|").alias("joined"))
    register(name)(q)


_tok("tokenize_words", X.tokenize_words)
_tok("tokenize_whitespace", X.tokenize_whitespace)
_tok("tokenize_space", X.tokenize_space)
_tok("tokenize_vectorizer", X.tokenize_vectorizer)
_tok("tokenize_segments", X.tokenize_segments)
_tok("ngrams", lambda c: X.ngrams(X.tokenize_words(c), 1, 2))
_tok("remove_stopwords", lambda c: X.remove_stopwords(X.tokenize_words(c), EN_STOPWORDS))


@register("doc_length")
def q_doc_length(spark, sf_dir):
    return T.doc_length(cleaned(spark, sf_dir))


@register("avg_doc_length")
def q_avg_doc_length(spark, sf_dir):
    return T.avg_doc_length(cleaned(spark, sf_dir))


@register("term_frequency")
def q_term_frequency(spark, sf_dir):
    return T.term_frequency(cleaned(spark, sf_dir))


@register("document_frequency")
def q_document_frequency(spark, sf_dir):
    """Flagship: document frequency of cleaned English comments."""
    return T.document_frequency(filter_language(cleaned(spark, sf_dir), "en"))


@register("build_vocabulary")
def q_build_vocabulary(spark, sf_dir):
    return V.build_vocabulary(cleaned(spark, sf_dir), min_df=2, max_df=0.9, max_features=5000)


@register("bag_of_words")
def q_bag_of_words(spark, sf_dir):
    docs = cleaned_once(spark, sf_dir)
    vocab = V.build_vocabulary(docs, min_df=2, max_df=0.9, max_features=5000)
    return V.bag_of_words(docs, vocab, max_terms=5000)


@register("filter_min_terms")
def q_filter_min_terms(spark, sf_dir):
    docs = cleaned_once(spark, sf_dir)
    vocab = V.build_vocabulary(docs, min_df=2, max_df=0.9, max_features=5000)
    return V.filter_min_terms(V.bag_of_words(docs, vocab, max_terms=5000), 50)


@register("time_word_frequency")
def q_time_word_frequency(spark, sf_dir):
    docs = cleaned_once(spark, sf_dir, "published_at").withColumn("time_slice", Z.slice_label(F.col("published_at"), "quarter"))
    vocab = V.build_vocabulary(docs, min_df=2, max_df=0.9, max_features=5000)
    return V.time_word_frequency(V.bag_of_words(docs, vocab, max_terms=5000), docs)


PREPARED = P.CorpusSpec(stopwords=EN_STOPWORDS, alphabet=ALPHA)


def prepared_corpus(spark, sf_dir):
    """V05 over the comments of both platforms as two sources."""
    c = comments(spark, sf_dir)
    return P.prepare_corpus({p: c.where(F.col("platform") == p) for p in ("YouTube", "Telegram")}, PREPARED)


@register("prepare_corpus")
def q_prepare_corpus(spark, sf_dir):
    """The prepared documents with their slice, split and in-vocabulary tokens."""
    _, t = prepared_corpus(spark, sf_dir)
    n = t["bow"].groupBy("doc_id").agg(F.sum("tf").cast("bigint").alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"))
    zero = F.lit(0).cast("bigint")
    return (t["docs"].join(n, "doc_id", "left")
            .select("doc_id", "platform", "slice", "t", "split", F.coalesce("n_tokens", zero).alias("n_tokens"),
                    F.coalesce("n_terms", zero).alias("n_terms")))


@register("persist_corpus")
def q_persist_corpus(spark, sf_dir):
    """The prepared corpus published, then read back by its manifest; its counts with words and slices."""
    _, t = prepared_corpus(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiflow-corpora/{uuid.uuid4().hex}"
    publish(t, root, {"docs": "split", "bow": "split"})
    r = load(spark, root)
    docs = r["docs"].join(r["time_map"].select("t", "n_docs"), "t").select("doc_id", "slice", "n_docs")
    return r["bow"].join(r["vocab"].select("term_id", "term"), "term_id").join(docs, "doc_id").select("split", "doc_id", "slice", "n_docs", "term", "tf")


@register("slice_month")
def q_slice_month(spark, sf_dir):
    ts = F.col("published_at")
    return comments(spark, sf_dir).select(
        "doc_id", Z.slice_label(ts, "month").alias("slice_month"),
        Z.slice_label(ts, "quarter").alias("slice_quarter"),
        Z.slice_start(ts, "month").alias("month_start"), Z.slice_start(ts, "quarter").alias("quarter_start"))


@register("valid_slices")
def q_valid_slices(spark, sf_dir):
    c = comments(spark, sf_dir).withColumn("slice", Z.slice_label(F.col("published_at"), "month"))
    return Z.valid_slices(c, "slice", 10)


@register("slice_index")
def q_slice_index(spark, sf_dir):
    c = comments(spark, sf_dir).withColumn("slice", Z.slice_label(F.col("published_at"), "month"))
    return Z.slice_index(Z.keep_valid_slices(c, "slice", 10), "slice")


@register("nearest_slice")
def q_nearest_slice(spark, sf_dir):
    d = documents_with_topics(spark, sf_dir)
    slices = d.filter(F.col("topic") != -1).select(Z.slice_start(F.col("published_at"), "quarter").alias("ts"))
    return Z.nearest_slice(d.select("doc_id", "published_at"), "published_at", slices, "ts")


@register("nearest_slice_asof")
def q_nearest_slice_asof(spark, sf_dir):
    d = documents_with_topics(spark, sf_dir)
    days = d.filter(F.col("topic") != -1).select(F.date_trunc("day", "published_at").alias("ts"))
    return Z.nearest_slice_asof(d.select("doc_id", "published_at"), "published_at", days, "ts")


@register("equal_width_bins")
def q_equal_width_bins(spark, sf_dir):
    return Z.equal_width_bins(comments(spark, sf_dir).select("doc_id", "published_at"), "published_at", 20)
