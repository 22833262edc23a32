"""Topic tables computed with SQL operators.

Class-based TF-IDF (published definition): for a class c and term t,
``W(t, c) = tf(t, c) / sum_t tf(t, c) * ln(1 + A / f(t))`` where ``A`` is the
mean token count per topic class and ``f(t)`` the corpus count of t. Over
time, classes are (topic, slice) and the idf part stays the one fitted on
topic classes over the whole corpus.

Per-class totals are joined from a grouped table rather than taken with a
window, so a huge topic never becomes one window partition; per-class top-n
uses ``row_number() <= n`` which Spark plans with a partial group limit
before the shuffle. Where only the top terms are wanted, ``leading_terms``
bounds every weight by its count and weighs and ranks only those that can win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.session import stage

LEADING = 5        # so many times n terms of the highest counts are weighed for the bar of a class


def class_term_counts(docs: DataFrame, class_cols: list[str], tokens_col: str = "tokens") -> DataFrame:
    """(class..., term, tf)."""
    return (docs.select(*class_cols, F.explode(tokens_col).alias("term"))
                .groupBy(*class_cols, "term").agg(F.count(F.lit(1)).alias("tf")))


def ctfidf_idf(docs: DataFrame, topic_col: str = "topic", tokens_col: str = "tokens") -> DataFrame:
    """(term, idf) with ``idf = ln(1 + A / f(t))`` fitted on topic classes."""
    return idf_of_counts(class_term_counts(docs, [topic_col], tokens_col), topic_col)


def idf_of_counts(ct: DataFrame, topic_col: str = "topic") -> DataFrame:
    """The same from counts (topic, ..., term, tf)."""
    f = ct.groupBy("term").agg(F.sum("tf").alias("f"))
    avg_words = ct.agg(F.sum("tf") / F.count_distinct(topic_col)).scalar()
    return f.select("term", F.log(F.lit(1.0) + avg_words / F.col("f")).alias("idf"))


def ctfidf(docs: DataFrame, class_cols: list[str], idf: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(class..., term, tf, weight) with L1-normalised tf times idf."""
    return weights_of_counts(class_term_counts(docs, class_cols, tokens_col), class_cols, idf)


def weights_of_counts(ct: DataFrame, class_cols: list[str], idf: DataFrame) -> DataFrame:
    """The same from counts (class..., term, tf)."""
    tot = ct.groupBy(*class_cols).agg(F.sum("tf").alias("_tot"))
    return (ct.join(tot, class_cols).join(idf, "term")
              .select(*class_cols, "term", "tf", (F.col("tf") / F.col("_tot") * F.col("idf")).alias("weight")))


def top_terms(weights: DataFrame, class_cols: list[str], n: int, weight_col: str = "weight") -> DataFrame:
    """Top ``n`` terms per class by weight (ties: term ascending), with rank 1..n.

    Ranking uses the weight rounded to 10 places, so last-bit differences of
    floating point never decide an order.
    """
    w = Window.partitionBy(*class_cols).orderBy(F.desc(F.round(weight_col, 10)), F.asc("term"))
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def leading_terms(ct: DataFrame, class_cols: list[str], n: int, topic_col: str = "topic") -> DataFrame:
    """The rows of ``top_terms`` over all weights of the counts ``ct`` (class..., term, tf), without weighing each term.

    A term's corpus count is at least its count in the class, so ``tf / tot *
    ln(1 + A / tf)`` bounds its weight, and grows with tf. The terms of the
    highest counts of a class are weighed first; the n-th best weight among
    them is the bar of the class, and the terms whose bound reaches the bar
    hold the top n, ties included. A class of fewer than n terms has no bar.
    Corpus counts are summed for these terms only, so the counts are scanned
    a few times but neither sorted nor shuffled. ``ct`` must be cheap to read
    again (staged).
    """
    cells = ct.groupBy(*class_cols, "tf").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*class_cols).orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    classes = stage(cells.groupBy(*class_cols).agg(F.sum(F.col("tf") * F.col("_n")).alias("_tot"), F.min(F.when(F.col("_above") < LEADING * n, F.col("tf"))).alias("_cut")), "classes")
    avg_words = classes.agg(F.sum("_tot") / F.count_distinct(topic_col)).scalar()

    def weight(f: str):
        return F.col("tf") / F.col("_tot") * F.log(F.lit(1.0) + avg_words / F.col(f))

    def weigh(rows: DataFrame) -> DataFrame:
        f = ct.join(rows, "term", "left_semi").groupBy("term").agg(F.sum("tf").alias("f"))
        return top_terms(rows.join(f, "term").select(*class_cols, "term", "tf", weight("f").alias("weight")), class_cols, n)

    lowest = classes.select(F.min("_cut")).scalar()
    high = ct.where(F.col("tf") >= lowest).join(classes, class_cols).where(F.col("tf") >= F.col("_cut"))
    high = stage(high.select(*class_cols, "term", "tf", "_tot"), "high-counts")
    bar = weigh(high).where(F.col("rank") == n).select(*class_cols, (F.round("weight", 10) - 1e-10).alias("_bar"))     # less what rounding may add
    bars = stage(classes.join(bar, class_cols, "left").select(*class_cols, "_tot", F.coalesce("_bar", F.lit(0.0)).alias("_bar")), "bars")
    able = stage(ct.join(bars, class_cols).where(weight("tf") >= F.col("_bar")).select(*class_cols, "term", "tf", "_tot"), "able-terms")
    return weigh(able)


def collect_ranked_words(top: DataFrame, class_cols: list[str]) -> DataFrame:
    """(class..., words ARRAY<STRING>) in rank order; at most n rows per class."""
    return (top.groupBy(*class_cols)
               .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_w"))
               .select(*class_cols, F.col("_w.term").alias("words")))


def topic_words(docs: DataFrame, n_words: int = 10, topic_col: str = "topic",
                tokens_col: str = "tokens") -> DataFrame:
    """(topic, rank, term, weight) top terms per topic by class TF-IDF."""
    ct = stage(class_term_counts(docs, [topic_col], tokens_col), "topic-terms")       # the texts are read once
    return leading_terms(ct, [topic_col], n_words, topic_col)


def _tuned_weights(ct: DataFrame, topic_col: str, slice_col: str, global_tuning: bool, evolution_tuning: bool) -> DataFrame:
    """(topic, slice, term, tf, weight) of all terms, averaged as ``topics_over_time`` says."""
    by_topic = ct.groupBy(topic_col, "term").agg(F.sum("tf").alias("tf"))
    idf = idf_of_counts(by_topic, topic_col)
    w = weights_of_counts(ct, [topic_col, slice_col], idf)
    if global_tuning:
        g = weights_of_counts(by_topic, [topic_col], idf).select(topic_col, "term", F.col("weight").alias("_g"))
        w = (w.join(g, [topic_col, "term"], "left")
              .withColumn("weight", (F.col("weight") + F.coalesce("_g", F.lit(0.0))) / 2).drop("_g"))
    if evolution_tuning:
        sl = w.select(slice_col).distinct()
        sl = sl.withColumn("_i", F.dense_rank().over(Window.orderBy(slice_col)))
        w = w.join(sl, slice_col)
        prev = w.select(topic_col, "term", (F.col("_i") + 1).alias("_i"), F.col("weight").alias("_p"))
        w = (w.join(prev, [topic_col, "term", "_i"], "left")
              .withColumn("weight", F.when(F.col("_p").isNull(), F.col("weight"))
                          .otherwise((F.col("weight") + F.col("_p")) / 2)).drop("_p", "_i"))
    return w


def topics_over_time(docs: DataFrame, slice_col: str, n_words: int = 10, topic_col: str = "topic",
                     tokens_col: str = "tokens", global_tuning: bool = False,
                     evolution_tuning: bool = False) -> DataFrame:
    """(topic, timestamp, words ARRAY<STRING>, frequency) per (topic, slice).

    ``frequency`` is the number of documents of the topic in the slice. With
    ``global_tuning`` the weight is averaged with the topic's whole-corpus
    weight; with ``evolution_tuning`` it is then averaged with the topic's
    weight of the previous slice (same term), when that exists.
    """
    # The texts are read once: counts by topic are sums of those by topic and slice.
    ct = stage(class_term_counts(docs, [topic_col, slice_col], tokens_col), "topic-slice-terms")
    if global_tuning or evolution_tuning:
        top = top_terms(_tuned_weights(ct, topic_col, slice_col, global_tuning, evolution_tuning), [topic_col, slice_col], n_words)
    else:
        top = leading_terms(ct, [topic_col, slice_col], n_words, topic_col)
    words = collect_ranked_words(top, [topic_col, slice_col])
    freq = docs.groupBy(topic_col, slice_col).agg(F.count(F.lit(1)).alias("frequency"))
    return (freq.join(words, [topic_col, slice_col], "left")
                .select(F.col(topic_col).alias("topic"), F.col(slice_col).alias("timestamp"),
                        F.coalesce("words", F.array().cast("array<string>")).alias("words"), "frequency"))


def topic_info(docs: DataFrame, words: DataFrame, n_words: int = 5, topic_col: str = "topic") -> DataFrame:
    """(topic, n_docs, words) sorted by count; words = top ``n_words`` terms."""
    cnt = docs.groupBy(topic_col).agg(F.count(F.lit(1)).alias("n_docs"))
    top = collect_ranked_words(words.filter(F.col("rank") <= n_words), [topic_col])
    return (cnt.join(top, topic_col, "left")
               .select(topic_col, "n_docs", F.array_join(F.coalesce("words", F.array().cast("array<string>")), ", ")
                       .alias("words"))
               .orderBy(F.desc("n_docs"), topic_col))


def topic_distribution(docs: DataFrame, top_n: int = 20, topic_col: str = "topic") -> DataFrame:
    """The ``top_n`` largest topics (outliers included, as counted)."""
    return (docs.groupBy(topic_col).agg(F.count(F.lit(1)).alias("n_docs"))
                .orderBy(F.desc("n_docs"), topic_col).limit(top_n))


def topics_per_platform(docs: DataFrame, topic_col: str = "topic", by: str = "platform") -> DataFrame:
    """Distinct topics per platform."""
    return docs.groupBy(by).agg(F.count_distinct(topic_col).alias("n_topics"))


def over_time_summary(over_time: DataFrame, by: str = "platform") -> DataFrame:
    """Rows, distinct topics, first and last time per platform."""
    return over_time.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.count_distinct("topic").alias("n_topics"),
                                     F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def topic_report(docs: DataFrame, words: DataFrame, ts_col: str = "published_at",
                 topic_col: str = "topic", by: str = "platform") -> DataFrame:
    """Report facts as (section, key, value) rows: totals, date range,
    platform counts, number of topics and outliers, top-10 topics with 5 words."""
    total = docs.agg(F.lit("summary").alias("section"), F.lit("total_comments").alias("key"),
                     F.count(F.lit(1)).cast("string").alias("value"))
    rng = docs.agg(F.lit("summary").alias("section"), F.lit("date_range").alias("key"),
                   F.concat_ws(" to ", F.min(ts_col).cast("string"), F.max(ts_col).cast("string")).alias("value"))
    plat = docs.groupBy(by).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("platform").alias("section"), F.col(by).alias("key"), F.col("n").cast("string").alias("value"))
    ntop = docs.agg(F.lit("topics").alias("section"), F.lit("total_topics").alias("key"),
                    F.count_distinct(F.when(F.col(topic_col) != -1, F.col(topic_col))).cast("string").alias("value"))
    nout = docs.agg(F.lit("topics").alias("section"), F.lit("outliers").alias("key"),
                    F.count_if(F.col(topic_col) == -1).cast("string").alias("value"))
    info = topic_info(docs.filter(F.col(topic_col) != -1), words, 5, topic_col).limit(10)
    top = info.select(F.lit("top_topics").alias("section"), F.col(topic_col).cast("string").alias("key"),
                      F.concat(F.col("n_docs").cast("string"), F.lit(": "), F.col("words")).alias("value"))
    return total.unionByName(rng).unionByName(plat).unionByName(ntop).unionByName(nout).unionByName(top)


def topic_similarity(docs: DataFrame, n_topics: int = 20, topic_col: str = "topic", outlier: int = -1) -> DataFrame:
    """(topic_a, topic_b, similarity), the cosines of the class TF-IDF
    vectors of the ``n_topics`` largest topics (the outliers left out).

    The Gram matrix is a bounded sparse product: a term's row holds at most
    ``n_topics`` weights, its products with itself are made inside the row, and
    the (topic, topic) cells are summed by partial aggregation. Nothing is
    joined by term with itself. Topics that share no term have similarity 0.
    """
    ct = stage(class_term_counts(docs, [topic_col]), "topic-terms")
    weights = weights_of_counts(ct, [topic_col], idf_of_counts(ct, topic_col))
    largest = (docs.where(F.col(topic_col) != outlier).groupBy(topic_col).agg(F.count(F.lit(1)).alias("_n"))
               .orderBy(F.desc("_n"), topic_col).limit(n_topics).select(topic_col))
    kept = weights.join(F.broadcast(largest), topic_col, "left_semi")
    row = F.sort_array(F.collect_list(F.struct(F.col(topic_col).alias("t"), F.col("weight").alias("w"))))
    cells = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b["t"] >= a["t"]), lambda b: F.struct(
        a["t"].alias("topic_a"), b["t"].alias("topic_b"), (a["w"] * b["w"]).alias("p")))))
    gram = kept.groupBy("term").agg(row.alias("r")).select(F.inline(cells)).groupBy("topic_a", "topic_b").agg(F.sum("p").alias("dot"))
    # from here on at most n_topics squared cells, in one row
    cell = gram.agg(F.sort_array(F.collect_list(F.struct("topic_a", "topic_b", "dot"))).alias("g"))
    own = F.filter("g", lambda c: c["topic_a"] == c["topic_b"])
    pairs = F.flatten(F.transform(own, lambda a: F.transform(own, lambda b: F.struct(
        a["topic_a"].alias("topic_a"), b["topic_a"].alias("topic_b"), (F.sqrt(a["dot"]) * F.sqrt(b["dot"])).alias("norms"),
        F.filter("g", lambda c: (c["topic_a"] == F.least(a["topic_a"], b["topic_a"])) & (c["topic_b"] == F.greatest(a["topic_a"], b["topic_a"]))).alias("c")))))
    return cell.select(F.inline(pairs)).select("topic_a", "topic_b", (F.coalesce(F.get("c", F.lit(0))["dot"], F.lit(0.0)) / F.col("norms")).alias("similarity"))
