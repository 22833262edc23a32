"""Dynamic-topic metrics (D01-D25): TTC, TTS, TTQ, TC, TD, TQ, DTQ.

One kernel, four presets (``VARIANTS``). Inputs are a topic-word grid
``(topic, t, words)`` with one row per (selected topic, slice) and a
reference corpus ``(doc_id, tokens)``.

Plan shape, chosen for scale:
* Word lists are at most ``n_words`` long, so word pairs of a grid cell are
  built inside the row (array functions); nothing is paired across rows.
* Co-occurrence is counted only for the requested word pairs, in one pass:
  the pairs are a dictionary of checked size that each task matches against
  its documents, emitting partial counts alone (``cooccur``). Raw tokens are
  never joined or shuffled, and no document emits its word pairs.
* Lookahead windows (``lead``/frames) are partitioned by topic and ordered
  by slice: one row per slice per topic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.cooccur import pair_counts
from lexiflow.session import cut_lineage

EPS = 1e-10

# Metric descriptions reported with the overall table.
DESCRIPTIONS = {
    "TTC": "Temporal Topic Coherence - semantic consistency over time",
    "TTS": "Temporal Topic Smoothness - smooth evolution over time",
    "TTQ": "Temporal Topic Quality - TTC × TTS",
    "TC": "Topic Coherence - semantic coherence per time slice",
    "TD": "Topic Diversity - topic diversity per time slice",
    "TQ": "Topic Quality - TC × TD",
    "DTQ": "Dynamic Topic Quality - overall DTM quality measure",
}


@dataclass(frozen=True)
class Variant:
    score: str = "pmi"            # "pmi": ln((p_ij+e)/(p_i p_j+e)); "npmi": ln(p_ij/(p_i p_j+e))/-ln(p_ij+e)
    ttc_pairs: str = "product"    # "product": words(t) x words(t+w); "concat_pairs": i<j of words(t)++words(t+1)
    last_step: bool = False       # True: steps run to T-1 and the last one scores 0
    tc_over_all_topics: bool = False  # True: TC(t) averages over all topics, empty ones as 0


VARIANTS = {
    "A": Variant(),
    "B": Variant(score="npmi", ttc_pairs="concat_pairs", last_step=True, tc_over_all_topics=True),
    "C": Variant(),
    "D": Variant(),
}


def _empty():
    return F.array().cast("array<string>")


# ------------------------------------------------------------------ selection

def select_topics_by_docs(docs: DataFrame, n: int | None = 30, topic_col: str = "topic") -> DataFrame:
    """Top ``n`` topics by document count (all with ``n=None``), outliers (-1) excluded."""
    top = (docs.filter(F.col(topic_col) != -1).groupBy(F.col(topic_col).alias("topic"))
                .agg(F.count(F.lit(1)).alias("n_docs")))
    return top if n is None else top.orderBy(F.desc("n_docs"), F.asc("topic")).limit(n)


def select_topics_by_frequency(over_time: DataFrame, n: int = 30) -> DataFrame:
    """Top ``n`` topics by summed over-time frequency, outliers excluded."""
    return (over_time.filter(F.col("topic") != -1).groupBy("topic")
                     .agg(F.sum("frequency").cast("bigint").alias("frequency"))
                     .orderBy(F.desc("frequency"), F.asc("topic")).limit(n))


def slice_times(over_time: DataFrame) -> DataFrame:
    """(timestamp, t): dense index of the distinct over-time timestamps."""
    d = over_time.select("timestamp").distinct()
    return d.select("timestamp", (F.dense_rank().over(Window.orderBy("timestamp")) - 1).alias("t"))


def parse_words(words: Column, n_words: int, strip_prefix: str | None = None) -> Column:
    """P13 on an array: trim, optional prefix strip, drop empties, first n."""
    w = F.transform(words, lambda x: F.trim(x))
    if strip_prefix:
        k = len(strip_prefix)
        w = F.transform(w, lambda x: F.when(x.startswith(strip_prefix), x.substr(F.lit(k + 1), F.length(x)))
                        .otherwise(x))
    return F.slice(F.filter(w, lambda x: x != ""), 1, n_words)


def topic_word_grid(over_time: DataFrame, topics: DataFrame, n_words: int = 10,
                    strip_prefix: str | None = None) -> DataFrame:
    """(topic, t, words) for every slice x selected topic; ``[]`` when missing.

    Slices come from the whole over-time table (also those only outliers
    use). The grid is generated per topic with ``sequence(0, T-1)``.
    """
    st = slice_times(over_time)
    n_slices = st.select(F.count(F.lit(1))).scalar()
    grid = topics.select("topic", F.explode(
        F.when(n_slices > 0, F.sequence(F.lit(0), n_slices - 1)).otherwise(F.array().cast("array<int>"))
    ).alias("t"))
    ot = (over_time.join(st, "timestamp")
                   .groupBy("topic", "t").agg(F.first("words", ignorenulls=True).alias("words")))
    return (grid.join(ot, ["topic", "t"], "left")
                .select("topic", F.col("t").cast("int").alias("t"),
                        parse_words(F.coalesce("words", _empty()), n_words, strip_prefix).alias("words")))


def topic_word_corpus(grid: DataFrame) -> DataFrame:
    """Each non-empty grid cell is a document, re-split on whitespace."""
    cells = grid.filter(F.size("words") > 0)
    return cells.select(
        F.concat_ws(":", F.col("topic").cast("string"), F.col("t").cast("string")).alias("doc_id"),
        F.filter(F.split(F.array_join("words", " "), r"\s+"), lambda x: x != "").alias("tokens"))


# ------------------------------------------------------------------ pairs

def _pairs_product(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("wi"), y.alias("wj")))))


def _pairs_upper(words_col: str) -> Column:
    """Pairs (words[i], words[j]) for i < j, by position."""
    w = F.col(words_col)
    n = F.size(w)
    idx = F.when(n >= 2, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(idx, lambda i: F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: j > i),
        lambda j: F.struct(w[i].alias("wi"), w[j].alias("wj")))))


def ttc_pair_rows(grid: DataFrame, variant: Variant, window: int = 1) -> DataFrame:
    """(topic, t, wi, wj) for every scored TTC word pair (with multiplicity)."""
    nxt = grid.withColumn("_next", F.lead("words", window).over(Window.partitionBy("topic").orderBy("t")))
    nxt = nxt.filter(F.col("_next").isNotNull() & (F.size("words") > 0) & (F.size("_next") > 0))
    if variant.ttc_pairs == "product":
        pairs = _pairs_product(F.col("words"), F.col("_next"))
    else:
        nxt = nxt.withColumn("_cat", F.concat("words", "_next"))
        pairs = _pairs_upper("_cat")
    return nxt.select("topic", "t", F.explode(pairs).alias("p")).select("topic", "t", "p.wi", "p.wj")


def tc_pair_rows(grid: DataFrame) -> DataFrame:
    """(topic, t, wi, wj): pairs i < j inside each non-empty cell."""
    return (grid.filter(F.size("words") >= 2)
                .select("topic", "t", F.explode(_pairs_upper("words")).alias("p"))
                .select("topic", "t", "p.wi", "p.wj"))


# ------------------------------------------------------------------ counting

def pair_cooccurrence(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(wi, wj, c_i, c_j, c_ij) for requested pairs with c_ij > 0, counted in one pass over the corpus."""
    return pair_counts(corpus, pairs)


def pair_scores(co: DataFrame, n_docs: Column, variant: Variant) -> DataFrame:
    """(wi, wj, score) from counts; pairs that never co-occur are absent."""
    pi = F.col("c_i") / n_docs
    pj = F.col("c_j") / n_docs
    pij = F.col("c_ij") / n_docs
    if variant.score == "pmi":
        s = F.log((pij + EPS) / (pi * pj + EPS))
    else:
        s = F.when(pij >= 1.0, F.lit(1.0)).otherwise(F.log(pij / (pi * pj + EPS)) / (-F.log(pij + EPS)))
    return co.select("wi", "wj", s.alias("score"))


# ------------------------------------------------------------------ metrics

def _jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def dtm_metrics(grid: DataFrame, corpus: DataFrame, vocab: DataFrame, variant: Variant | str = "A",
                window: int = 1) -> dict[str, DataFrame]:
    """Compute all tables. ``vocab`` is a one-column table ``(w)`` of allowed words.

    Returns ``topic_time`` (topic, t, ttc, tts), ``topic`` (topic, ttq),
    ``time`` (t, tc, td, tq) and ``overall`` (metric, value, description).
    """
    v = VARIANTS[variant] if isinstance(variant, str) else variant
    # The grid (topics x slices rows) feeds every branch below. It is small
    # (bounded by topics x slices), so a reliable checkpoint cuts the plan
    # that every branch would otherwise re-embed.
    grid = cut_lineage(grid)
    n_docs = corpus.select(F.count(F.lit(1))).scalar()
    n_slices = grid.select(F.max("t") + 1).scalar()

    grid_words = grid.select(F.explode("words").alias("w")).distinct()
    needed = grid_words.join(vocab.select("w").distinct(), "w", "left_semi")
    ttc_rows = ttc_pair_rows(grid, v, window)
    tc_rows = tc_pair_rows(grid)
    all_pairs = (ttc_rows.select("wi", "wj").unionByName(tc_rows.select("wi", "wj"))
                 .join(needed.select(F.col("w").alias("wi")), "wi", "left_semi")
                 .join(needed.select(F.col("w").alias("wj")), "wj", "left_semi"))
    # One row per requested word pair, bounded by topics x slices x n_words^2.
    scores = cut_lineage(pair_scores(pair_cooccurrence(all_pairs, corpus), n_docs, v))

    last = n_slices if v.last_step else n_slices - 1
    steps = grid.filter(F.col("t") < last)

    ttc = (ttc_rows.join(scores, ["wi", "wj"]).groupBy("topic", "t").agg(F.avg("score").alias("_ttc")))
    seq = F.collect_list(F.when(F.size("words") > 0, F.col("words"))).over(
        Window.partitionBy("topic").orderBy("t").rowsBetween(0, window))
    tts = (grid.withColumn("_seq", seq)
               .withColumn("_tts", F.when(
                   (F.col("t") + window < n_slices) & (F.size("_seq") >= 2),
                   F.aggregate(F.transform(F.sequence(F.lit(0), F.size("_seq") - 2),
                                           lambda i: _jaccard(F.col("_seq")[i], F.col("_seq")[i + 1])),
                               F.lit(0.0), lambda acc, x: acc + x) / (F.size("_seq") - 1)).otherwise(F.lit(0.0)))
               .select("topic", "t", "_tts"))
    topic_time = cut_lineage(steps.select("topic", "t")
                  .join(ttc, ["topic", "t"], "left").join(tts, ["topic", "t"], "left")
                  .select("topic", "t",
                          F.when(F.col("t") + window < n_slices, F.coalesce("_ttc", F.lit(0.0)))
                          .otherwise(F.lit(0.0)).alias("ttc"),
                          F.coalesce("_tts", F.lit(0.0)).alias("tts")))

    per_topic = (grid.select("topic").distinct()
                 .join(topic_time.groupBy("topic").agg(F.avg(F.col("ttc") * F.col("tts")).alias("_q")), "topic", "left")
                 .select("topic", F.coalesce("_q", F.lit(0.0)).alias("ttq")))

    tc_cell = tc_rows.join(scores, ["wi", "wj"]).groupBy("topic", "t").agg(F.avg("score").alias("_tc"))
    cells = grid if v.tc_over_all_topics else grid.filter(F.size("words") > 0)
    cells = cells.join(tc_cell, ["topic", "t"], "left").withColumn("_tc", F.coalesce("_tc", F.lit(0.0)))
    tc_t = cells.groupBy("t").agg(F.avg("_tc").alias("_tc"))
    td_t = (grid.filter(F.size("words") > 0).select("t", F.explode("words").alias("w"))
                .groupBy("t").agg((F.count_distinct("w") / F.count(F.lit(1))).alias("_td")))
    all_t = grid.select("t").distinct()
    per_time = (all_t.join(tc_t, "t", "left").join(td_t, "t", "left")
                .select("t", F.coalesce("_tc", F.lit(0.0)).alias("tc"), F.coalesce("_td", F.lit(0.0)).alias("td"))
                .withColumn("tq", F.col("tc") * F.col("td")))

    # Overall means as long rows; DTQ is derived from the TQ and TTQ rows.
    def _mean(df, col, name):
        return df.agg(F.lit(name).alias("metric"), F.coalesce(F.avg(col), F.lit(0.0)).alias("value"))

    base = (_mean(topic_time, "ttc", "TTC").unionByName(_mean(topic_time, "tts", "TTS"))
            .unionByName(_mean(per_topic, "ttq", "TTQ")).unionByName(_mean(per_time, "tc", "TC"))
            .unionByName(_mean(per_time, "td", "TD")).unionByName(_mean(per_time, "tq", "TQ")))
    dtq = base.agg(F.lit("DTQ").alias("metric"),
                   (0.5 * F.sum(F.when(F.col("metric").isin("TQ", "TTQ"), F.col("value")))).alias("value"))
    desc = F.create_map(*[x for k, d in DESCRIPTIONS.items() for x in (F.lit(k), F.lit(d))])
    overall = base.unionByName(dtq).withColumn("description", desc[F.col("metric")])
    return {"topic_time": topic_time, "topic": per_topic, "time": per_time, "overall": overall}


# ------------------------------------------------------------------ reports

def temporal_evolution(topic_time: DataFrame) -> DataFrame:
    """Per slice, mean TTC and TTS over topics."""
    return topic_time.groupBy("t").agg(F.avg("ttc").alias("mean_ttc"), F.avg("tts").alias("mean_tts"))


# Quality bands (label thresholds) of the report.
DTQ_BANDS = [(0.7, "Excellent"), (0.5, "Good"), (0.3, "Moderate")]
TTC_BANDS = [(0.1, "High"), (0.05, "Medium")]
TTS_BANDS = [(0.5, "High"), (0.3, "Medium")]
TTQ_BANDS = [(0.5, "Excellent"), (0.3, "Good"), (0.1, "Moderate")]
# Advice by the band of DTQ.
DTQ_ADVICE = {
    "Excellent": "Continue using current parameters",
    "Good": "Consider fine-tuning parameters for potential improvements",
    "Moderate": "Consider adjusting model parameters, preprocessing steps, or number of topics",
    "Poor": "Review data preprocessing, model parameters, and topic number selection",
}


def _band(x: Column, bands, default: str) -> Column:
    out = F.lit(default)
    for thr, label in reversed(bands):
        out = F.when(x > thr, F.lit(label)).otherwise(out)
    return out


def quality_bands(overall: DataFrame) -> DataFrame:
    """(metric, value, band) with advice rows when TTC < .05 or TTS < .3, and one for the band of DTQ."""
    v = overall.select("metric", "value")
    banded = v.select("metric", "value", F.when(F.col("metric") == "DTQ", _band(F.col("value"), DTQ_BANDS, "Poor"))
                      .when(F.col("metric") == "TTC", _band(F.col("value"), TTC_BANDS, "Low"))
                      .when(F.col("metric") == "TTS", _band(F.col("value"), TTS_BANDS, "Low"))
                      .when(F.col("metric") == "TTQ", _band(F.col("value"), TTQ_BANDS, "Poor"))
                      .alias("band"))
    advice = v.select(
        F.concat(F.lit("advice_"), F.col("metric")).alias("metric"), "value",
        F.when((F.col("metric") == "TTC") & (F.col("value") < 0.05),
               F.lit("Consider improving topic coherence across time"))
         .when((F.col("metric") == "TTS") & (F.col("value") < 0.3),
               F.lit("Topics change significantly over time"))
         .when(F.col("metric") == "DTQ", _band(F.col("value"), [(b, DTQ_ADVICE[name]) for b, name in DTQ_BANDS], DTQ_ADVICE["Poor"]))
         .alias("band")).filter(F.col("band").isNotNull())
    return banded.unionByName(advice)


def rank_topics_and_slices(per_topic: DataFrame, per_time: DataFrame, n_topics: int = 10,
                           n_slices: int = 5) -> DataFrame:
    """Top topics by TTQ and top slices by TQ as (kind, rank, id, value)."""
    wt = Window.orderBy(F.desc(F.round("ttq", 10)), "topic")
    ws = Window.orderBy(F.desc(F.round("tq", 10)), "t")
    a = (per_topic.orderBy(F.desc(F.round("ttq", 10)), "topic").limit(n_topics)
         .select(F.lit("topic").alias("kind"), F.row_number().over(wt).alias("rank"),
                 F.col("topic").cast("bigint").alias("id"), F.col("ttq").alias("value")))
    b = (per_time.orderBy(F.desc(F.round("tq", 10)), "t").limit(n_slices)
         .select(F.lit("slice").alias("kind"), F.row_number().over(ws).alias("rank"),
                 F.col("t").cast("bigint").alias("id"), F.col("tq").alias("value")))
    return a.unionByName(b)


def integrated_profile(over_time: DataFrame, per_topic: DataFrame) -> DataFrame:
    """Per topic frequency sum/mean, periods, first/last, days, TTQ (0 if absent)."""
    s = (over_time.filter(F.col("topic") != -1).groupBy("topic").agg(
        F.sum("frequency").cast("bigint").alias("frequency_sum"),
        F.avg("frequency").alias("frequency_mean"),
        F.count_distinct("timestamp").alias("time_periods"),
        F.min("timestamp").alias("start_date"), F.max("timestamp").alias("end_date")))
    return (s.join(per_topic, "topic", "left")
             .withColumn("ttq", F.coalesce("ttq", F.lit(0.0)))
             .withColumn("duration_days", F.datediff(F.col("end_date").cast("date"),
                                                     F.col("start_date").cast("date")).cast("bigint")))


def dynamic_coherence(grid: DataFrame, corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """NPMI coherence of each cell's words against the documents of the
    same slice only; ``corpus`` is (doc_id, t, tokens). Returns (t, topic, tc)
    for non-empty cells (0 when no pair co-occurs) — mean it for the score."""
    needed = grid.select(F.explode("words").alias("w")).distinct().join(vocab.select("w"), "w", "left_semi")
    pairs = (tc_pair_rows(grid).join(needed.select(F.col("w").alias("wi")), "wi", "left_semi")
                               .join(needed.select(F.col("w").alias("wj")), "wj", "left_semi"))
    nt = corpus.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    co = pair_counts(corpus, pairs, "t").join(nt, "t")
    pij, pi, pj = F.col("c_ij") / F.col("n"), F.col("c_i") / F.col("n"), F.col("c_j") / F.col("n")
    s = F.when(pij >= 1.0, F.lit(1.0)).otherwise(F.log(pij / (pi * pj + EPS)) / (-F.log(pij + EPS)))
    scores = co.select("t", "wi", "wj", s.alias("score"))
    cell = pairs.join(scores, ["t", "wi", "wj"]).groupBy("topic", "t").agg(F.avg("score").alias("_tc"))
    return (grid.filter(F.size("words") > 0).join(cell, ["topic", "t"], "left")
                .select("t", "topic", F.coalesce("_tc", F.lit(0.0)).alias("tc")))


def dynamic_diversity(grid: DataFrame, slice_words: DataFrame) -> DataFrame:
    """Per slice, distinct / all topic words among the words that occur
    in that slice (``slice_words``: (t, w) with positive frequency)."""
    w = grid.filter(F.size("words") > 0).select("t", F.explode("words").alias("w"))
    w = w.join(slice_words.select("t", "w"), ["t", "w"], "left_semi")
    return w.groupBy("t").agg((F.count_distinct("w") / F.count(F.lit(1))).alias("td"))
