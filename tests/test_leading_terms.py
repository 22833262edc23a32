"""Top terms of classes: the rows of the full ranking, from a few of its terms."""

import random

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import text as X
from lexiflow.operators import topics as M


@pytest.fixture(scope="module")
def counts(spark):
    """(topic, slice, term, tf): frequent words of every class, own words of each, many rare ones, ties, a null slice, a class of 3 terms."""
    r = random.Random(7)
    rows = []
    for topic in (-1, 0, 1):
        for sl in ("a", "b", None):
            rows += [(topic, sl, f"common{i}", r.randint(200, 400)) for i in range(30)]
            rows += [(topic, sl, f"own{topic}{sl}{i:02d}", 40 - i // 4) for i in range(24)]
            rows += [(topic, sl, f"rare{r.randrange(10 ** 6)}{topic}{sl}{i}", r.randint(1, 2)) for i in range(1500)]
    rows += [(2, "a", w, 1) for w in ("x", "y", "common1")] + [(3, "b", f"once{i}", 1) for i in range(40)]
    return spark.createDataFrame(rows, "topic int, slice string, term string, tf long").cache()


def ranked(df):
    return sorted((*r[:-1], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("cols", [["topic", "slice"], ["topic"]])
@pytest.mark.parametrize("n", [1, 10])
def test_leading_terms_are_those_of_the_full_ranking(counts, cols, n):
    ct = counts.groupBy(*cols, "term").agg(F.sum("tf").alias("tf"))
    full = M.top_terms(M.weights_of_counts(ct, cols, M.idf_of_counts(ct)), cols, n)
    got = M.leading_terms(ct, cols, n)
    assert got.columns == full.columns
    assert ranked(got) == ranked(full)


def test_over_time_ranks_only_terms_that_can_win(spark, monkeypatch):
    r = random.Random(5)
    docs = spark.createDataFrame([(t, s, [f"w{int(r.paretovariate(0.7))}" for _ in range(3000)] + [f"rare{t}{s}{i}" for i in range(3000)]) for t in (0, 1) for s in (1, 2)],
                                 "topic int, slice int, tokens array<string>")
    ranked_rows, top = [], M.top_terms

    def counting(weights, *a, **k):
        ranked_rows.append(weights.count())
        return top(weights, *a, **k)

    monkeypatch.setattr(M, "top_terms", counting)
    out = M.topics_over_time(docs, "slice", 10).collect()
    assert len(out) == 4 and all(len(x["words"]) == 10 for x in out)
    assert sum(ranked_rows) < M.class_term_counts(docs, ["topic", "slice"]).count() / 10


def test_no_counts_no_terms(counts):
    assert M.leading_terms(counts.where("false"), ["topic", "slice"], 10).count() == 0


def test_cleaning_patterns_equal_the_plain_ones(spark):
    texts = ["", " ", "a", "a b", " a\tb \n c\r\n", "x\x0by\fz  w v", "\t", "see http://a.b/c now", "http www http://", "awww.x@y @z_1 @ @!", "hwh@ht@http@wwwx",
             "Straße ΣΑΣ İx 𝒳𝒴 é1_2", "a-b c'd 3 44 _ __", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(X.strip_urls_mentions("t").alias("u"), X.collapse_ws("t").alias("w"), X.tokenize_vectorizer("t").alias("k"), X.tokenize_vectorizer("t", 1).alias("k1"))
    plain = d.select(F.regexp_replace("t", r"http\S+|www\S+|@[\p{L}\p{N}_]+", ""), F.trim(F.regexp_replace("t", r"\s+", " ")),
                     F.filter(X.tokenize_words("t"), lambda x: F.length(x) >= 2), X.tokenize_words("t"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in plain.collect()]
