"""LDA and term counts on Arrow batches against Spark ML's own estimators."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.feature import CountVectorizer

from lexiflow.operators import lda as L
from lexiflow.operators import models as ML

WORDS = [f"w{i}" for i in range(30)] + ["z", "y", "x"]


def docs_of(spark, n=150):
    rng = np.random.default_rng(7)
    rows = [(i, [] if i % 41 == 0 else [WORDS[w] for w in rng.integers(0, 12 + i % 22, 1 + int(rng.integers(0, 60)))]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)


def test_count_model_equals_the_estimator_with_bounds_as_numbers(spark):
    docs = spark.createDataFrame(docs_of(spark).collect(), "doc_id long, tokens array<string>")
    tf = Counter(t for r in docs.collect() for t in r.tokens)
    for size, lo, hi in ((100, 1, 0.9), (10, 2, 0.9), (12, 0.05, 60), (100, 1, 1.0), (100, 0.001, 0.5)):
        want = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=size, minDF=lo, maxDF=hi).fit(docs).vocabulary
        got = ML.count_model(docs, size, lo, hi).vocabulary
        assert [tf[t] for t in got] == [tf[t] for t in want]                # terms of one count come in any order
        assert size < 100 or sorted(got) == sorted(want)
    calls = []
    old, ML.CountVectorizer = ML.CountVectorizer, lambda **kw: (calls.append(kw), old(**kw))[1]
    try:
        ML.count_model(docs, 100, 5, 0.9)
    finally:
        ML.CountVectorizer = old
    assert calls[0]["maxDF"] == 0.9 * 150 and calls[0]["minDF"] == 5


@pytest.mark.parametrize("cells", [1 << 19, 600])     # all documents at once; a few at a time
def test_lda_equals_spark(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(L, "CELLS", cells)
    cv, got, feats = ML.fit_lda(docs_of(spark), k=4, vocab_size=40, min_df=1, max_df=0.9, max_iter=4)
    want = LDA(k=4, maxIter=4, optimizer="online", subsamplingRate=1.0, seed=42, featuresCol="features").fit(feats)
    assert got.topicsMatrix().toArray() == pytest.approx(want.topicsMatrix().toArray(), rel=1e-5)
    assert got.estimatedDocConcentration().toArray() == pytest.approx(want.estimatedDocConcentration().toArray(), rel=1e-6)
    weights = {r.doc_id: list(r.topicDistribution) for r in want.transform(feats).collect()}
    for model in (got, want):
        assert {r.doc_id: r.weights for r in L.infer(model, feats, "doc_id").collect()} == {d: pytest.approx(w, abs=1e-6) for d, w in weights.items()}
    assert sum(not any(w) for w in weights.values()) == 4                 # documents without terms
    got.write().save(f"{tmp_path}/lda")
    again = LocalLDAModel.load(f"{tmp_path}/lda")
    assert again.getSeed() == 42 and again.getK() == 4
    assert {r.doc_id: r.weights for r in L.infer(again, feats, "doc_id").collect()} == {r.doc_id: r.weights for r in L.infer(got, feats, "doc_id").collect()}


def test_documents_are_iterated_together(spark):
    """One array of many documents, and a document drawn twice taken once: both in fewer steps than document by document."""
    steps, psi = [], L.digamma
    rng = np.random.default_rng(1)
    beta, size = rng.random((50, 4)), np.full(200, 20)
    try:
        L.digamma = lambda x: (steps.append(1), psi(x))[1]
        groups = list(L.variational(np.cumsum(size) - size, size, rng.integers(0, 50, 4000), np.ones(4000), beta, np.full(4, 0.25), np.ones(4)))
    finally:
        L.digamma = psi
    assert sorted(d for g in groups for d in g[0].tolist()) == list(range(200))
    assert len(steps) < 2000
