"""Steps whose time or memory once grew too fast."""

import math
import re
from collections import Counter

import pytest

from lexiflow.operators import corpus as V
from lexiflow.operators import language as L
from lexiflow.operators import tokens as T

TEXTS = [(1, "en", "The  cat"), (2, "en", "a\tcat\n"), (3, "de", "Der Kater \U0001F600"), (4, None, "zzz"), (5, "xx", ""), (6, None, None)]
ASKED = [(1, "the cat"), (2, "KATER der"), (3, "qqq"), (4, None), (5, "zzz"), (6, "cat"), (6, "der"), (None, "cat"), (7, "cat \U0001F600 der")]


def grams(text, n):
    t = " " + re.sub(r"\s+", " ", (text or "").lower()) + " "
    return [t[i:i + n] for i in range(len(t) - n + 1)]


def brute(n):
    c = {}
    for _, lang, text in TEXTS:
        c.setdefault(lang, Counter()).update(grams(text, n))
    known = set().union(*c.values())
    langs = sorted(x for x in c if x is not None and c[x])
    out = {}
    for i in {i for i, _ in ASKED}:
        texts = [t for j, t in ASKED if j == i]
        g = Counter(x for t in texts for x in grams(t, n) if x in known and i is not None)
        if not g:
            out[i] = ("unknown", 0.0)
            continue
        s = [math.log(sum(x[1] == lang for x in TEXTS) / len(TEXTS)) + sum(k * math.log((c[lang][x] + 1) / (c[lang].total() + len(known))) for x, k in g.items()) for lang in langs]
        p = [math.exp(x - max(s)) for x in s]
        k = min(range(len(s)), key=lambda k: (-round(s[k], 9), k))
        out[i] = (langs[k], round(p[k] / sum(p) / len(texts), 6))
    return out


@pytest.mark.parametrize("n, bounds", [(3, {}), (2, {"CHARS": 4, "COUNTED": 0}), (3, {"CHARS": 3, "MAX_CELLS": 0}), (4, {})])
def test_languages_equal_a_plain_count(spark, monkeypatch, n, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(L, name, value)
    train = spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")
    asked = spark.createDataFrame(ASKED, "doc_id long, text string")
    got = {r.doc_id: (r.language, r.confidence) for r in L.detect_language(train, asked, n).collect()}
    want = brute(n)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(math.isclose(got[i][1], want[i][1], abs_tol=2e-6) for i in want)
    assert L.detect_language(train.limit(0), asked, n).count() == 0


def test_language_grams_are_summed_where_texts_are_read(spark):
    train = spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")
    plan = L.detect_language(train, spark.createDataFrame(ASKED, "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def terms_of(rows):
    """(tf, df) by term and tf by (id, term) of rows (id, tokens); rows of one id are one document."""
    pairs = Counter((i, t) for i, tokens in rows for t in tokens or [])
    tf, df = Counter(), Counter()
    for (_, t), n in pairs.items():
        tf[t] += n
        df[t] += 1
    return {t: (tf[t], df[t]) for t in tf}, pairs


ONCE = [(i, [f"w{i % 3}", f"w{i % 5}", "x", "x"]) for i in range(20)] + [(30, []), (31, None)]


@pytest.mark.parametrize("rows", [ONCE, [*ONCE, (1, ["x", "new", None]), (None, ["x", None]), (None, ["x"])], [(None, ["a", None, "a"])], []])
def test_terms_are_counted_by_document(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    stats, pairs = terms_of(rows)
    assert {r.term: (r.tf, r.df) for r in T.term_stats(df).collect()} == stats
    vocab = spark.createDataFrame([(0, "w0"), (7, "x"), (8, "nowhere")], "term_id long, term string")
    want = sorted((str(i), {"w0": 0, "x": 7}[t], n) for (i, t), n in pairs.items() if t in ("w0", "x"))
    for bound in (10, None):
        assert sorted((str(r.doc_id), r.term_id, r.tf) for r in V.bag_of_words(df, vocab, max_terms=bound).collect()) == want


def test_no_table_of_documents_and_terms(spark):
    df = spark.createDataFrame(ONCE, "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([(0, "w0")], "term_id long, term string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan(T.term_stats(df)) and plan(T.term_stats(df)).count("Aggregate") == 1
    assert "Aggregate" not in plan(V.bag_of_words(df, vocab, max_terms=10))
