from pyspark.sql import functions as F

from lexiflow.functions import hashing
from lexiflow.operators import pairs as W


def test_pairs_and_negatives(spark):
    files = spark.createDataFrame([(1, "a b\nc"), (2, "x  y")], "doc_id long, text string")
    p = W.skipgram_pairs(files, 1).orderBy("doc_id", "r").collect()
    got = [(r["doc_id"], r["center_word"], r["context_word"]) for r in p]
    # lines are joined in file order; empty tokens are centres but never contexts
    assert got == [(1, "a", "b"), (1, "b", "a"), (1, "b", "c"), (1, "c", "b"),
                   (2, "", "x"), (2, "", "y")]
    neg = W.negative_samples(files, [7, 8]).collect()
    for d in (1, 2):
        ctx = sorted(r["context_word"] for r in neg if r["doc_id"] == d)
        for k in range(2):
            assert sorted(r[f"neg_{k}"] for r in neg if r["doc_id"] == d) == ctx


def test_label_pairs_shape(spark):
    files = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    lp = W.label_pairs(W.negative_samples(files, [1, 2, 3]), 3)
    assert lp.count() == 6 * 4
    assert lp.filter(F.col("label") == 1).count() == 6


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_by_ranges_equal_whole_batches(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 11}" for k in range(i % 9)) + "\n\nx  y") for i in range(25)] + [(None, "a b"), (30, None)]
    rows += rows[3:8:4]                                                               # repeated files
    f = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (1, 2):
        monkeypatch.setattr(W, "BATCH_CHARS", 1 << 22)
        small = _sorted(W.negative_samples_batch(f, [1, 2], 10, window))
        monkeypatch.setattr(W, "BATCH_CHARS", 0)
        assert small == _sorted(W.negative_samples_batch(f, [1, 2], 10, window)) and small


def test_a_small_batch_shuffles_no_context_rows(spark):
    f = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    plan = W.negative_samples_batch(f, [1, 2, 3], 10)._jdf.queryExecution().toString()
    assert plan.count("Exchange") <= 4 and "FlatMapGroupsInArrow" in plan


def test_hashed_words_equal_the_expression(spark):
    from lexiflow.functions.hashing import hash32
    p = spark.createDataFrame([(1, "a", "é b"), (2, None, ""), (3, "a", "a")], "doc_id long, center_word string, context_word string")
    got = W.hash_features(p, [1, 2])
    assert "MapInArrow" in got._jdf.queryExecution().toString()                       # each word once per batch
    want = p.select("*", *[hash32(F.col(c), s).alias(f"{c[:4]}w_{k}") for c in ("center_word", "context_word") for k, s in enumerate([1, 2])])
    assert _sorted(got) == _sorted(want)


def test_negatives_follow_the_hash_of_place(spark):
    import hashlib
    rows = W.negative_samples(spark.createDataFrame([(7, "a b  c\nd a b"), (8, None)], "doc_id long, text string"), [5]).collect()
    rows = sorted(rows, key=lambda r: r.r)
    order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"5:7:{i}".encode()).hexdigest()[:8])
    assert [r.neg_0 for r in rows] == [rows[i].context_word for i in order]
    assert [(r.center_word, r.context_word) for r in rows] == [
        ("a", "b"), ("b", "a"), ("", "b"), ("", "c"), ("c", "d"), ("d", "c"), ("d", "a"), ("a", "d"), ("a", "b"), ("b", "a")]


def test_words_are_hashed_together(monkeypatch):
    words = ["", "a", "é", "日本" * 9, *("x" * n for n in range(45, 70)), "y" * 300, *(f"{i}:{i * 7}" for i in range(700))]
    called = []
    real = hashing.hashlib.md5
    monkeypatch.setattr(hashing.hashlib, "md5", lambda x: (called.append(x), real(x))[1])
    monkeypatch.setattr(hashing, "LANES", 500)
    for seeds in ([1, 2, 10], ["abc"], []):
        got = hashing.hash32_words(words, seeds)
        assert got.tolist() == [[int(real(f"{s}:{w}".encode()).hexdigest()[:8], 16) for w in words] for s in seeds]
    assert len(called) < 100 and min(map(len, called)) > 50            # only words longer than a block, one by one
    assert hashing.hash32_words([], [1]).shape == (1, 0)


def test_hashed_pairs_are_made_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS", 3)
    files = spark.createDataFrame([(1, "a b\nc d"), (2, "x  y"), (3, None), (3, "q r q"), (None, "s t")], "doc_id long, text string")
    labelled = W.label_pairs(W.negative_samples(files, [7, 8]), 2)
    apart = W.hash_features(labelled.select("*"), [1, 2])                # a new frame: rows go through the JVM
    fused = W.hash_features(labelled, [1, 2])
    assert fused.schema == apart.schema
    assert sorted(map(str, fused.collect())) == sorted(map(str, apart.collect()))
    plan = fused.drop("center_word")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan
