import math

from pyspark.sql import functions as F

from lexiflow.operators import dtm as D


def _run(spark, grid_rows, docs, variant="A"):
    grid = spark.createDataFrame(grid_rows, "topic int, t int, words array<string>")
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>")
    vocab = corpus.select(F.explode("tokens").alias("w")).distinct()
    m = D.dtm_metrics(grid, corpus, vocab, variant)
    return {k: v.collect() for k, v in m.items()}


DOCS = [["a", "b", "c"], ["a", "b"], ["c", "d"], ["a", "d"], ["b", "c", "d"]]


def test_ranges_and_dtq(spark):
    rows = [(1, 0, ["a", "b"]), (1, 1, ["a", "c"]), (1, 2, ["b", "d"]),
            (2, 0, ["c", "d"]), (2, 1, []), (2, 2, ["c", "d", "c"])]
    m = _run(spark, rows, DOCS)
    ov = {r["metric"]: r["value"] for r in m["overall"]}
    assert math.isclose(ov["DTQ"], 0.5 * (ov["TQ"] + ov["TTQ"]))
    for r in m["topic_time"]:
        assert 0.0 <= r["tts"] <= 1.0
    for r in m["time"]:
        assert 0.0 <= r["td"] <= 1.0
    # T-1 steps per topic for variant A
    assert len(m["topic_time"]) == 2 * 2
    # a topic missing in the middle slice scores 0 on both sides of the gap
    tt = {(r["topic"], r["t"]): r for r in m["topic_time"]}
    assert tt[(2, 0)]["ttc"] == 0.0 and tt[(2, 1)]["tts"] == 0.0


def test_repeated_word_counts_twice_in_diversity(spark):
    m = _run(spark, [(1, 0, ["c", "d", "c"])], DOCS)
    td = m["time"][0]["td"]
    assert math.isclose(td, 2 / 3)


def test_single_slice_gives_zero_temporal_metrics(spark):
    m = _run(spark, [(1, 0, ["a", "b"]), (2, 0, ["c", "d"])], DOCS)
    ov = {r["metric"]: r["value"] for r in m["overall"]}
    assert ov["TTC"] == 0.0 and ov["TTS"] == 0.0 and ov["TTQ"] == 0.0


def test_pmi_value_and_equal_word_pair(spark):
    # TTC pairs the full product, so an equal word scores ln((p+e)/(p^2+e))
    m = _run(spark, [(1, 0, ["a"]), (1, 1, ["a"])], DOCS)
    p = 3 / 5
    assert math.isclose(m["topic_time"][0]["ttc"], math.log((p + 1e-10) / (p * p + 1e-10)), rel_tol=1e-9)


def test_variants_differ(spark):
    rows = [(1, 0, ["a", "b"]), (1, 1, ["c", "d"])]
    a = {r["metric"]: r["value"] for r in _run(spark, rows, DOCS, "A")["overall"]}
    b = {r["metric"]: r["value"] for r in _run(spark, rows, DOCS, "B")["overall"]}
    assert a["TTC"] != b["TTC"]
