"""Corpus state, published tables, order statistics, ordered merges, recovering reader, block search, pair counts, streams, model bundle."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lexiflow.functions import text as X
from lexiflow.operators import bundle as B
from lexiflow.operators import cooccur as CO
from lexiflow.operators import models as ML
from lexiflow.operators import order_stats as OS
from lexiflow.operators import ordered as O
from lexiflow.operators import pairs as W
from lexiflow.operators import prepare as P
from lexiflow.operators import slices as Z
from lexiflow.operators import topics as M
from lexiflow.operators import vectors as N
from lexiflow.sources import corpus_store as S
from lexiflow.sources import files as FS
from lexiflow.streaming import jobs as J

SMOKE = "/root/testdata/sf0.001"
SPEC = P.CorpusSpec(stopwords=["the"], alphabet=X.ALPHABET_ANY, min_slice_docs=3, min_df=1, max_df=1.0, max_features=5, test_frac=0.25)


def comments(spark, n, month="2024-01", start=0, text="alpha beta gamma"):
    rows = [(start + i, f"{text} the word{i % 3}", f"{month}-0{i % 9 + 1} 00:00:00") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, comment string, ts string").select("doc_id", "comment", F.to_timestamp("ts").alias("published_at"))


def test_fitted_corpus_applies_to_unseen_documents(spark):
    odd = spark.createDataFrame([(90, None), (91, "  "), (92, "the an"), (93, "alpha beta")], "doc_id long, comment string")
    odd = odd.withColumn("published_at", F.when(F.col("doc_id") < 93, F.to_timestamp(F.lit("2024-01-01 00:00:00"))))
    a = comments(spark, 8).unionByName(odd)
    b = comments(spark, 4, "2024-02", 20).unionByName(comments(spark, 2, "2024-03", 40))
    state, t = P.prepare_corpus({"a": a, "b": b}, SPEC)
    docs = t["docs"].collect()
    assert {r.doc_id for r in docs} == {*range(8), *range(20, 24)}                # no null, empty, short-slice rows
    assert {(r.slice, r.t) for r in docs} == {("2024-01", 0), ("2024-02", 1)}
    assert Counter((r.platform, r.split) for r in docs) == {("a", "train"): 6, ("a", "test"): 2, ("b", "train"): 3, ("b", "test"): 1}
    vocab = {r.term: r.term_id for r in t["vocab"].collect()}
    assert set(vocab) == {"alpha", "beta", "gamma", "word"}
    new = P.clean_union({"c": comments(spark, 1, "2024-02", 70, "alpha alpha unseen").unionByName(comments(spark, 1, "2025-01", 71))}, SPEC)
    d, bow = P.transform(state, new)
    assert [(r.doc_id, r.t) for r in d.collect()] == [(70, 1)]
    assert {(r.term_id, r.tf) for r in bow.where("doc_id = 70").collect()} >= {(vocab["alpha"], 2)}
    none = spark.createDataFrame([], a.schema)
    assert all(x.count() == 0 for x in P.prepare_corpus({"a": none}, SPEC)[1].values())


def test_broken_publication_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "store")
    assert S.latest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        S.load(spark, root)
    one = {"docs": spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string"), "vocab": spark.createDataFrame([("a",)], "w string")}
    assert S.publish(one, root, {"docs": "split"}) == 1
    bad = {"docs": one["docs"].limit(1), "vocab": one["vocab"].select(F.raise_error(F.lit("dies")).cast("string").alias("w"))}
    with pytest.raises(Exception):
        S.publish(bad, root, {"docs": "split"})
    back = S.load(spark, root)
    assert sorted(map(tuple, back["docs"].collect())) == [(1, "train"), (2, "test")] and back["docs"].columns == ["id", "split"]
    assert S.row_counts(spark, root) == {"docs": 2, "vocab": 1}
    assert S.publish({"docs": one["docs"].limit(0), "vocab": one["vocab"]}, root) == 2
    assert S.load(spark, root)["docs"].count() == 0 and S.load(spark, root, 1)["docs"].count() == 2


def test_order_statistics_are_exact(spark, monkeypatch):
    monkeypatch.setattr(OS, "SMALL", 50)
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=20001) * 10.0 ** rng.integers(-200, 200, 20001), np.array([5.0] * 3000 + [7.0]), np.array([1e308, -1e308, 0.0]), np.array([2.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        s = np.sort(x)
        ranks = sorted({0, len(x) // 3, len(x) // 2, len(x) - 1})
        assert OS.values_at(df, "v", ranks) == [s[r] for r in ranks]
        assert OS.median(df, "v") == pytest.approx(s[(len(x) - 1) // 2] / 2 + s[len(x) // 2] / 2)
    odd = spark.createDataFrame([(v,) for v in (math.nan, math.inf, -math.inf, 1.0)], "v double")
    got = OS.values_at(odd, "v", [0, 1, 2, 3, 4])
    assert got[:3] == [-math.inf, 1.0, math.inf] and math.isnan(got[3]) and got[4] is None
    assert OS.median(odd.where("v = 9"), "v") is None


def test_running_values_cross_ranges(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 5]), i, rnd.choice([None, None, i])) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")       # else so few rows are one range
    o = O.in_order(spark.createDataFrame(rows, "k int, i int, v int").repartition(7), ["k", "i"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert o.select(O.PART).distinct().count() > 1
    x = O.running_last(O.running_last(O.running_sum(o, F.col("i"), "s"), F.col("v"), "before"), F.col("v"), "after", forward=False).collect()
    order = sorted(rows, key=lambda r: r[:2])
    want, total, last = [], 0, None
    for k, i, v in order:
        total, last = total + i, v if v is not None else last
        want.append((total, last))
    nxt, after = None, []
    for _, _, v in reversed(order):
        nxt = v if v is not None else nxt
        after.append(nxt)
    got = {(r.k, r.i): (r.s, r.before, r.after) for r in x}
    assert [got[r[:2]] for r in order] == [(*w, a) for w, a in zip(want, reversed(after))]


def test_asof_equals_nearest_slice(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([None, 1000, rnd.randint(0, 5000)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, s int").select("id", F.timestamp_seconds("s").alias("ts"))
    slices = spark.createDataFrame([(s,) for s in (100, 300, 300, 1500, 2700, 2900)], "s int").select(F.timestamp_seconds("s").alias("at"))
    a = Z.nearest_slice_asof(df, "ts", slices, "at")
    assert sorted(map(str, a.collect())) == sorted(map(str, Z.nearest_slice(df, "ts", slices, "at").collect()))
    tie = spark.createDataFrame([(200,)], "s int").select(F.timestamp_seconds("s").alias("ts"))
    assert Z.nearest_slice_asof(tie, "ts", slices, "at").first().t == 0
    assert [r.t for r in Z.nearest_slice_asof(tie, "ts", slices.limit(0), "at").collect()] == [None]


def test_reader_recovers_record_boundaries(spark, tmp_path):
    text = ('1,"two\nlines, ""quoted""",2024-01-01,en,0.5,YouTube\n'
            '2,plain,2024-01-02,de,0.25,Telegram\n'
            '\n'
            '3,"never closed,2024\n'
            'still that record\n'
            '4,"ok",2024-01-03,fr,1.0,YouTube\n'
            'five,bad id,2024-01-04,en,0.1,YouTube\n'
            '6,too,few\n'
            '7,"a\n\nb",2024-01-05,es,,Telegram\n')
    (tmp_path / "a.csv").write_text("doc_id,comment,published_at,language,language_score,platform\n" + text)
    (tmp_path / "b.csv").write_text("h\n" + "\n".join(f'{i},"x\n{i}",t,en,0.5,p' for i in range(100, 140)))
    rows = FS.scan_comments_recovered(spark, str(tmp_path), header=True).collect()
    a = {r.line: r for r in rows if r.file.endswith("a.csv")}
    assert {k: (r.doc_id, r.comment) for k, r in a.items() if r.malformed is None} == {
        2: (1, 'two\nlines, "quoted"'), 4: (2, "plain"), 8: (4, "ok"), 11: (7, "a\n\nb")}
    assert {k: r.malformed for k, r in a.items() if r.malformed is not None} == {
        6: '3,"never closed,2024\nstill that record', 9: "five,bad id,2024-01-04,en,0.1,YouTube", 10: "6,too,few"}
    b = sorted((r.line, r.doc_id, r.comment) for r in rows if r.file.endswith("b.csv"))
    assert b == [(2 + 2 * k, 100 + k, f"x\n{100 + k}") for k in range(40)]


def test_blocks_equal_rows_in_search(spark):
    rnd = random.Random(1)
    v = [(i, [rnd.choice([0.0, 1.0, 0.5]) for _ in range(4)]) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(5)
    for metric, far in (("l2", False), ("ip", False), ("l2", True)):
        want = N.knn(df.where("embedding is not null"), [0, 3, 77], 9, metric=metric, farthest=far)
        assert sorted(map(tuple, N.knn_blocks(df, [0, 3, 77], 9, metric=metric, farthest=far).collect())) == sorted(map(tuple, want.collect()))
    assert N.knn_blocks(df, [999], 3).count() == 0 and N.knn_blocks(df.limit(0), [1], 3).count() == 0


def test_batch_negatives_are_permutations_of_the_batch(spark):
    rnd = random.Random(2)
    f = spark.createDataFrame([(i, " ".join(rnd.choices("abcdefg", k=rnd.randint(0, 9)))) for i in range(25)], "doc_id long, text string")
    got = W.negative_samples_batch(f, [1, 2], batch_size=10).collect()
    assert sorted((r.doc_id, r.center_word, r.context_word) for r in got) == sorted((r.doc_id, r.center_word, r.context_word) for r in W.skipgram_pairs(f).collect())
    for b in {r.batch_id for r in got}:
        mine = sorted((r for r in got if r.batch_id == b), key=lambda r: r.row)
        assert [r.row for r in mine] == list(range(len(mine)))
        for c in ("neg_0", "neg_1"):
            assert Counter(r[c] for r in mine) == Counter(r.context_word for r in mine)
        assert [r.neg_0 for r in mine] != [r.neg_1 for r in mine]


@pytest.mark.parametrize("bound", [CO.MAX_REQUESTS, 3])
def test_pair_counts_equal_sets(spark, monkeypatch, bound):
    monkeypatch.setattr(CO, "MAX_REQUESTS", bound)       # the second goes by joins
    monkeypatch.setattr(CO, "DOCS", 64)
    rnd = random.Random(6)
    docs = [(i, i % 3, rnd.choices("abcdefghij", k=rnd.randint(0, 8))) for i in range(150)] + [(200, 1, None)]
    pairs = [("a", "b"), ("b", "a"), ("c", "c"), ("j", "zz"), ("d", "e"), ("a", "b")]
    df = spark.createDataFrame(docs, "doc_id long, t int, tokens array<string>").repartition(3)
    got = CO.pair_counts(df, spark.createDataFrame(pairs, "wi string, wj string")).collect()

    def n(*words, t=None):
        return sum(set(words) <= set(d[2] or ()) for d in docs if t in (None, d[1]))

    assert sorted(map(tuple, got)) == sorted((i, j, n(i), n(j), n(i, j)) for i, j in set(pairs) if n(i, j))
    by = spark.createDataFrame([(t, i, j) for t in (0, 2, 9) for i, j in pairs], "t int, wi string, wj string")
    got = CO.pair_counts(df, by, "t").collect()
    assert sorted(map(tuple, got)) == sorted((t, i, j, n(i, t=t), n(j, t=t), n(i, j, t=t)) for t in (0, 2) for i, j in set(pairs) if n(i, j, t=t))


def test_topic_similarity_of_disjoint_and_equal_topics(spark):
    docs = [(0, ["a", "b"]), (1, ["a", "b"]), (2, ["c"]), (-1, ["a"]), (3, ["z"])] + [(k, [f"w{k}"]) for k in (0, 1, 2)]
    got = {(r.topic_a, r.topic_b): r.similarity for r in M.topic_similarity(spark.createDataFrame(docs, "topic int, tokens array<string>"), 3).collect()}
    assert set(got) == {(a, b) for a in (0, 1, 2) for b in (0, 1, 2)}
    assert all(got[t, t] == pytest.approx(1) for t in range(3)) and got[0, 2] == 0 and 0 < got[0, 1] < 1 and got[0, 1] == got[1, 0]


def test_ledger_skips_retried_batches(spark, tmp_path):
    from lexiflow.operators import sketch as K
    from lexiflow.operators import tokens as T
    from lexiflow.plans.catalog import q_vectors
    CMS = q_vectors.CMS
    parts = [spark.createDataFrame([(i, ["a", "b", f"w{i}"])], "doc_id long, tokens array<string>") for i in range(3)]
    write = J.ledger_sketch_writer(str(tmp_path / "s"), CMS)
    for k in (0, 1, 1, 0, 2):
        write(parts[k], k)
    store = S.load(spark, str(tmp_path / "s"))
    whole = K.sketch_build(T.document_frequency(parts[0].unionByName(parts[1]).unionByName(parts[2]), "tokens"), CMS)
    assert sorted(map(tuple, store["cells"].select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(r.batch_id for r in store["ledger"].collect()) == [0, 1, 2]


def test_late_rows_are_counted_and_windows_close(spark):
    r = E.queries()["stream_windows_append"](spark, SMOKE).collect()
    late = [x for x in r if x.key == "late"]
    assert len(late) == 1 and late[0].n > 0
    assert sum(x.n for x in r) == spark.read.parquet(f"{SMOKE}/events.parquet").count()
    assert {x.closed for x in r if x.key != "late"} == {True, False}


def test_bundle_versions(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c", "d"], "s0") for i in range(20)], "doc_id long, tokens array<string>, slice string")
    cv, lda, _ = ML.fit_lda(docs.select("doc_id", "tokens"), k=2, vocab_size=10, min_df=1, max_df=1.0, max_iter=2)
    b = B.TopicBundle(cv, lda, spark.createDataFrame([("s0", 0)], "slice string, t long"))
    assert B.save(b, str(tmp_path)) == 1
    new = spark.createDataFrame([(1, ["a", "zzz"], "s0"), (2, [], "s9")], docs.schema)
    got = B.load(spark, str(tmp_path)).infer(new)
    want = {(r.doc_id, r.topic): r.weight for r in b.infer(new).collect()}
    assert {(r.doc_id, r.topic): r.weight for r in got.collect()} == pytest.approx(want)
    assert {(r.doc_id, r.t) for r in got.collect()} == {(1, 0), (2, None)}
    assert all(r.s == pytest.approx(1) or r.s == 0 for r in got.groupBy("doc_id").agg(F.sum("weight").alias("s")).collect())
