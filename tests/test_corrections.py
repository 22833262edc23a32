"""Hand-computed answers of operators that read bytes, number rows or score classes."""

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import models as ML
from lexiflow.operators import pairs as W
from lexiflow.operators import vectors as N
from lexiflow.operators.cleaning import number_rows, rank_rows, stratified_split
from lexiflow.sources import files as S
from lexiflow.sources.tables import comments
SMOKE = "/root/testdata/sf0.001"


def test_bad_bytes_are_left_out_and_own_marks_kept(spark, tmp_path):
    own = "a�b﷐c﷐a"
    (tmp_path / "bad.txt").write_bytes(b"ab\xffcd\xc3 e\xe2\x82")
    (tmp_path / "own.txt").write_bytes(own.encode())
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.text) for r in S.scan_text_documents(spark, str(tmp_path)).collect()}
    assert got == {"bad.txt": (10, "abcd e"), "own.txt": (len(own.encode()), own)}


def test_macro_f1(spark):
    pred = [(0.0, 0.0)] * 9 + [(1.0, 0.0)]
    got = {r.metric: r.value for r in ML.classification_scores(spark.createDataFrame(pred, "label double, prediction double")).collect()}
    assert got == pytest.approx({"accuracy": 0.9, "macro_f1": (18 / 19 + 0) / 2})


def test_batches_hold_n_files(spark):
    ids = [-5, 3, 7, 70000, 70001, 200000, 9000000000]
    f = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert {r.doc_id: r._n for r in number_rows(f, "doc_id").collect()} == {d: n for n, d in enumerate(ids)}
    assert {r.doc_id: r.batch_id for r in W.file_batches(f, 3).collect()} == {d: n // 3 for n, d in enumerate(ids)}


def test_rank_rows_within_groups(spark):
    rows = [(g, v, 1) for g in ("a", "b", None) for v in (None, 5, 5, -3, 1 << 60)] + [("hot", i % 7, i) for i in range(500)]
    got = rank_rows(spark.createDataFrame(rows, "g string, v long, x int").repartition(5), ["v"], ["g"]).collect()
    assert sorted((r.g or "", r.v or 0, r.x) for r in got) == sorted((g or "", v or 0, x) for g, v, x in rows)
    for g in ("a", "b", None, "hot"):
        mine = sorted(((r._n, r.v) for r in got if r.g == g))
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted((v for _, v in mine), key=lambda v: (v is not None, v))
    assert rank_rows(spark.createDataFrame([], "g string, v long"), ["v"], ["g"]).count() == 0


def test_null_ids_are_numbered(spark):
    f = spark.createDataFrame([(None,), (3,), (None,), (1,)], "doc_id long")
    assert sorted(((r._n, r.doc_id) for r in number_rows(f, "doc_id").collect())) == [(0, None), (1, None), (2, 1), (3, 3)]


def test_split_keeps_null_strata(spark):
    rows = [(i, None if i % 5 == 0 else "s") for i in range(50)] + [(None, "s")]
    got = stratified_split(spark.createDataFrame(rows, "id long, stratum string"), "stratum", "id", 0.2).collect()
    assert len(got) == 51 and sum(r.split == "test" and r.stratum is None for r in got) == 2
    assert sum(r.split == "test" for r in got if r.stratum == "s") == 8


def test_sample_pairs_are_as_many_as_asked(spark):
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    got = N.sample_pairs(ids, 1000).collect()
    assert len(got) == 1000 and all(r.i != r.j for r in got)
    assert len({r.i for r in got}) > 150 and len({r.j for r in got}) > 150
    assert N.sample_pairs(ids.limit(1), 10).count() == 0


def test_knn_goes_block_by_block(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    want = sorted(N.knn(v, [1, 4, 6], 2).collect())
    monkeypatch.setattr(N, "MAX_QUERIES", 2)
    assert sorted(N.knn(v, [1, 4, 6], 2).collect()) == want


def test_untimed_comments_scan_no_orders(spark, capsys):
    comments(spark, SMOKE, with_time=False).select("doc_id", F.length("comment")).explain()
    plan = capsys.readouterr().out
    assert "o_orderkey" not in plan and "Join" not in plan


def test_table_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert S.load_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert len(built) == 1
