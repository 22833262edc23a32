from pyspark.sql import functions as F

from lexiflow.operators import sketch as K
from lexiflow.operators import tokens as T
from lexiflow.plans.q_vectors import text_docs

from conftest import SMOKE


def _df(spark):
    return T.document_frequency(text_docs(spark, SMOKE))


def test_cms_never_underestimates(spark):
    df = _df(spark)
    spec = K.cms_spec(0.05, 0.01)
    est = K.sketch_query(df, K.sketch_build(df, spec), spec)
    bad = df.join(est, "term").filter(F.col("estimate") < F.col("df")).count()
    assert bad == 0


def test_cs_exact_when_wide(spark):
    df = _df(spark)
    spec = K.SketchSpec("cs", 10_000_000, 5, (1, 2, 3, 4, 5), (6, 7, 8, 9, 10))
    est = K.sketch_query(df, K.sketch_build(df, spec), spec)
    assert df.join(est, "term").filter(F.col("estimate") != F.col("df")).count() == 0


def test_merge_equals_one_shot(spark):
    d = text_docs(spark, SMOKE)
    spec = K.cms_spec(0.05, 0.05)
    whole = K.sketch_build(T.document_frequency(d), spec)
    parts = [K.sketch_build(T.document_frequency(d.filter(c)), spec)
             for c in (F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 != 0)]
    merged = K.sketch_merge(parts, [spec, spec])
    assert whole.exceptAll(merged).count() == 0 and merged.exceptAll(whole).count() == 0


def test_merge_refuses_different_specs():
    import pytest
    with pytest.raises(ValueError):
        K.cms_spec(0.01, 0.01).check_mergeable(K.cms_spec(0.02, 0.01))


def test_sizing():
    assert (K.cms_spec().width, K.cms_spec().depth) == (27183, 5)
    assert (K.cs_spec().width, K.cs_spec().depth) == (10000, 5)


def test_bm25_idf_negative_for_common_terms(spark):
    x = spark.createDataFrame([(10.0,), (0.5,), (2.0,)], "p double")
    r = [row["w"] for row in x.select(K.sidf_weight(F.col("p"), F.lit(10), "bm25").alias("w")).collect()]
    assert r[0] < 0 and r[1] == 0.0 and r[2] > 0
