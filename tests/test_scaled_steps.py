"""Steps that must not repeat work or meet in one task: cleaned texts, model features, dense vectors, streams."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lexiflow.functions.hashing import hash32
from lexiflow.operators import cleaning as C
from lexiflow.operators import embed as EM
from lexiflow.operators import models as ML
from lexiflow.operators import sketch as K
from lexiflow.plans.catalog import q_topics
from lexiflow.streaming import jobs as J

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture
def parted(spark, tmp_path):
    """The tables with the documents as a folder of several files."""
    for name in ("documents", "orders"):
        spark.read.parquet(f"{SMOKE}/{name}.parquet").repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["stream_clean", "stream_language_counts", "stream_sketch"])
def test_streams_read_a_file_and_a_folder_alike(spark, parted, name):
    q = E.queries()[name]
    got = rows(q(spark, parted))
    assert got and got == rows(q(spark, SMOKE))


def test_an_arrival_of_many_files_is_one_batch(spark, tmp_path):
    df = spark.range(40).withColumn("arrival", F.col("id") % 2).repartition(4)
    J.run_arrivals(df, "arrival", 2, str(tmp_path), lambda s: s, None)
    assert len([f for f in os.listdir(tmp_path / "in" / "arrival-0") if f.endswith(".parquet")]) > 1
    out = spark.read.parquet(f"{tmp_path}/out")
    assert [(r.batch_id, r.n) for r in out.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).orderBy("batch_id").collect()] == [(0, 20), (1, 20)]


def test_texts_are_cleaned_once(spark):
    plan = q_topics.topic_docs(spark, SMOKE, False).select("processed", F.explode("tokens"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("http") == 1
    d = spark.createDataFrame([(1, None), (2, "a")], "id int, x string")
    assert rows(C.with_once(d, "y", F.col("x"))) == rows(d.withColumn("y", F.col("x")))


def test_features_are_read_not_made_anew(spark):
    docs = spark.createDataFrame([(i, ["a", "b"]) for i in range(8)], "doc_id long, tokens array<string>")
    _, _, feats = ML.fit_lda(docs, k=2, vocab_size=5, min_df=1, max_df=1.0, max_iter=1)
    assert feats.inputFiles()


def test_embedding_lookups_equal_the_sketch_queries(spark):
    cms, cs = K.cms_spec(0.2, 0.1), K.cs_spec(0.2, 0.1)
    terms = spark.createDataFrame([(f"w{i}", i % 7 + 1) for i in range(60)], "term string, df long")
    built = [K.sketch_build(terms, s) for s in (cms, cs)]
    words = [f"w{i}" for i in range(80)]
    asked = spark.createDataFrame([(w,) for w in words], "term string")
    got = EM._looked_up(words, 42, 300, (cms, cs), [EM._dense_cells(c, s) for c, s in zip(built, (cms, cs))])
    bucket = {r.term: r.b for r in asked.select("term", (hash32("term", 42) % 300).alias("b")).collect()}
    want = [bucket, *({r.term: r.estimate for r in K.sketch_query(asked, c, s).collect()} for c, s in zip(built, (cms, cs)))]
    assert got.tolist() == [[float(x[w]) for w in words] for x in want]
