from pyspark.sql import functions as F

import __spark_entry__ as E

from conftest import SMOKE


def test_stream_sketch_equals_batch_build(spark):
    Q = E.queries()
    s = Q["stream_sketch"](spark, SMOKE)
    b = Q["cms_build"](spark, SMOKE)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stream_clean_equals_batch(spark):
    from lexiflow.functions import text as X
    from lexiflow.sources.tables import table
    s = E.queries()["stream_clean"](spark, SMOKE)
    d = table(spark, SMOKE, "documents").filter(F.col("lang") == "en")
    b = d.select("doc_id", X.clean_letters_normalized(F.col("text"), X.ALPHABET_ANY).alias("clean")) \
         .filter(F.length("clean") >= 15)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_detect_language_recovers_training_labels(spark):
    from lexiflow.operators.language import detect_language
    from lexiflow.sources.tables import table
    d = table(spark, SMOKE, "documents").select("doc_id", "text", "lang")
    r = detect_language(d, d.select("doc_id", "text")).join(d.select("doc_id", "lang"), "doc_id")
    acc = r.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert acc > 0.9
    empty = spark.createDataFrame([(1, "")], "doc_id long, text string")
    assert detect_language(d, empty).first()["language"] == "unknown"


def test_isolation_forest_contamination(spark):
    from lexiflow.operators.outliers import isolation_forest
    from lexiflow.sources.tables import vectors
    v = vectors(spark, SMOKE).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    lab = isolation_forest(v, n_trees=20, psi=64, contamination=0.1)
    n = lab.count()
    n_out = lab.filter("label = -1").count()
    assert n == v.count() and 0 < n_out <= 0.15 * n
