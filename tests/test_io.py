from pyspark.sql import functions as F

import __spark_entry__ as E
from lexiflow.sources.tables import comments

from conftest import SMOKE


def test_csv_round_trip_keeps_multiline_texts(spark):
    back = E.queries()["scan_comments"](spark, SMOKE)
    orig = comments(spark, SMOKE).select("doc_id", "comment", "published_at", "language", "platform")
    assert back.exceptAll(orig).count() == 0 and orig.exceptAll(back).count() == 0


def test_persisted_sketch_answers_like_the_built_one(spark):
    q = E.queries()
    a, b = q["persist_sketch"](spark, SMOKE), q["cms_query"](spark, SMOKE)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_jsonlines_keeps_missing_labels_null(spark):
    r = {row["label"]: row["n"] for row in E.queries()["scan_jsonlines"](spark, SMOKE).collect()}
    assert None in r and sum(r.values()) == 200


def test_one_text_file_per_document(spark):
    r = E.queries()["scan_text_documents"](spark, SMOKE)
    assert r.count() == 200 and r.filter(F.col("size") <= 0).count() == 0
