from pyspark.sql import functions as F

import __spark_entry__ as E
from lexiflow.operators import tokens as T
from lexiflow.plans.q_text import cleaned

from conftest import SMOKE


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["term", "df"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_result_independent_of_partitioning(spark):
    a = T.document_frequency(cleaned(spark, SMOKE))
    b = T.document_frequency(cleaned(spark, SMOKE).repartition(7))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_language_goldens_arithmetic(spark):
    # recorded statistics: 41,464 of 43,578 comments are 'ru' (95.15%)
    from lexiflow.operators.language import language_distribution
    rows = [("ru",)] * 41464 + [("uk",)] * 675 + [("en",)] * 266 + [("unknown",)] * 236 + [("xx",)] * 937
    df = spark.createDataFrame(rows, "language string")
    top = language_distribution(df).first()
    assert top["language"] == "ru" and top["n"] == 41464 and round(top["percent"], 2) == 95.15
