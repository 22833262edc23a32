"""Named queries over the driver tables: one per operator in the inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` and reads whole tables.
Fixed parameters below are chosen once and used at every scale factor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# Importing the modules fills QUERIES.
from lexiflow.plans import q_io, q_language, q_models, q_pairs, q_streams, q_text, q_topics, q_vectors  # noqa: E402,F401
