"""The corpus pipeline: each stage's rows are written as Parquet and reread by the next.

Toxicity, quality rules, SimHash near-dedup, mixing to target weights, packing.
The last stages repeat documents and place them by fitted plans, which SQL cannot
express, so ORACLE_SQL is None. The operators have tests of their own (see README); the
whole pipeline is not compared with brute force, only run for columns and rows.
"""

from __future__ import annotations

import uuid

from lexiflow.llm import mixing, packing, quality, simhash, toxicity
from lexiflow.llm.common import read, shared_dir


def stage_toxicity(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def stage_quality(spark, docs, sf_dir):
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def stage_simhash(spark, docs, sf_dir):
    return simhash.keep_one_per_component(docs)


def stage_mixing(spark, docs, sf_dir):
    return mixing.mix(docs)


def stage_packing(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality_rules", stage_quality),
    ("simhash_near_dedup", stage_simhash),
    ("mixing", stage_mixing),
    ("best_fit_packing", stage_packing),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
