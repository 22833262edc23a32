"""Registered queries of the operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.llm import ann, chat, hardneg, html, licenses, merkle, mixing, packing, quality, simhash, suffixes, tokencount, toxicity
from lexiflow.llm.common import read

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op1_chat_formatting")
def op1(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_records(chat.records_from_turns(c.unionByName(own)), "record", "conv_id"))


@register("op2_permutation_index")
def op2(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return ann.search(e, e.where(F.col("vec_id") % 20 == 0), k=20)


@register("op3_license_scan")
def op3(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


@register("op4_best_fit_packing")
def op4(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@register("op5_mixing", mixing.ORACLE)
def op5(spark, sf_dir):
    m = mixing.systematic_copies(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@register("op6_token_counts")
def op6(spark, sf_dir):
    """Three edits per document: its first quarter's 12 code points give way to its source name,
    its language goes in the middle, and its last five code points are deleted."""
    d = read(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")

    def edit(start, stop, text):
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), text.alias("text"))

    quarter, half = F.floor(n / 4), F.floor(n / 2)
    edits = F.array(edit(quarter, quarter + 12, F.col("source")), edit(half, half, F.col("lang")), edit(n - 12, n + 100, F.lit("")))
    return tokencount.count_edited(d.select("doc_id", "text", edits.alias("edits")), "edits")


@register("op7_toxicity")
def op7(spark, sf_dir):
    return toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op8_html_extraction")
def op8(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages"))


@register("op9_quality_rules")
def op9(spark, sf_dir):
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op10_simhash_near_dedup")
def op10(spark, sf_dir):
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


@register("op11_hard_negatives", hardneg.ORACLE)
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


@register("op12_suffix_array_dedup")
def op12(spark, sf_dir):
    return suffixes.removal_report(read(spark, sf_dir, "documents"))


@register("op13_merkle_manifest", merkle.ORACLE)
def op13(spark, sf_dir):
    return merkle.audit(read(spark, sf_dir, "documents"))
