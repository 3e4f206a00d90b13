"""The training-data pipeline: five stages over ``documents``, each a stored table.

A stage is a function (spark, docs, sf_dir) -> DataFrame.  What it returns is
written as Parquet and read again as the next one's docs, so a lost executor
costs at most one stage.  All stages but the last return the input's columns.

1. toxicity: texts that the classifier chain calls toxic go.
2. near_dedup: one document of each near-duplicate group stays.
3. decontaminate: texts that hold a test item, exact or edited, go.
4. secrets: found secrets are replaced by a mark in the text; no row goes.
5. packing: sequences of token pieces, mixed by source.

Rows with nulls pass the filters unless a stage's rule names them; a repeated
row is a copy, and stage 2 leaves one (of rows with equal id and text that
differ elsewhere, the one whose other columns have the smallest hash).  Further
columns, whatever their names, pass through the first four stages untouched.  Rows without doc_id name no group; of
a group that has no other rows the texts of one shingle set stay.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.llm import decontaminate, near_dedup, packing, secrets, toxicity
from growret.llm.stored import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.corpus_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, chain).filter("NOT is_toxic").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_dedup.near_duplicates(docs).filter("kept").select("doc_id", "text_id").distinct()
    kept = kept.withColumnsRenamed({"doc_id": "_kept_id", "text_id": "_kept_text"})
    text_id = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (text_id == F.col("_kept_text"))
    left = docs.join(kept, same, "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not others:
        return left.distinct()
    one = left.groupBy("doc_id", "text").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_row"))
    return one.select("doc_id", "text", "_row.*").select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("matches") == 0).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


USED = ("doc_id", "text", "source")


def _others_aside(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """``stage`` with all columns that it doesn't use under names that clash with none of its own."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_other_{k}" for k, c in enumerate(docs.columns) if c not in USED}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in aside.items()})

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _others_aside(toxicity_stage)),
    ("near_dedup", _others_aside(near_dedup_stage)),
    ("decontaminate", _others_aside(decontaminate_stage)),
    ("secrets", _others_aside(secrets_stage)),
    ("packing", packing_stage),
]

#: The classifier and the packing have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
