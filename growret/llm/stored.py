"""Intermediate tables in the session's shared checkpoint folder.

A stored table cuts the lineage: a lost executor re-reads files that all
executors share, and two readers see the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from growret.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
