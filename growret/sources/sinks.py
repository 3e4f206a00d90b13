"""CSV sinks (K1-K3) and SQL views over the model tables.

The reference hands one CSV file to a browser.  Here results are written by
the executors as a CSV folder (one part file per partition, UTF-8, header);
``single_file=True`` coalesces to one partition first, which is only
sensible for the small report frames the sinks are meant for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, *, single_file: bool = False, mode: str = "overwrite") -> str:
    """Any result frame -- heatmap matrix (K1), burst list (K2), event rows (K3) -- as a CSV folder."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Expose the model tables to ``spark.sql(text, args={...})`` with bound
    parameters instead of text pasted into the statement."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
