"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growret.llm.stored import stored


def components(edges: DataFrame) -> DataFrame:
    """``v, comp``: each vertex of ``edges(a, b)`` with the smallest vertex of its component.

    A round takes the least label among a vertex and its neighbours, then the
    label of that label, so a chain of n links takes about log n rounds.  Every
    round is a stored table; only the number of changed labels reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy(F.col("a").alias("w")).agg(F.min("comp").alias("near"))
        low = stored(
            labels.join(near, F.col("v") == F.col("w"), "left").select(
                "v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
            )
        )
        jump = low.select(F.col("v").alias("at"), F.col("comp").alias("further"))
        new = stored(low.join(jump, F.col("comp") == F.col("at")).select("v", "old", F.col("further").alias("comp")))
        if not new.filter(F.col("old") != F.col("comp")).limit(1).count():
            return new.select("v", "comp")
        labels = new.select("v", "comp")
