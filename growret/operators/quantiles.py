"""Exact group percentiles that survive hot groups and ties.

``percentile_cont`` per group.  Spark's built-in ``percentile`` merges a value
-> count map per group in one task, so a group with a third of all rows lands
in one task's memory.  Here, for inputs of any size:

1. each value has a bucket, a steadily rising function of the value alone:
   about ``PER_E`` buckets for each factor e of its size.  Counts per (group,
   bucket), combined before the shuffle, are a small table whose running sums
   say which buckets hold the rank below and above each wanted percentile;
2. a bucket adapts: one with more than ``SIZE`` values is split again into
   ``PARTS`` equal parts between its own least and greatest value, ``LEVELS``
   times, and only the parts that hold a wanted rank go on.  A bucket of step 1
   has 2**42 doubles at most, so each level leaves 2**14 times fewer of them,
   however the values crowd;
3. only those values are counted and ranked, and the ranks give
   ``lo + (p(n-1) - floor) * (hi - lo)``.  A million ties are one row.

Everything rests on columns of the data: no partition or row ids, no stored
intermediate, and no job while the plan is built.  What is shuffled are counts
per bucket and the few values ranked, never all values.  ``approx`` is the
mergeable sketch ``percentile_approx``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("exact", "approx")
PER_E = 1024
#: Values nearer to zero than this share the middle bucket.
SMALLEST = 1e-9
SIZE, PARTS, LEVELS = 4096, 1 << 14, 1


def _check(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")


def _bucket(v: Column) -> Column:
    """Rises with v; infinities have buckets of their own, NaN is the largest value as in Spark's order."""
    x = F.signum(v) * F.log1p(F.abs(v) / SMALLEST) * PER_E
    inf = F.lit(float("inf"))
    return (
        F.when(F.isnan(v), F.lit(1 << 41))
        .when(v == inf, F.lit(1 << 40))
        .when(v == -inf, F.lit(-(1 << 40)))
        .otherwise(F.floor(x))
    )


def _over(keys: list[str], *more: str):
    names = [*keys, *more]
    return Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))


def _same(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in names])


def narrowed(base: DataFrame, keys: list[str], probs: list[float], size: int | None = None) -> DataFrame:
    """The rows ``keys, _v`` whose buckets hold a rank that ``probs`` need.

    With them their bucket of each level ``_b0``, ``_b1``..., ``_first``, the
    values of the group before the last bucket, and ``_n``, all its values.
    """
    size = SIZE if size is None else size

    def holds(first: Column, count: Column) -> Column:
        ranks = [edge(F.lit(float(p)) * (F.col("_n") - 1)) for p in probs for edge in (F.floor, F.ceil)]
        return reduce(lambda a, b: a | b, [(r >= first) & (r < first + count) for r in ranks])

    placed_rows = base.withColumn("_b0", _bucket(F.col("_v")))
    rows, by = placed_rows.withColumns({"_first": F.lit(0).cast("long"), "_n": F.lit(None).cast("long")}), []
    for level in range(LEVELS + 1):
        bounds = [f"_{x}{k}" for k in range(level) for x in ("lo", "hi", "c")]  # of the levels before
        name = f"_b{level}"
        per = rows.groupBy(*keys, *by, name).agg(
            F.count(F.lit(1)).alias(f"_c{level}"), F.min("_v").alias(f"_lo{level}"), F.max("_v").alias(f"_hi{level}"),
            *[F.max(c).alias(c) for c in (*bounds, "_first", "_n")],
        )
        count = F.col(f"_c{level}")
        running = _over(keys, *by).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        placed = per.withColumn("_first", F.col("_first") + F.coalesce(F.sum(count).over(running), F.lit(0)))
        placed = placed.withColumn("_n", F.coalesce("_n", F.sum(count).over(_over(keys, *by))))
        by = [*by, name]
        wanted = placed.filter(holds(F.col("_first"), count)).withColumnsRenamed({c: f"_w_{c}" for c in (*keys, *by)})
        # the rows again, each bucket found from the bounds that its own bucket before had
        rows = placed_rows.join(wanted, _same([*keys, "_b0"]))
        for k in range(level + 1):
            share = (F.col("_v") - F.col(f"_lo{k}")) / (F.col(f"_hi{k}") - F.col(f"_lo{k}"))
            split = (F.col(f"_c{k}") > size) & (F.col(f"_hi{k}") > F.col(f"_lo{k}"))
            rows = rows.withColumn(f"_b{k + 1}", F.when(split, F.floor(share * PARTS)).otherwise(F.lit(0).cast("long")))
            if k < level:
                rows = rows.filter(F.col(f"_b{k + 1}") == F.col(f"_w__b{k + 1}"))
        rows = rows.drop(*[f"_w_{c}" for c in (*keys, *by)])
    return rows.select(*keys, *by, "_v", "_first", "_n")


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    probs: dict[str, float],
    *,
    strategy: str = "exact",
    accuracy: int = 10_000,
) -> DataFrame:
    """keys..., one column per entry of ``probs`` (name -> percentile in [0, 1]).

    NULL values are ignored; groups without any value are absent (without
    keys: one row of NULLs).
    """
    _check(strategy)
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*keys, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if strategy == "approx":
        aggs = [F.percentile_approx("_v", F.lit(p), accuracy).alias(name) for name, p in probs.items()]
        return base.groupBy(*keys).agg(*aggs) if keys else base.agg(*aggs)

    near = narrowed(base, keys, list(probs.values()))
    buckets = [c for c in near.columns if c.startswith("_b")]
    counted = near.groupBy(*keys, *buckets, "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_first").alias("_first"), F.max("_n").alias("_n")
    )
    within = _over(keys, *buckets).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_at", F.col("_first") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
    aggs, outs = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (rank >= F.col("_at")) & (rank < F.col("_at") + F.col("_c"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{name}"))
        lo, hi, share = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), at - F.floor(at)
        outs.append(F.when(lo == hi, lo).otherwise(lo + share * (hi - lo)).alias(name))
    g = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs) if keys else ranked.agg(F.max("_n").alias("_n"), *aggs)
    return g.select(*keys, *outs)


def grouped_with_quantiles(
    df: DataFrame,
    keys: list[str],
    aggs: list[Column],
    value: str | Column,
    probs: dict[str, float],
    *,
    strategy: str = "exact",
) -> DataFrame:
    """keys, ``aggs`` and the percentile columns of ``probs`` per group.

    The sketch joins the other aggregates in one aggregation; the exact
    percentiles are joined on the keys (both sides have one row per group).
    """
    _check(strategy)
    v = F.col(value) if isinstance(value, str) else value
    if strategy == "approx":
        both = [*aggs, *[F.percentile_approx(v, F.lit(p), 10_000).alias(name) for name, p in probs.items()]]
        return df.groupBy(*keys).agg(*both) if keys else df.agg(*both)
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    q = group_quantiles(df, keys, v, probs)
    if not keys:
        return g.withColumn("_one", F.lit(0)).join(q.withColumn("_one", F.lit(0)), "_one", "left").drop("_one")
    named = q.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return g.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])
