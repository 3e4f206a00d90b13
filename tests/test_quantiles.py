"""The bucketed exact percentile against the built-in and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from growret.operators.quantiles import group_quantiles

PROBS = {"p0": 0.0, "q25": 0.25, "med": 0.5, "q75": 0.75, "p1": 1.0, "p37": 0.37}


def _frame(spark, seed=3, n=5000):
    rng = np.random.default_rng(seed)
    # one key holds most rows (a hot group), values repeat, some are NULL
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "b", "c"], n, p=[0.8, 0.15, 0.05]),
        "v": np.where(rng.random(n) < 0.05, np.nan, np.round(rng.normal(0, 10, n), 1)),
    })
    pdf.loc[pdf.index[:3], "g"] = "single"
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    return df, pdf


def test_equals_built_in_and_numpy(spark):
    df, pdf = _frame(spark)
    a = {r.g: r for r in group_quantiles(df, ["g"], "v", PROBS).collect()}
    b = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in PROBS.items()]).collect()}
    assert set(a) == set(b)
    for g, ra in a.items():
        vals = pdf.loc[pdf.g == g, "v"].dropna().to_numpy()
        for name, p in PROBS.items():
            assert ra[name] == pytest.approx(b[g][name], abs=1e-9)
            assert ra[name] == pytest.approx(np.percentile(vals, p * 100), abs=1e-9)


def test_values_of_all_sizes(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 1, 300) * 10.0 ** rng.integers(-14, 15, 300), [0.0, -0.0, 1e308, -1e308, 1e-320]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = group_quantiles(df, [], "v", PROBS).collect()[0]
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.percentile(v, p * 100), rel=1e-12)
    inf = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),), (float("nan"),)], "v double")
    got = group_quantiles(inf, [], "v", {"a": 0.0, "b": 1 / 3, "c": 2 / 3, "d": 1.0}).collect()[0]
    assert got.a == float("-inf") and got.b == 1.0 and got.c == float("inf") and np.isnan(got.d)


def test_ties_do_not_pile_up(spark):
    """A third of one group's rows are equal; after the collapse no task gets over twice the mean."""
    n = 60_000
    df = spark.range(n, numPartitions=8).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.rand(3) * 100).alias("v"))
    pairs = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")).repartition(16, "g", "v")
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = group_quantiles(df, ["g"], "v", {"q": 0.2, "m": 0.5}).collect()[0]
    vals = np.sort([r.v for r in df.collect()])
    assert got.q == 0.0 and got.m == pytest.approx(np.percentile(vals, 50), abs=1e-9)


def test_plan_rests_on_data_columns_only(spark):
    df, _ = _frame(spark)
    plan = group_quantiles(df, ["g"], "v", PROBS)._jdf.queryExecution().toString().lower()
    assert "monotonically" not in plan and "spark_partition_id" not in plan and "percentile" not in plan


def test_global_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "g string, v double")
    got = {r.g: r.med for r in group_quantiles(df, ["g"], "v", {"med": 0.5}).collect()}
    assert got == {None: 2.0, "a": 2.0}
    whole = group_quantiles(df, [], "v", {"med": 0.5}).collect()[0].med
    assert whole == 2.0


def test_all_null_group_absent(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    got = {r.g for r in group_quantiles(df, ["g"], "v", {"med": 0.5}).collect()}
    assert got == {"b"}


def test_crowded_values_are_split_further(spark, monkeypatch):
    """A million different values within one part in 2500, half of them crowded at one end."""
    from growret.operators import quantiles
    from growret.operators.quantiles import SIZE, narrowed

    ids = spark.range(1_000_000)
    for v, levels in ((1 + F.col("id") / 2.5e9, 1), (F.when(F.col("id") % 2 == 0, 1 + F.col("id") * 1e-15).otherwise(1 + F.col("id") / 2.5e9), 2)):
        monkeypatch.setattr(quantiles, "LEVELS", levels)
        df = ids.select(F.lit(0).alias("g"), v.alias("_v"))
        near = narrowed(df, ["g"], [0.25, 0.5, 0.75])
        parts = near.groupBy("g", *[f"_b{k}" for k in range(levels + 1)]).agg(F.countDistinct("_v").alias("n")).collect()
        assert 3 <= len(parts) <= 6 and max(r["n"] for r in parts) <= SIZE  # of 244 * SIZE
        got = group_quantiles(df, ["g"], "_v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
        want = df.select(F.percentile("_v", [0.25, 0.5, 0.75]).alias("p")).first()["p"]
        assert all(abs(x - y) < 1e-15 for x, y in zip(list(got)[1:], want))
