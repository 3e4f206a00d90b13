import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from growret.functions import periods as P
from growret.functions import returns as R
from growret.functions.sql import register_sql_functions
from growret.plans.registry import load_all
from growret.sources.store import model_tables
from tests.conftest import SF_SMALL


def test_sql_functions_equal_the_columns(spark):
    assert len(register_sql_functions(spark)) == 8
    edges = [e + d for e in (*R.DOWN_EDGES, *R.UP_EDGES) for d in (-0.5, 0.0, 0.5)]
    df = spark.createDataFrame([(float(x),) for x in edges] + [(None,), (float("nan"),), (float("inf"),)], "r double")
    df.createOrReplaceTempView("values_of_r")
    got = spark.sql("SELECT return_bin(r) AS b, return_bin_label(return_bin(r)) AS l, r FROM values_of_r")
    want = df.select(R.bin_order("r").alias("b"), R.bin_label(R.bin_order("r")).alias("l"), "r")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    months = spark.createDataFrame([(m,) for m in ("087_12", "087_01", "113_06", "87_1", "087_13", "abc", "", None)], "m string")
    months.createOrReplaceTempView("months")
    got = spark.sql("SELECT m, report_period(m) AS p, announcement_date(m) AS a FROM months").collect()
    want = months.select("m", P.report_period("m").alias("p"), P.announcement_date("m").alias("a")).collect()
    assert got == want and got[0].a == dt.date(1999, 1, 10)
    row = spark.sql("SELECT entity_key('12.TW') AS k, pct_change(3, 2) AS c, pct_change(3, 0) AS z, weekly_change(3, 0) AS w, report_month_text(1998, 1) AS t").first()
    assert tuple(row) == ("12", 50.0, None, None, "087_01")


def test_sql_queries_keep_pruning_and_have_no_calls_left(spark):
    plan = load_all()["sql_heatmap_mean"].build(model_tables(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "report_month" in plan.split("PartitionFilters")[1] + plan.split("PartitionFilters")[2]
    assert "return_bin(" not in plan and "Python" not in plan


def test_latest_date_explodes_nothing(spark):
    plan = load_all()["latest_date"].build(model_tables(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_previous_bars_of_a_hot_symbol(spark):
    """A third of all bars on one symbol: equal to one LAG, and no task sorts over twice the mean."""
    day = dt.date(1950, 1, 1)
    bars = [("hot.TW" if i % 3 == 0 else f"{i % 200}.TW", day + dt.timedelta(days=i), float(i % 7) if i % 11 else None, float(i)) for i in range(30_000)]
    rows = spark.createDataFrame(bars, "symbol string, date date, w_close double, w_high double")
    w = Window.partitionBy("symbol").orderBy("date")
    want = rows.select("symbol", "date", F.lag("w_close").over(w).alias("c"), F.lag("w_high").over(w).alias("h"))
    got = R.with_previous(rows).select("symbol", "date", F.col("prev_close").alias("c"), F.col("prev_high").alias("h"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    dealt = rows.repartition(16, "symbol", F.trunc("date", "month")).groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in dealt.collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16
