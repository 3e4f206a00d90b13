"""Relations between results that must hold whatever the data."""

from pyspark.sql import functions as F

from growret.operators import bursts as B
from growret.operators import heatmap as H
from growret.operators import timing as T
from growret.sources.sinks import write_csv
from growret.sources.store import model_tables
from tests.conftest import SF_MID

Y = 1998


def _t(spark):
    return model_tables(spark, SF_MID)


def test_heatmap_points_sum_to_joined_rows(spark):
    t = _t(spark)
    cells = H.heatmap_cells(t["stock_annual_k"], t["monthly_revenue"], year=Y, stat="mean")
    joined = H.binned_months(t["stock_annual_k"], t["monthly_revenue"], year=Y, metric="yoy_pct")
    assert cells.agg(F.sum("data_points")).collect()[0][0] == joined.count()


def test_exact_percentiles_agree_with_the_built_in_aggregate(spark):
    t = _t(spark)
    j = H.binned_months(t["stock_annual_k"], t["monthly_revenue"], year=Y, metric="yoy_pct")
    a = {(r.bin_order, r.report_month): r.val for r in
         H.heatmap_cells(t["stock_annual_k"], t["monthly_revenue"], year=Y, stat="iqr").collect()}
    iqr = F.percentile("m", F.lit(0.75)) - F.percentile("m", F.lit(0.25))
    b = {(r.bin_order, r.report_month): r.v for r in j.groupBy("bin_order", "report_month").agg(iqr.alias("v")).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_hit_counts_sum_to_joined_entities(spark):
    t = _t(spark)
    hits = B.burst_hits(t["monthly_revenue"], year=Y)
    dist = B.burst_distribution(hits, t["stock_annual_k"], year=Y)
    total = B.burst_totals(dist).collect()[0].total_stocks
    assert total == B.hit_returns(hits, t["stock_annual_k"], year=Y).count()


def test_range_pruned_study_equals_unpruned(spark):
    t = _t(spark)
    ev = T.first_bursts(t["monthly_revenue"], year=Y)
    from growret.functions.returns import weekly_returns

    pruned = T.event_study(ev, T.year_weekly_returns(t["stock_weekly_k"], year=Y))
    full = T.event_study(ev, weekly_returns(t["stock_weekly_k"]))
    assert pruned.count() == full.count() > 0
    assert pruned.exceptAll(full).count() == 0


def test_histogram_counts_sum_to_n(spark):
    t = _t(spark)
    ev = T.first_bursts(t["monthly_revenue"], year=Y)
    st = T.event_study(ev, T.year_weekly_returns(t["stock_weekly_k"], year=Y))
    h = T.stage_histogram(st).groupBy("stage").agg(F.sum("count").alias("c"))
    n = T.stage_means(st).select("stage", "n")
    assert h.join(n, "stage").filter(F.col("c") != F.col("n")).count() == 0


def test_csv_sink_round_trip(spark, tmp_path):
    t = _t(spark)
    cells = H.heatmap_cells(t["stock_annual_k"], t["monthly_revenue"], year=Y, stat="median")
    piv = H.heatmap_pivot(cells, year=Y)
    path = write_csv(piv, str(tmp_path / "heat"), single_file=True)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    assert back.columns == piv.columns and back.count() == piv.count()
