"""Operator semantics on literal frames (FIXTURES.md section 3)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from growret.operators import bursts as B
from growret.operators import heatmap as H
from growret.operators import timing as T
from tests.helpers import ANNUAL, REVENUE, WEEKLY, close, study_frame


def test_stage_edges(spark):
    base = dt.date(1998, 4, 10)  # report 087_03
    offsets = [-39, -38, -10, -9, -3, -2, 4, 5, 11, 12, 30, 31]
    expect = [None, "pre_month", "pre_month", "pre_week", "pre_week", "announce_week", "announce_week",
              "after_week_1", "after_week_1", "after_month", "after_month", None]
    events = spark.createDataFrame(
        [("000001", "n", "087_03", 150.0, None, base)],
        "stock_id string, stock_name string, report_month string, growth_val double, remark string, base_date date",
    )
    for off, stage in zip(offsets, expect):
        d = base + dt.timedelta(days=off)
        wret = spark.createDataFrame([("000001.TW", "000001", d, 1.0), ("000001.TW", "000001", base - dt.timedelta(days=5), 7.0)],
                                     "symbol string, stock_id string, date date, weekly_ret double")
        rows = T.event_study(events, wret).collect()
        r = rows[0]
        got = {s: r[s] for s in T.STAGE_NAMES}
        assert got["pre_week"] == 7.0 or stage == "pre_week"
        if stage is None:
            assert all(v is None for k, v in got.items() if k != "pre_week")
        else:
            want = 4.0 if stage == "pre_month" else 1.0
            if stage == "pre_week":
                assert got["pre_week"] == 4.0  # mean of 1 and 7
            else:
                assert got[stage] == want, (off, stage, got)


def test_event_without_pre_week_is_dropped(spark):
    events = spark.createDataFrame(
        [("000001", "n", "087_03", 150.0, None, dt.date(1998, 4, 10))],
        "stock_id string, stock_name string, report_month string, growth_val double, remark string, base_date date",
    )
    wret = spark.createDataFrame([("000001.TW", "000001", dt.date(1998, 4, 12), 1.0)],
                                 "symbol string, stock_id string, date date, weekly_ret double")
    assert T.event_study(events, wret).count() == 0


def test_first_crossing(spark):
    months = ["086_12", "087_01", "087_02", "087_03", "087_04", "087_05"]
    growth = [120.0, 150.0, 50.0, 100.0, None, 130.0]
    rev = spark.createDataFrame([("1", "acme", m, g, 0.0, "x") for m, g in zip(months, growth)], REVENUE)
    got = sorted(r.report_month for r in T.first_bursts(rev, year=1998, threshold=100).collect())
    assert got == ["087_03", "087_05"]
    # keyword: a NULL name and remark never match, even the empty keyword
    rev2 = spark.createDataFrame([("2", None, "087_01", 150.0, 0.0, None)], REVENUE)
    assert T.first_bursts(rev2, year=1998, threshold=100).count() == 0


def test_lag_is_previous_row(spark):
    # a gap month does not reset the previous value
    rev = spark.createDataFrame([("1", "a", "087_01", 150.0, 0.0, "r"), ("1", "a", "087_04", 160.0, 0.0, "r")], REVENUE)
    assert [r.report_month for r in T.first_bursts(rev, year=1998, threshold=100).collect()] == ["087_01"]


def test_weekly_returns_lag_and_cut(spark):
    wk = spark.createDataFrame(
        [("1.TW", dt.date(1998, 1, 5), 10.0, 11.0), ("1.TW", dt.date(1998, 1, 12), 12.0, 13.0),
         ("1.TW", dt.date(1998, 3, 2), 0.0, 1.0), ("1.TW", dt.date(1998, 3, 9), 5.0, 6.0)],
        WEEKLY,
    )
    from growret.functions.returns import weekly_returns

    r = [x.weekly_ret for x in weekly_returns(wk).orderBy("date").collect()]
    assert r[0] is None and close(r[1], 20.0) and close(r[2], -100.0) and r[3] is None  # previous 0 -> NULL
    high = [x.weekly_ret for x in weekly_returns(wk, price="w_high").orderBy("date").collect()]
    assert close(high[1], 200.0 / 11.0)
    cut = weekly_returns(wk, until=dt.date(1998, 1, 31)).count()
    assert cut == 2
    # a window that starts after a gap still sees the true previous bar
    late = [(x.date, x.weekly_ret) for x in weekly_returns(wk, since=dt.date(1998, 3, 9)).collect()]
    assert late == [(dt.date(1998, 3, 9), None)]  # previous close 0 -> NULL, not "no previous"
    mid = [x.weekly_ret for x in weekly_returns(wk, since=dt.date(1998, 1, 12)).orderBy("date").collect()]
    assert close(mid[0], 20.0) and close(mid[1], -100.0)


def test_fixed_bin_distribution(spark):
    st = study_frame(spark, [(str(i), {"pre_month": v}) for i, v in enumerate([-5.0, -1.0, 1.0, 5.0, 7.0])])
    d = [r for r in T.stage_distribution(st).collect() if r.stage == "pre_month"]
    assert [(r.bucket, r["count"]) for r in d] == [(1, 1), (2, 1), (3, 1), (4, 2)]
    assert close(sum(r.pct for r in d), 100.0)


@pytest.mark.parametrize(
    "values",
    [list(np.linspace(-13.7, 42.1, 26)), [3.0, 3.0, 3.0], [2.5], list(np.random.default_rng(5).normal(0, 7, 300))],
)
def test_histogram_matches_numpy(spark, values):
    st = study_frame(spark, [(str(i), {"after_month": float(v)}) for i, v in enumerate(values)])
    h = [r for r in T.stage_histogram(st).collect() if r.stage == "after_month"]
    counts, edges = np.histogram(np.array(values), bins=25)
    assert [r["count"] for r in h] == list(counts)
    assert all(close(r.bin_lo, edges[i]) and close(r.bin_hi, edges[i + 1]) for i, r in enumerate(h))
    assert sum(r["count"] for r in h) == len(values)


def test_outliers(spark):
    few = study_frame(spark, [(str(i), {"after_month": v}) for i, v in enumerate([1.0, 2.0, 100.0])])
    assert T.stage_outliers(few, stage="after_month").count() == 0
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    st = study_frame(spark, [(str(i), {"after_month": v}) for i, v in enumerate(vals)])
    out = [r.ret for r in T.stage_outliers(st, stage="after_month").collect()]
    assert out == [100.0]
    # q25 = 2, q75 = 4, upper fence = 7: a value on the fence is not an outlier
    fence = study_frame(spark, [(str(i), {"after_month": v}) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 7.0])])
    q = np.percentile([1.0, 2.0, 3.0, 4.0, 7.0], [25, 75])
    assert q[1] + 1.5 * (q[1] - q[0]) > 7.0 or T.stage_outliers(fence, stage="after_month").count() == 0


def test_stage_stats_convention(spark):
    vals = [1.0, 2.0, 4.0, 9.0, 20.0]
    st = study_frame(spark, [(str(i), {"announce_week": v, "pre_week": v}) for i, v in enumerate(vals)])
    r = [x for x in T.stage_stats(st).collect() if x.stage == "announce_week"][0]
    assert r.skew == 1.49 and r.kurtosis == 1.895 and r.data_points == 5
    assert r.win_rate == 100.0 and r.left_tail == 0 and r.tail_ratio == float("inf")
    assert r.skew_class == "right skewed" and r.kurtosis_class == "normal tails"
    means = {x.stage: x for x in T.stage_means(st).collect()}
    assert means["pre_month"].n == 0 and means["pre_month"].mean == 0.0  # empty stage -> zeros
    assert means["announce_week"].median == 4.0


def test_latest_remark_and_drilldown(spark):
    rev = spark.createDataFrame(
        [("1", "acme", "087_01", 10.0, 1.0, "old"), ("1", "acme", "087_05", 20.0, 2.0, "new"),
         ("1", "acme", "087_07", 30.0, 3.0, "-"), ("1", "acme", "087_08", 40.0, 4.0, ""),
         ("1", "acme", "087_09", 50.0, 5.0, None), ("2", None, "087_01", 1.0, 1.0, None)],
        REVENUE,
    )
    lr = {r.stock_id: r.remark for r in H.latest_remark(rev, year=1998).collect()}
    assert lr == {"1": "new"}
    ann = spark.createDataFrame([("1.TW", "1998", 10.0, 20.0, 15.0), ("2.TW", "1998", 10.0, 20.0, 15.0)], ANNUAL)
    d = H.bin_drilldown(ann, rev, year=1998, bin_order=11).collect()
    assert [r.stock_id for r in d] == ["1"]  # entity 2 has neither name nor remark
    assert d[0].annual_return == 50.0 and d[0].yoy_mean == 30.0 and d[0].latest_remark == "new"


def test_burst_list_remarks_and_scores(spark):
    rev = spark.createDataFrame(
        [("1", "acme", "087_01", 150.0, 0.0, "b"), ("1", "acme", "087_02", 160.0, 0.0, "a"),
         ("1", "acme", "087_03", 10.0, 0.0, "b"), ("1", "acme", "087_12", 10.0, 0.0, "-"),
         ("2", "beta", "087_01", 150.0, 0.0, ""), ("2", "beta", "087_02", 150.0, 0.0, None)],
        REVENUE,
    )
    ann = spark.createDataFrame([("1.TW", "1998", 10.0, 20.0, 30.0), ("2.TW", "1998", 10.0, 20.0, 5.0)], ANNUAL)
    hits = B.burst_hits(rev, year=1998, low=100, high=1000)
    bl = {r.stock_id: r for r in B.burst_list(hits, ann, rev, year=1998, n_hits=2).collect()}
    assert bl["1"].remarks == "a | b" and bl["2"].remarks is None
    assert bl["1"].avg_growth == 82.5  # 13-month window includes December
    dist = B.burst_distribution(hits, ann, year=1998)
    r = dist.collect()[0]
    assert r.hits == 2 and r.stock_count == 2 and r.mean_ret == 75.0 and r.std_ret == 176.8
    one = B.burst_distribution(hits.filter(F.col("stock_id") == "1"), ann, year=1998)
    s = B.burst_scores(one).collect()[0]
    assert s.risk_score == 0.0 and s.ev_score == 2.0  # std NULL for a single entity -> risk 0
    alt = B.burst_distribution(hits.filter(F.col("stock_id") == "1"), ann, year=1998, single_std_zero=True, half_even=True)
    assert alt.collect()[0].std_ret == 0.0
