"""Edge cases of the column builders (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from growret.functions import stats
from growret.functions.periods import announcement_date, report_period, window_months
from growret.functions.returns import BIN_LABELS, bin_label, bin_order, entity_key, return_bins
from tests.helpers import ANNUAL, close

BIN_EDGE_CASES = [
    (-150.0, 0), (-100.0, 0), (-99.99, 1), (-90.0, 2), (-89.99, 2), (-10.0, 10), (-0.01, 10),
    (0.0, 11), (99.99, 11), (100.0, 12), (999.99, 20), (1000.0, 21), (None, 21),
]


def test_bin_edges(spark):
    df = spark.createDataFrame([(v,) for v, _ in BIN_EDGE_CASES], "r double")
    got = [r[0] for r in df.select(bin_order("r")).collect()]
    assert got == [b for _, b in BIN_EDGE_CASES]


def test_bin_labels_follow_order(spark):
    assert len(BIN_LABELS) == 22
    assert all(lab.startswith(f"{i:02d}.") for i, lab in enumerate(BIN_LABELS))
    df = spark.createDataFrame([(i,) for i in range(22)], "o int")
    assert [r[0] for r in df.select(bin_label("o")).collect()] == BIN_LABELS


def test_window_membership():
    w12, w13 = window_months(1998), window_months(1998, include_current_december=True)
    cases = {"086_11": (False, False), "086_12": (True, True), "087_01": (True, True),
             "087_11": (True, True), "087_12": (False, True), "088_01": (False, False)}
    for m, (a, b) in cases.items():
        assert (m in w12) == a and (m in w13) == b, m
    assert len(w12) == 12 and len(w13) == 13


def test_padded_minguo_years():
    # years before 2011 keep a three-digit Minguo year
    assert window_months(1998)[0] == "086_12"
    assert window_months(2024)[1] == "113_01"


def test_announcement_dates(spark):
    cases = {"087_01": dt.date(1998, 2, 10), "087_03": dt.date(1998, 4, 10),
             "087_11": dt.date(1998, 12, 10), "087_12": dt.date(1999, 1, 10), "113_12": dt.date(2025, 1, 10)}
    df = spark.createDataFrame([(k,) for k in cases], "report_month string")
    got = {r[0]: r[1] for r in df.select("report_month", announcement_date()).collect()}
    assert got == cases


def test_malformed_month_gives_null_period(spark):
    df = spark.createDataFrame([("87_1",), ("087_13",), ("abc",), ("087_05",)], "report_month string")
    got = [r[0] for r in df.select(report_period()).collect()]
    assert got == [None, None, None, dt.date(1998, 5, 1)]


def test_malformed_months_are_counted_and_match_no_window(spark):
    from growret.functions.periods import malformed_months, reporting_window

    df = spark.createDataFrame([("87_1",), ("087_13",), ("abc",), (None,), ("087_05",)], "report_month string")
    assert malformed_months(df).collect()[0].malformed_rows == 4
    assert [r.report_month for r in reporting_window(df, year=1998).collect()] == ["087_05"]


def test_entity_key_and_duplicate_suffix(spark):
    df = spark.createDataFrame(
        [("2330.TW", "1998", 10.0, 30.0, 20.0), ("2330.TWO", "1998", 10.0, 12.0, 11.0), ("99.TW", "1998", 0.0, 1.0, 1.0),
         ("77.TW", "1998", None, 1.0, 1.0)],
        ANNUAL,
    )
    assert [r[0] for r in df.select(entity_key("symbol")).collect()] == ["2330", "2330", "99", "77"]
    b = {r.symbol: (r.stock_id, r.annual_return, r.bin_order) for r in return_bins(df, year=1998).collect()}
    # both suffixes map to one entity; zero open is dropped; NULL open lands in the top bin
    assert b["2330.TW"] == ("2330", 100.0, 12) and b["2330.TWO"][0] == "2330"
    assert "99.TW" not in b
    assert b["77.TW"] == ("77", None, 21)


MOMENT_DATA = [1.0, 2.0, 4.0, 9.0, 20.0]


def _agg(spark, values, *cols):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]


def test_three_moment_conventions(spark):
    r = _agg(spark, MOMENT_DATA, F.skewness("x"), F.kurtosis("x"), stats.skew_bias_adjusted("x"),
             stats.kurt_bias_adjusted("x"), stats.skew_sample_std("x"), stats.kurt_sample_std("x"))
    expect = [0.999602864, -0.526142017, 1.490119970, 1.895431932, 0.715257586, -1.416730891]
    for got, want in zip(r, expect):
        assert close(got, want, 1e-8), (got, want)


@pytest.mark.parametrize(
    "values,skew_adj,kurt_adj,skew_s,kurt_s",
    [
        ([3.0], None, None, None, None),
        ([1.0, 2.0], None, None, 0.0, -2.75),
        ([1.0, 2.0, 4.0], 0.935219529, None, 0.207826562, -2.333333333),
        ([3.0, 3.0, 3.0, 3.0], 0.0, 0.0, 0.0, 0.0),
    ],
)
def test_small_and_constant_moments(spark, values, skew_adj, kurt_adj, skew_s, kurt_s):
    r = _agg(spark, values, stats.skew_bias_adjusted("x"), stats.kurt_bias_adjusted("x"),
             stats.skew_sample_std("x"), stats.kurt_sample_std("x"))
    assert close(r[0], skew_adj, 1e-8) and close(r[1], kurt_adj, 1e-8)
    assert close(r[2], skew_s, 1e-8) and close(r[3], kurt_s, 1e-8), (r[2], r[3])


def test_rounding_conventions(spark):
    df = spark.createDataFrame([(0.25,), (-0.25,), (1.005,), (0.35,)], "x double")
    up = [r[0] for r in df.select(stats.round_half_up("x", 1)).collect()]
    even = [r[0] for r in df.select(stats.round_half_even("x", 1)).collect()]
    assert up == [0.3, -0.3, 1.0, 0.4]
    assert even == [0.2, -0.2, 1.0, 0.4]
    assert df.select(stats.round_half_up("x", 2)).collect()[2][0] == 1.01
    inf = spark.createDataFrame([(float("inf"),)], "x double").select(stats.round_half_up("x", 2)).collect()[0][0]
    assert inf == float("inf")


def test_cv_and_positive_share(spark):
    r = _agg(spark, [-1.0, 1.0], stats.cv_heatmap("x"), stats.cv_signed("x"), stats.positive_share("x"))
    assert r[0] == 0.0 and r[1] is None and r[2] == 50.0
    r = _agg(spark, [5.0], stats.cv_heatmap("x"), stats.std("x"))
    assert r[0] is None and r[1] is None
