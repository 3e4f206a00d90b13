import math

ANNUAL = "symbol string, year string, year_open double, year_high double, year_close double"
REVENUE = "stock_id string, stock_name string, report_month string, yoy_pct double, mom_pct double, remark string"
WEEKLY = "symbol string, date date, w_close double, w_high double"
STUDY = (
    "stock_id string, stock_name string, report_month string, growth_val double, remark string, "
    "pre_month double, pre_week double, announce_week double, after_week_1 double, after_month double"
)


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, float) and math.isnan(b)
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def study_frame(spark, rows):
    """rows: list of (stock_id, {stage: value})"""
    out = []
    for i, (sid, vals) in enumerate(rows):
        out.append(
            (sid, f"name{sid}", f"087_{(i % 12) + 1:02d}", 150.0, None,
             vals.get("pre_month"), vals.get("pre_week", 0.0), vals.get("announce_week"),
             vals.get("after_week_1"), vals.get("after_month"))
        )
    return spark.createDataFrame(out, STUDY)
