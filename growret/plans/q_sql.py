"""Registered queries written in SQL alone, over views and SQL functions."""

from __future__ import annotations

from growret.functions.sql import register_sql_functions
from growret.plans.params import METRIC, PRICE, YEAR
from growret.plans.q_heatmap import _CELL_DOUBLES, _CELL_ORDER, _cells_sql
from growret.plans.registry import register
from growret.plans.sqltext import window_in, with_fixtures
from growret.sources.sinks import register_views


def _sql(t, text: str, **args):
    spark = t["monthly_revenue"].sparkSession
    register_views(spark, {name: t[name] for name in t if name in text})
    register_sql_functions(spark)
    return spark.sql(text, args=args)


HEATMAP = f"""
WITH bins AS (
  SELECT symbol, entity_key(symbol) AS stock_id, pct_change({PRICE}, year_open) AS annual_return
  FROM stock_annual_k WHERE year = CAST(:year AS STRING) AND (year_open IS NULL OR year_open <> 0)
)
SELECT return_bin_label(return_bin(annual_return)) AS return_bin, return_bin(annual_return) AS bin_order, report_month,
       avg({METRIC}) AS val, count(DISTINCT symbol) AS stock_count, count({METRIC}) AS data_points,
       avg(annual_return) AS avg_annual_return, 'mean' AS stat_method, 'mean' AS stat_label
FROM bins JOIN monthly_revenue USING (stock_id)
WHERE report_month BETWEEN report_month_text(:year - 1, 12) AND report_month_text(:year, 11) AND length(report_month) = 6
  AND {METRIC} IS NOT NULL
GROUP BY ALL
ORDER BY bin_order, report_month
"""


@register("sql_heatmap_mean", _cells_sql("avg(m)", "mean", "mean"), doubles=_CELL_DOUBLES, order=_CELL_ORDER)
def _heatmap(t):
    return _sql(t, HEATMAP, year=YEAR)


ANNOUNCED = f"""
SELECT stock_id, report_month, report_period(report_month) AS period, announcement_date(report_month) AS announced
FROM monthly_revenue
WHERE report_month BETWEEN report_month_text(:year - 1, 12) AND report_month_text(:year, 11) AND length(report_month) = 6
"""
_FIRST_DAY = "make_date(CAST(left(report_month, 3) AS INTEGER) + 1911, CAST(right(report_month, 2) AS INTEGER), 1)"


@register(
    "sql_announcements",
    with_fixtures()
    + f"\nSELECT stock_id, report_month, {_FIRST_DAY} AS period, CAST({_FIRST_DAY} + INTERVAL 1 MONTH + INTERVAL 9 DAY AS DATE) AS announced"
    + f"\nFROM monthly_revenue WHERE {window_in(YEAR)}",
)
def _announced(t):
    return _sql(t, ANNOUNCED, year=YEAR)
