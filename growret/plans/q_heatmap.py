"""Registered heatmap queries (survey section 3.1) and their oracle text."""

from __future__ import annotations

from pyspark.sql import functions as F

from growret.functions.periods import date_text, reporting_window, window_months
from growret.functions.returns import return_bins
from growret.operators import heatmap as H
from growret.plans.params import DOWN_BIN, DRILL_BIN, DRILL_TOP, KEYWORD, METRIC, PRICE, YEAR
from growret.plans.registry import register
from growret.plans.sqltext import (
    annual_cte,
    binned_months_cte,
    bins_cte,
    label_case,
    r_half_up,
    window_in,
    with_fixtures,
)

Y = YEAR
LABEL = label_case("bin_order")


# -- S5, X15 -----------------------------------------------------------------
@register(
    "latest_date",
    with_fixtures() + "\nSELECT strftime(max(date), '%Y-%m-%d') AS latest_date FROM stock_prices",
)
def _latest_date(t):
    days = t["price_days"] if "price_days" in t else t["stock_prices"]
    return days.agg(date_text(F.max("date")).alias("latest_date"))


# -- F1-F5, Q3 ---------------------------------------------------------------
@register(
    "annual_returns",
    with_fixtures(annual_cte("ab", Y, PRICE)) + "\nSELECT symbol, stock_id, year, annual_return FROM ab",
    doubles=("annual_return",),
)
def _annual_returns(t):
    from growret.functions.returns import annual_returns

    return annual_returns(t["stock_annual_k"], year=Y, price=PRICE)


@register(
    "return_bins",
    with_fixtures(bins_cte(Y, "year_high"))
    + f"\nSELECT symbol, stock_id, year, annual_return, bin_order, {LABEL} AS return_bin FROM bins",
    doubles=("annual_return",),
)
def _return_bins(t):
    return return_bins(t["stock_annual_k"], year=Y, price="year_high")


@register(
    "return_bins_known",
    with_fixtures(bins_cte(Y, PRICE))
    + f"\nSELECT symbol, stock_id, year, annual_return, bin_order, {LABEL} AS return_bin FROM bins WHERE annual_return IS NOT NULL",
    doubles=("annual_return",),
)
def _return_bins_known(t):
    return return_bins(t["stock_annual_k"], year=Y, price=PRICE, null_bin="drop")


# -- F7-F10, X13 -------------------------------------------------------------
_RW_COLS = "stock_id, stock_name, report_month, yoy_pct, mom_pct, remark"


@register(
    "reporting_window_12",
    with_fixtures() + f"\nSELECT {_RW_COLS} FROM monthly_revenue WHERE {window_in(Y)}",
    doubles=("yoy_pct", "mom_pct"),
)
def _rw12(t):
    return reporting_window(t["monthly_revenue"], year=Y)


@register(
    "reporting_window_13",
    with_fixtures() + f"\nSELECT {_RW_COLS} FROM monthly_revenue WHERE {window_in(Y, include_current_december=True)}",
    doubles=("yoy_pct", "mom_pct"),
)
def _rw13(t):
    return reporting_window(t["monthly_revenue"], year=Y, include_current_december=True)


# -- heatmap cells: J1, G1-G15, F13, F24, C5, O1 ----------------------------
_CELL_TAIL = """count(DISTINCT symbol) AS stock_count, count(m) AS data_points,
       avg(annual_return) AS avg_annual_return"""


def _cells_sql(val: str, stat: str, label: str, metric: str = METRIC, price: str = PRICE, moments: bool = False) -> str:
    ctes = [binned_months_cte(Y, metric, price)]
    src = "j"
    if moments:
        ctes.append(
            """jm AS (SELECT j.*, avg(m) OVER (PARTITION BY bin_order, report_month) AS mu,
       stddev_samp(m) OVER (PARTITION BY bin_order, report_month) AS sd FROM j)"""
        )
        src = "jm"
    return with_fixtures(*ctes) + f"""
SELECT {LABEL} AS return_bin, bin_order, report_month, {val} AS val,
       {_CELL_TAIL}, '{stat}' AS stat_method, '{label}' AS stat_label
FROM {src} GROUP BY bin_order, report_month"""


_CELL_DOUBLES = ("val", "avg_annual_return")
_CELL_ORDER = "bin_order, report_month"
_STAT_SQL = {
    "median": ("quantile_cont(m, 0.5)", "median", False),
    "mean": ("avg(m)", "mean", False),
    "std": ("stddev_samp(m)", "std", False),
    "cv": ("CASE WHEN avg(m) = 0 THEN 0 ELSE stddev_samp(m) / abs(avg(m)) * 100 END", "cv_pct", False),
    "skew": ("CASE WHEN max(sd) = 0 THEN 0 ELSE avg(power((m - mu) / sd, 3)) END", "skew", True),
    "kurt": ("CASE WHEN max(sd) = 0 THEN 0 ELSE avg(power((m - mu) / sd, 4)) - 3 END", "kurtosis", True),
    "iqr": ("quantile_cont(m, 0.75) - quantile_cont(m, 0.25)", "iqr", False),
    "positive": ("count_if(m > 0) * 100.0 / count(*)", "positive_pct", False),
}
_STAT_NAME = {"kurt": "kurtosis"}


def _make_cells(key_stat: str):
    stat = _STAT_NAME.get(key_stat, key_stat)
    val, label, moments = _STAT_SQL[key_stat]

    @register(f"heatmap_{key_stat}", _cells_sql(val, stat, label, moments=moments), doubles=_CELL_DOUBLES, order=_CELL_ORDER)
    def _q(t):
        return H.heatmap_cells(t["stock_annual_k"], t["monthly_revenue"], year=Y, metric=METRIC, stat=stat, price=PRICE)


for _s in _STAT_SQL:
    _make_cells(_s)


@register(
    "heatmap_high_mom",
    _cells_sql("quantile_cont(m, 0.5)", "median", "median", metric="mom_pct", price="year_high"),
    doubles=_CELL_DOUBLES,
    order=_CELL_ORDER,
)
def _cells_high_mom(t):
    return H.heatmap_cells(t["stock_annual_k"], t["monthly_revenue"], year=Y, metric="mom_pct", stat="median", price="year_high")


def _median_cells(t):
    return H.heatmap_cells(
        t["stock_annual_k"], t["monthly_revenue"], year=Y, metric=METRIC, stat="median", price=PRICE, ordered=False
    )


def _cell_counts(t):
    return H.cell_counts(t["stock_annual_k"], t["monthly_revenue"], year=Y, metric=METRIC, price=PRICE)


# -- V1 ------------------------------------------------------------------------
_MONTHS = window_months(Y)
_PIVOT_COLS = ",\n       ".join(f"max(CASE WHEN report_month = '{m}' THEN val END) AS m{m}" for m in _MONTHS)


@register(
    "heatmap_pivot",
    with_fixtures(binned_months_cte(Y, METRIC, PRICE))
    + f""",
cells AS (SELECT bin_order, report_month, quantile_cont(m, 0.5) AS val FROM j GROUP BY bin_order, report_month)
SELECT bin_order, {LABEL} AS return_bin,
       {_PIVOT_COLS}
FROM cells GROUP BY bin_order""",
    doubles=tuple(f"m{m}" for m in _MONTHS),
    order="bin_order",
)
def _pivot(t):
    return H.heatmap_pivot(_median_cells(t), year=Y)


# -- G16, G5, G8, G9, G13, O2, O9 --------------------------------------------
_SUMMARY_SQL = with_fixtures(binned_months_cte(Y, METRIC, PRICE)) + f"""
SELECT {LABEL} AS return_bin, bin_order,
       count(DISTINCT symbol) AS stock_count,
       avg(annual_return) AS avg_annual_return,
       {r_half_up('avg(m)', 2)} AS mean_val,
       {r_half_up('quantile_cont(m, 0.5)', 2)} AS median_val,
       {r_half_up('stddev_samp(m)', 2)} AS std_val,
       {r_half_up('min(m)', 2)} AS min_val,
       {r_half_up('max(m)', 2)} AS max_val,
       {r_half_up('stddev_samp(m) / nullif(avg(m), 0)', 2)} AS cv_val,
       {r_half_up('quantile_cont(m, 0.75) - quantile_cont(m, 0.25)', 2)} AS iqr_val,
       {r_half_up('count_if(m > 0) * 100.0 / count(*)', 1)} AS positive_rate
FROM j GROUP BY bin_order"""
_SUMMARY_DOUBLES = (
    "avg_annual_return", "mean_val", "median_val", "std_val", "min_val", "max_val", "cv_val", "iqr_val", "positive_rate",
)


def _summary(t):
    return H.bin_summary(t["stock_annual_k"], t["monthly_revenue"], year=Y, metric=METRIC, price=PRICE)


register("bin_summary", _SUMMARY_SQL, doubles=_SUMMARY_DOUBLES, order="bin_order")(_summary)


@register(
    "bin_list_desc",
    with_fixtures(binned_months_cte(Y, METRIC, PRICE))
    + f"\nSELECT DISTINCT bin_order, {LABEL} AS return_bin FROM j",
    order="bin_order DESC",
)
def _bin_list(t):
    return H.bin_choices(t["stock_annual_k"], t["monthly_revenue"], year=Y, metric=METRIC, price=PRICE)


# -- G37, G38, G39, G40, F25, C4 ---------------------------------------------
_CELLS_CTE = """cells AS (SELECT bin_order, report_month, count(DISTINCT symbol) AS stock_count,
       count(m) AS data_points, avg(annual_return) AS avg_annual_return FROM j GROUP BY bin_order, report_month)"""


@register(
    "heatmap_totals",
    with_fixtures(binned_months_cte(Y, METRIC, PRICE), _CELLS_CTE)
    + """,
per_bin AS (SELECT bin_order, max(stock_count) AS mx, sum(data_points) AS dp FROM cells GROUP BY bin_order),
tot AS (SELECT (SELECT count(DISTINCT report_month) FROM cells) AS actual_months,
               sum(mx) AS total_samples, sum(dp) AS total_data_points FROM per_bin)
SELECT CAST(actual_months AS BIGINT) AS actual_months, CAST(total_samples AS BIGINT) AS total_samples,
       CAST(total_data_points AS BIGINT) AS total_data_points,
       CASE WHEN total_samples > 0 THEN total_data_points / (total_samples * actual_months) * 100 ELSE 0 END
         AS completeness
FROM tot""",
    doubles=("completeness",),
)
def _totals(t):
    return H.heatmap_totals(_cell_counts(t))


_FINDINGS_SQL = with_fixtures(binned_months_cte(Y, METRIC, PRICE), _CELLS_CTE) + f""",
summ AS (SELECT bin_order, {LABEL} AS return_bin, count(DISTINCT symbol) AS stock_count,
                avg(annual_return) AS avg_annual_return,
                {r_half_up('count_if(m > 0) * 100.0 / count(*)', 1)} AS positive_rate
         FROM j GROUP BY bin_order),
per_bin AS (SELECT bin_order, max(stock_count) AS mx FROM cells GROUP BY bin_order),
s AS (SELECT summ.*, per_bin.mx FROM summ LEFT JOIN per_bin USING (bin_order)),
worst AS (SELECT return_bin, avg_annual_return, positive_rate FROM s WHERE bin_order <= 10
          ORDER BY avg_annual_return, bin_order LIMIT 1),
best AS (SELECT return_bin, avg_annual_return, positive_rate FROM s WHERE bin_order >= 11
         ORDER BY avg_annual_return DESC, bin_order LIMIT 1),
agg AS (SELECT coalesce(sum(CASE WHEN bin_order <= 10 THEN stock_count END), 0) AS down_count,
               coalesce(sum(CASE WHEN bin_order >= 11 THEN stock_count END), 0) AS up_count,
               sum(mx) AS total_samples FROM s)
SELECT (SELECT return_bin FROM worst) AS worst_bin,
       (SELECT avg_annual_return FROM worst) AS worst_avg_return,
       (SELECT positive_rate FROM worst) AS worst_positive_rate,
       (SELECT return_bin FROM best) AS best_bin,
       (SELECT avg_annual_return FROM best) AS best_avg_return,
       (SELECT positive_rate FROM best) AS best_positive_rate,
       CAST(down_count AS BIGINT) AS down_count, CAST(up_count AS BIGINT) AS up_count,
       down_count * 100.0 / total_samples AS down_share, up_count * 100.0 / total_samples AS up_share,
       CAST(total_samples AS BIGINT) AS total_samples
FROM agg"""


@register(
    "bin_findings",
    _FINDINGS_SQL,
    doubles=("worst_avg_return", "worst_positive_rate", "best_avg_return", "best_positive_rate", "down_share", "up_share"),
)
def _findings(t):
    return H.bin_findings(t["stock_annual_k"], t["monthly_revenue"], year=Y, metric=METRIC, price=PRICE)


# -- W3, F16 -------------------------------------------------------------------
_LATEST_REMARK_CTE = f"""lr AS (SELECT stock_id, arg_max(remark, report_month) AS remark FROM monthly_revenue
       WHERE {window_in(Y)} AND remark IS NOT NULL AND remark <> '-' AND remark <> ''
       GROUP BY stock_id)"""


@register("latest_remark", with_fixtures(_LATEST_REMARK_CTE) + "\nSELECT stock_id, remark FROM lr")
def _latest_remark(t):
    return H.latest_remark(t["monthly_revenue"], year=Y)


# -- J2, J3, G21, F14, F17, O3, O4 --------------------------------------------
def _drill_sql(keyword: str = "", bin_no: int = DRILL_BIN, limit: int | None = None) -> str:
    """Each entity's year is summed up first, then the bin's rows pick theirs."""
    lim = "" if limit is None else f"\nLIMIT {limit}"
    return with_fixtures(bins_cte(Y, PRICE), _LATEST_REMARK_CTE) + f""",
entity_year AS (
  SELECT stock_id, stock_name,
         {r_half_up('avg(yoy_pct)', 1)} AS yoy_mean, {r_half_up('avg(mom_pct)', 1)} AS mom_mean,
         {r_half_up('stddev_samp(yoy_pct)', 1)} AS yoy_std, {r_half_up('stddev_samp(mom_pct)', 1)} AS mom_std
  FROM monthly_revenue WHERE {window_in(Y)} GROUP BY stock_id, stock_name)
SELECT stock_id, stock_name, {r_half_up('bins.annual_return', 1)} AS annual_return,
       yoy_mean, mom_mean, yoy_std, mom_std, lr.remark AS latest_remark
FROM bins JOIN entity_year USING (stock_id) LEFT JOIN lr USING (stock_id)
WHERE bin_order = {bin_no} AND (instr(stock_name, '{keyword}') > 0 OR instr(coalesce(lr.remark, ''), '{keyword}') > 0
      OR ('{keyword}' = '' AND coalesce(stock_name, lr.remark) IS NOT NULL))
ORDER BY {r_half_up('bins.annual_return', 1)} DESC NULLS FIRST, stock_id, stock_name NULLS FIRST, bins.annual_return NULLS FIRST{lim}"""


_DRILL_DOUBLES = ("annual_return", "yoy_mean", "mom_mean", "yoy_std", "mom_std")


def _drilldown(t, bin_no=DRILL_BIN, **kw):
    return H.bin_drilldown(t["stock_annual_k"], t["monthly_revenue"], year=Y, bin_order=bin_no, price=PRICE, **kw)


@register("bin_drilldown", _drill_sql(), doubles=_DRILL_DOUBLES)
def _drill(t):
    return _drilldown(t)


@register("bin_drilldown_down", _drill_sql(bin_no=DOWN_BIN), doubles=_DRILL_DOUBLES)
def _drill_down(t):
    return _drilldown(t, DOWN_BIN)


@register("bin_drilldown_keyword", _drill_sql(KEYWORD), doubles=_DRILL_DOUBLES)
def _drill_kw(t):
    return _drilldown(t, keyword=KEYWORD)


@register(
    "bin_drilldown_top",
    _drill_sql(limit=DRILL_TOP),
    doubles=_DRILL_DOUBLES,
    order="annual_return DESC NULLS FIRST, stock_id",
)
def _drill_top(t):
    return _drilldown(t, limit=DRILL_TOP)


@register("bin_drilldown_resorted", _drill_sql(limit=DRILL_TOP), doubles=_DRILL_DOUBLES, order="yoy_std DESC NULLS LAST, stock_id")
def _drill_resorted(t):
    return _drilldown(t, limit=DRILL_TOP, resort="yoy_std")
