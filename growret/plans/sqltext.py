"""SQL text pieces for the DuckDB oracle.  Nothing here comes from the code
under test: bin edges, labels and reporting windows are spelled out."""

from __future__ import annotations

# The model tables derived from the star schema: the text of FIXTURES.md,
# valid in DuckDB and Spark SQL alike.
FIXTURE_CTES = """line AS (
  SELECT l_suppkey,
         CASE WHEN l_suppkey BETWEEN 0 AND 99999 THEN lpad(CAST(l_suppkey AS STRING), 6, '0') ELSE CAST(l_suppkey AS STRING) END
           AS stock_id,
         CASE WHEN l_suppkey BETWEEN 0 AND 99999 THEN lpad(CAST(l_suppkey AS STRING), 6, '0') ELSE CAST(l_suppkey AS STRING) END
           || CASE WHEN l_suppkey % 2 = 0 THEN '.TW' ELSE '.TWO' END AS symbol,
         CAST(l_shipdate AS DATE) AS d,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS mon,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS wk,
         CAST(year(l_shipdate) AS STRING) AS yr,
         p_name,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amt,
         l_extendedprice / l_quantity AS px,
         (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
rev AS (
  SELECT l_suppkey, stock_id, mon, CAST(sum(amt) AS DOUBLE) AS revenue, count(*) AS n, max(p_name) AS nm
  FROM line GROUP BY l_suppkey, stock_id, mon),
monthly_revenue AS (
  SELECT r.stock_id, s_name AS stock_name,
         lpad(CAST(year(r.mon) - 1911 AS STRING), 3, '0') || '_' || lpad(CAST(month(r.mon) AS STRING), 2, '0') AS report_month,
         (r.revenue - y.revenue) / y.revenue * 100 AS yoy_pct,
         (r.revenue - p.revenue) / p.revenue * 100 AS mom_pct,
         CASE WHEN r.n = 1 THEN '-' WHEN r.n = 2 THEN '' WHEN r.n = 3 THEN NULL ELSE r.nm END AS remark
  FROM rev r JOIN supplier ON s_suppkey = r.l_suppkey
  LEFT JOIN rev p ON p.l_suppkey = r.l_suppkey AND p.mon = CAST(r.mon - INTERVAL '1' MONTH AS DATE)
  LEFT JOIN rev y ON y.l_suppkey = r.l_suppkey AND y.mon = CAST(r.mon - INTERVAL '12' MONTH AS DATE)),
stock_annual_k AS (
  SELECT symbol, yr AS year, min_by(px, k) AS year_open, max(px) AS year_high, max_by(px, k) AS year_close
  FROM line GROUP BY symbol, yr),
stock_weekly_k AS (
  SELECT symbol, wk AS date, max_by(px, k) AS w_close, max(px) AS w_high
  FROM line GROUP BY symbol, wk),
stock_prices AS (SELECT d AS date FROM line)"""


#: The 22 return bins and their labels.
_BIN_CASE = """CASE WHEN {r} <= -100 THEN 0 WHEN {r} < -90 THEN 1 WHEN {r} < -80 THEN 2 WHEN {r} < -70 THEN 3
       WHEN {r} < -60 THEN 4 WHEN {r} < -50 THEN 5 WHEN {r} < -40 THEN 6 WHEN {r} < -30 THEN 7 WHEN {r} < -20 THEN 8
       WHEN {r} < -10 THEN 9 WHEN {r} < 0 THEN 10 WHEN {r} < 100 THEN 11 WHEN {r} < 200 THEN 12 WHEN {r} < 300 THEN 13
       WHEN {r} < 400 THEN 14 WHEN {r} < 500 THEN 15 WHEN {r} < 600 THEN 16 WHEN {r} < 700 THEN 17 WHEN {r} < 800 THEN 18
       WHEN {r} < 900 THEN 19 WHEN {r} < 1000 THEN 20 ELSE 21 END"""
_LABELS = """['00. down -100% or worse', '01. down -100% to -90%', '02. down -90% to -80%', '03. down -80% to -70%',
        '04. down -70% to -60%', '05. down -60% to -50%', '06. down -50% to -40%', '07. down -40% to -30%',
        '08. down -30% to -20%', '09. down -20% to -10%', '10. down -10% to 0%', '11. up 0% to 100%',
        '12. up 100% to 200%', '13. up 200% to 300%', '14. up 300% to 400%', '15. up 400% to 500%',
        '16. up 500% to 600%', '17. up 600% to 700%', '18. up 700% to 800%', '19. up 800% to 900%',
        '20. up 900% to 1000%', '21. up 1000% or more']"""
#: Months since year 0 of a report month's text.
_MONTH_NO = "((TRY_CAST(left(report_month, 3) AS INTEGER) + 1911) * 12 + TRY_CAST(right(report_month, 2) AS INTEGER))"


def window_in(year, *, include_current_december: bool = False) -> str:
    """December before the year to November of it, or to its December."""
    last = 12 if include_current_december else 11
    return f"{_MONTH_NO} BETWEEN {int(year) * 12} AND {int(year) * 12 + last}"


def year_in(year) -> str:
    return f"{_MONTH_NO} BETWEEN {int(year) * 12 + 1} AND {int(year) * 12 + 12}"


def bin_case(ret: str) -> str:
    return _BIN_CASE.format(r=ret)


def label_case(order: str) -> str:
    return f"list_extract({_LABELS}, CAST({order} AS INTEGER) + 1)"


def annual_cte(name: str, year, price: str) -> str:
    return f"""{name} AS (
  SELECT symbol, split_part(symbol, '.', 1) AS stock_id, year,
         (({price} - year_open) / year_open) * 100 AS annual_return
  FROM stock_annual_k
  WHERE year = '{int(year)}' AND (year_open IS NULL OR year_open <> 0))"""


def bins_cte(year, price: str) -> str:
    return annual_cte("ab", year, price) + f""",
bins AS (SELECT ab.*, {bin_case('annual_return')} AS bin_order FROM ab)"""


def binned_months_cte(year, metric: str, price: str) -> str:
    return bins_cte(year, price) + f""",
mo AS (SELECT stock_id, report_month, {metric} AS m FROM monthly_revenue
       WHERE {window_in(year)} AND {metric} IS NOT NULL),
j AS (SELECT b.symbol, b.stock_id, b.annual_return, b.bin_order, mo.report_month, mo.m
      FROM bins b JOIN mo ON b.stock_id = mo.stock_id)"""


def r_half_up(expr: str, digits: int) -> str:
    x = f"CAST(({expr}) AS DOUBLE)"
    return f"CASE WHEN isfinite({x}) AND abs({x}) < 1e27 THEN CAST(ROUND(TRY_CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE) ELSE {x} END"


def r_half_even(expr: str, digits: int) -> str:
    x = f"CAST(({expr}) AS DOUBLE)"
    return f"CASE WHEN isfinite({x}) AND abs({x}) < 1e27 THEN CAST(ROUND_EVEN(TRY_CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE) ELSE {x} END"


def with_fixtures(*ctes: str) -> str:
    return "WITH " + FIXTURE_CTES + "".join(",\n" + c for c in ctes)
