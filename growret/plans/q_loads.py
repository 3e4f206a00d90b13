"""Registered queries over tables that were loaded piece by piece.

All lines are loaded in two pieces: the first lines of orders shipped before 1997,
then all others, which are late lines of months already loaded and new months.
The loads are named, so only the first query of
a session's tables runs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from growret.functions.returns import weekly_returns
from growret.operators import heatmap as H
from growret.plans import q_timing  # noqa: F401  (its weekly SQL is used here)
from growret.plans.params import METRIC, PRICE, WEEKLY_PRICE, YEAR
from growret.plans.q_heatmap import _CELL_DOUBLES, _CELL_ORDER, _cells_sql
from growret.plans.registry import REGISTRY, register
from growret.plans.sqltext import with_fixtures
from growret.sources.fixtures import read_star
from growret.sources.incremental import load_lines, loaded_tables

EARLY = "coalesce(l_shipdate < TIMESTAMP '1997-01-01' AND l_linenumber <= 4, true)"
PIECES = {"early": EARLY, "late": f"NOT {EARLY}"}


def _loaded(t) -> dict[str, DataFrame]:
    spark = t.spark
    root = f"{t.root}/loaded"
    star = read_star(spark, t.sf_dir)
    for name, piece in PIECES.items():
        load_lines(spark, root, name, star["lineitem"].filter(piece), star["part"], star["supplier"])
    return loaded_tables(spark, root)


@register(
    "loaded_monthly_revenue",
    with_fixtures() + "\nSELECT stock_id, stock_name, report_month, yoy_pct, mom_pct, remark FROM monthly_revenue",
    doubles=("yoy_pct", "mom_pct"),
)
def _monthly(t):
    return _loaded(t)["monthly_revenue"]


@register(
    "loaded_annual_bars",
    with_fixtures() + "\nSELECT symbol, year, year_open, year_high, year_close FROM stock_annual_k",
    doubles=("year_open", "year_high", "year_close"),
)
def _annual(t):
    return _loaded(t)["stock_annual_k"].drop("stock_id")


@register("loaded_weekly_returns", REGISTRY["weekly_returns"].sql, doubles=REGISTRY["weekly_returns"].doubles)
def _weekly(t):
    return weekly_returns(_loaded(t)["stock_weekly_k"], price=WEEKLY_PRICE)


@register("loaded_heatmap_mean", _cells_sql("avg(m)", "mean", "mean"), doubles=_CELL_DOUBLES, order=_CELL_ORDER)
def _heatmap(t):
    loaded = _loaded(t)
    return H.heatmap_cells(loaded["stock_annual_k"], loaded["monthly_revenue"], year=YEAR, metric=METRIC, stat="mean", price=PRICE)
