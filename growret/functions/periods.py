"""Report months, reporting windows and announcement dates.

A report month is text ``YYY_MM`` with YYY = Gregorian year - 1911 (the
Minguo year), zero padded to three digits so years before 2011 keep a fixed
width.  Window filters are written as ``report_month IN (...)`` over the
month texts computed in Python: this is exact for well-formed months, and it
reaches the parquet scan as a pushed ``In`` filter (and prunes the
``report_month`` partition folders of the materialized table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINGUO_OFFSET = 1911


def minguo_year(year: int | str) -> int:
    return int(year) - MINGUO_OFFSET


def report_month_text(year: int, month: int) -> str:
    """Gregorian (year, month) -> ``YYY_MM``."""
    return f"{year - MINGUO_OFFSET:03d}_{month:02d}"


def window_months(year: int | str, *, include_current_december: bool = False) -> list[str]:
    """Report months of one observation year.

    Prior December through November (12 reports, F7-F9), or through the
    current December (13 reports, F10) when ``include_current_december``.
    """
    y = int(year)
    last = 12 if include_current_december else 11
    return [report_month_text(y - 1, 12)] + [report_month_text(y, m) for m in range(1, last + 1)]


def year_months(year: int | str) -> list[str]:
    """All twelve report months of the year itself."""
    y = int(year)
    return [report_month_text(y, m) for m in range(1, 13)]


def in_window(year: int | str, *, include_current_december: bool = False, col: str = "report_month") -> Column:
    return F.col(col).isin(window_months(year, include_current_december=include_current_december))


def reporting_window(revenue: DataFrame, *, year: int | str, include_current_december: bool = False) -> DataFrame:
    return revenue.filter(in_window(year, include_current_december=include_current_december))


def report_period(col: str | Column = "report_month") -> Column:
    """``YYY_MM`` -> first day of that month (DATE); malformed text -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    y = F.split_part(c, F.lit("_"), F.lit(1)).try_cast("int")
    m = F.split_part(c, F.lit("_"), F.lit(2)).try_cast("int")
    ok = c.rlike(r"^[0-9]{3}_[0-9]{2}$") & m.between(1, 12)
    return F.when(ok, F.make_date(y + MINGUO_OFFSET, m, F.lit(1)))


def announcement_date(col: str | Column = "report_month") -> Column:
    """Revenue of month M is announced on the 10th of month M+1 (Dec -> 10 Jan)."""
    return F.date_add(F.add_months(report_period(col), 1), 9)


def date_text(col: str | Column) -> Column:
    """Date as ``YYYY-MM-DD`` text."""
    return F.date_format(col, "yyyy-MM-dd")


def malformed_months(revenue: DataFrame, col: str = "report_month") -> DataFrame:
    """One row: how many revenue rows carry a report month that is not a
    well-formed ``YYY_MM`` (Q7).  Such rows match no reporting window and are
    dropped by every query; this counts them (a partial count per task, no
    row moves)."""
    return revenue.agg(F.count_if(report_period(col).isNull()).alias("malformed_rows"))
