"""Aggregate Column builders.

Three skewness / kurtosis conventions meet in this library (quirk Q2):

* population (Spark's own ``skewness`` / ``kurtosis``),
* "sample-std standardized": mean of ((x - mean) / s)^k with the sample
  standard deviation s -- the intent of the heatmap's skew / kurtosis modes,
* bias-adjusted (the estimators of pandas ``skew`` / ``kurt``), used for the
  event-study stage statistics.

The helpers below turn the population moments, which Spark computes with
mergeable partial aggregates, into the other two.  ``F.skewness`` is never
used bare.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def n_of(col) -> Column:
    return F.count(_c(col)).cast("double")


def mean(col) -> Column:
    return F.avg(_c(col))


def std(col) -> Column:
    """Sample standard deviation; NULL for a single value."""
    return F.stddev_samp(_c(col))


def cv_heatmap(col) -> Column:
    """std / |mean| * 100; 0 when the mean is 0."""
    c = _c(col)
    return F.when(F.avg(c) == 0, F.lit(0.0)).otherwise(F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))) * 100)


def cv_signed(col) -> Column:
    """std / mean, signed, NULL when the mean is 0."""
    c = _c(col)
    return F.try_divide(F.stddev_samp(c), F.nullif(F.avg(c), F.lit(0.0)))


def skew_sample_std(col) -> Column:
    """mean(((x - mean) / s)^3) with sample std s; 0 for constant data."""
    c = _c(col)
    n = n_of(c)
    return F.when(F.stddev_samp(c) == 0, F.lit(0.0)).otherwise(F.skewness(c) * F.pow((n - 1) / n, 1.5))


def kurt_sample_std(col) -> Column:
    """mean(((x - mean) / s)^4) - 3 with sample std s; 0 for constant data."""
    c = _c(col)
    n = n_of(c)
    return F.when(F.stddev_samp(c) == 0, F.lit(0.0)).otherwise((F.kurtosis(c) + 3) * F.pow((n - 1) / n, 2) - 3)


def skew_bias_adjusted(col) -> Column:
    """Adjusted Fisher-Pearson skewness; NULL for n < 3, 0 for constant data."""
    c = _c(col)
    n = n_of(c)
    return (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(F.stddev_samp(c) == 0, F.lit(0.0))
        .otherwise(F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(c))
    )


def kurt_bias_adjusted(col) -> Column:
    """Bias-adjusted excess kurtosis; NULL for n < 4, 0 for constant data."""
    c = _c(col)
    n = n_of(c)
    return (
        F.when(n < 4, F.lit(None).cast("double"))
        .when(F.stddev_samp(c) == 0, F.lit(0.0))
        .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))
    )


def positive_share(col) -> Column:
    """Share of rows with a value > 0, in percent, over all rows."""
    return F.count_if(_c(col) > 0) * 100.0 / F.count(F.lit(1))


def share_above(col, threshold: float) -> Column:
    """Share of rows with value > threshold over all rows, in percent."""
    return F.count_if(_c(col) > threshold) * 100.0 / F.count(F.lit(1))


def _fits(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(1e27))


def round_half_up(col, digits: int) -> Column:
    """Round half away from zero on the decimal value (SQL ``ROUND(x::numeric, d)``).

    The double goes through DECIMAL(38,10) first, so float noise in the
    eleventh digit cannot flip a tie; NaN, infinity and values of 1e27 and
    more, which have no decimals to round, pass through unchanged.
    """
    c = _c(col)
    return F.when(_fits(c), F.round(c.try_cast("decimal(38,10)"), digits).cast("double")).otherwise(c)


def round_half_even(col, digits: int) -> Column:
    """Banker's rounding (pandas ``round``), on the decimal value."""
    c = _c(col)
    return F.when(_fits(c), F.bround(c.try_cast("decimal(38,10)"), digits).cast("double")).otherwise(c)


# Statistic modes of the heatmap (C5).  Unknown names fall back to the mean.
QUANTILE_STATS = {"median": {"val": 0.5}, "iqr": {"_q25": 0.25, "_q75": 0.75}}
STAT_LABELS = {
    "median": "median",
    "mean": "mean",
    "std": "std",
    "cv": "cv_pct",
    "skew": "skew",
    "kurtosis": "kurtosis",
    "iqr": "iqr",
    "positive": "positive_pct",
}
_SIMPLE = {
    "mean": mean,
    "std": std,
    "cv": cv_heatmap,
    "skew": skew_sample_std,
    "kurtosis": kurt_sample_std,
    "positive": positive_share,
}


def normalize_stat(stat: str) -> str:
    return stat if stat in STAT_LABELS else "mean"


def simple_stat(stat: str, col) -> Column:
    """Aggregate Column for a non-quantile heatmap statistic."""
    return _SIMPLE[normalize_stat(stat)](col)
