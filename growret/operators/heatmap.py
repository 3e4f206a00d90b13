"""Return-bin heatmap: bin entities by annual return, then describe their
monthly growth per bin and report month (section 3.1 of the survey).

Plan: the year's annual bars (filter pushed to the scan / partition folder)
are binned with one CASE chain and joined on the entity key to the twelve
report months of the observation year (an ``IN`` filter pushed to the scan).
Both sides are already one row per entity (and month), so join keys carry
bounded multiplicity whatever the data size; AQE picks broadcast or
sort-merge from the runtime sizes.  The grouping is bin x month (at most
22 x 12 groups): every statistic except the percentiles merges partially on
the map side, and percentiles go through the bucketed exact operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growret.functions import stats
from growret.functions.periods import reporting_window, window_months
from growret.functions.returns import LAST_DOWN_BIN, bin_label, return_bins
from growret.operators.quantiles import grouped_with_quantiles

METRICS = ("yoy_pct", "mom_pct")


def _metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return metric


def binned_months(annual: DataFrame, revenue: DataFrame, *, year, metric: str, price: str = "year_close") -> DataFrame:
    """Entity-month rows of the observation year with the entity's return bin."""
    m = _metric(metric)
    bins = return_bins(annual, year=year, price=price).select(
        "symbol", "stock_id", "annual_return", "bin_order", "return_bin"
    )
    months = (
        reporting_window(revenue, year=year)
        .filter(F.col(m).isNotNull())
        .select("stock_id", "report_month", F.col(m).alias("m"))
    )
    return bins.join(months, "stock_id", "inner")


def heatmap_cells(
    annual: DataFrame,
    revenue: DataFrame,
    *,
    year,
    metric: str = "yoy_pct",
    stat: str = "median",
    price: str = "year_close",
    quantiles: str = "exact",
    ordered: bool = True,
) -> DataFrame:
    """One row per (bin, report month): the chosen statistic ``val``, the
    distinct symbols, the data points and the row-weighted mean return
    (G1-G15, C5, F24, O1)."""
    stat = stats.normalize_stat(stat)
    j = binned_months(annual, revenue, year=year, metric=metric, price=price)
    keys = ["bin_order", "report_month"]
    base_aggs = [
        F.count_distinct("symbol").alias("stock_count"),
        F.count("m").alias("data_points"),
        F.avg("annual_return").alias("avg_annual_return"),
    ]
    if stat in stats.QUANTILE_STATS:
        cells = grouped_with_quantiles(
            j, keys, base_aggs, "m", stats.QUANTILE_STATS[stat], strategy=quantiles
        )
        val = F.col("val") if stat == "median" else F.col("_q75") - F.col("_q25")
        cells = cells.withColumn("val", val)
    else:
        cells = j.groupBy(*keys).agg(stats.simple_stat(stat, "m").alias("val"), *base_aggs)
    out = cells.select(
        bin_label("bin_order").alias("return_bin"),
        "bin_order",
        "report_month",
        "val",
        "stock_count",
        "data_points",
        "avg_annual_return",
        F.lit(stat).alias("stat_method"),
        F.lit(stats.STAT_LABELS[stat]).alias("stat_label"),
    )
    return out.orderBy("bin_order", "report_month") if ordered else out


def cell_counts(annual: DataFrame, revenue: DataFrame, *, year, metric: str = "yoy_pct", price: str = "year_close") -> DataFrame:
    """Distinct symbols and data points per (bin, report month), without any
    statistic: what the totals and findings need (G10, G11)."""
    j = binned_months(annual, revenue, year=year, metric=metric, price=price)
    return j.groupBy("bin_order", "report_month").agg(
        F.count_distinct("symbol").alias("stock_count"), F.count("m").alias("data_points")
    )


def month_column(report_month: str) -> str:
    return f"m{report_month}"


def heatmap_pivot(cells: DataFrame, *, year) -> DataFrame:
    """Bins x report months, ``val`` in the cells (V1).  The month list is
    given, so the pivot needs no extra job to discover its columns."""
    months = window_months(year)
    p = cells.groupBy("bin_order", "return_bin").pivot("report_month", months).agg(F.first("val"))
    return p.select("bin_order", "return_bin", *[F.col(m).alias(month_column(m)) for m in months]).orderBy(
        "bin_order"
    )


def bin_summary(
    annual: DataFrame,
    revenue: DataFrame,
    *,
    year,
    metric: str = "yoy_pct",
    price: str = "year_close",
    quantiles: str = "exact",
) -> DataFrame:
    """Twelve statistics per bin over all its entity-months."""
    j = binned_months(annual, revenue, year=year, metric=metric, price=price)
    keys = ["bin_order"]
    aggs = [
        F.count_distinct("symbol").alias("stock_count"),
        F.avg("annual_return").alias("avg_annual_return"),
        F.avg("m").alias("_mean"),
        F.stddev_samp("m").alias("_std"),
        F.min("m").alias("_min"),
        F.max("m").alias("_max"),
        stats.cv_signed("m").alias("_cv"),
        stats.positive_share("m").alias("_pos"),
    ]
    g = grouped_with_quantiles(
        j, keys, aggs, "m", {"_q25": 0.25, "_q50": 0.5, "_q75": 0.75}, strategy=quantiles
    )
    r2 = stats.round_half_up
    return (
        g.select(
            bin_label("bin_order").alias("return_bin"),
            "bin_order",
            "stock_count",
            "avg_annual_return",
            r2("_mean", 2).alias("mean_val"),
            r2("_q50", 2).alias("median_val"),
            r2("_std", 2).alias("std_val"),
            r2("_min", 2).alias("min_val"),
            r2("_max", 2).alias("max_val"),
            r2("_cv", 2).alias("cv_val"),
            r2(F.col("_q75") - F.col("_q25"), 2).alias("iqr_val"),
            r2("_pos", 1).alias("positive_rate"),
        )
        .orderBy("bin_order")
    )


def bin_choices(annual: DataFrame, revenue: DataFrame, *, year, metric: str = "yoy_pct", price: str = "year_close") -> DataFrame:
    """Bins offered for the drilldown, in reverse order: those of the summary, without its statistics."""
    bins = binned_months(annual, revenue, year=year, metric=metric, price=price).select("bin_order").distinct()
    return bins.select("bin_order", bin_label("bin_order").alias("return_bin")).orderBy(F.desc("bin_order"))


def heatmap_totals(cells: DataFrame) -> DataFrame:
    """Months covered, total samples (sum over bins of the largest monthly
    symbol count, Q21), total data points and completeness (G37, G38)."""
    per_bin = cells.groupBy("bin_order").agg(
        F.max("stock_count").alias("mx"),
        F.sum("data_points").alias("dp"),
        F.collect_set("report_month").alias("months"),  # at most 13 texts per bin
    )
    t = per_bin.agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("months")))).alias("actual_months"),
        F.sum("mx").alias("total_samples"),
        F.sum("dp").alias("total_data_points"),
    )
    denom = F.col("total_samples") * F.col("actual_months")
    return t.select(
        F.col("actual_months").cast("long").alias("actual_months"),
        F.col("total_samples").cast("long").alias("total_samples"),
        F.col("total_data_points").cast("long").alias("total_data_points"),
        F.when(F.col("total_samples") > 0, F.col("total_data_points") / denom * 100)
        .otherwise(F.lit(0.0))
        .alias("completeness"),
    )


def bin_findings(
    annual: DataFrame, revenue: DataFrame, *, year, metric: str = "yoy_pct", price: str = "year_close"
) -> DataFrame:
    """Worst down bin, best up bin and the down / up shares as one row (C4,
    G39, G40, F25).  Ties go to the lower bin order, like a first-match scan
    of the bin-ordered table.  Only counts, means and a positive share per
    bin are needed, so no percentile is computed."""
    j = binned_months(annual, revenue, year=year, metric=metric, price=price)
    # One pass over the join: roll it up to (bin, month, symbol), then take
    # the (bin, symbol) and (bin, month) grains in one grouping-sets
    # aggregate.  Distinct symbols per bin and per cell are row counts of
    # those grains; the row-weighted mean return and the positive share come
    # from the carried sums and counts.
    sym = j.groupBy("bin_order", "report_month", "symbol").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("annual_return").alias("_ret_sum"),
        F.count("annual_return").alias("_ret_n"),
        F.count_if(F.col("m") > 0).alias("_pos"),
    )
    grains = sym.groupingSets(
        [["bin_order", "symbol"], ["bin_order", "report_month"]], "bin_order", "symbol", "report_month"
    ).agg(
        F.grouping_id().alias("_gid"),
        *[F.sum(c).alias(c) for c in ("_rows", "_ret_sum", "_ret_n", "_pos")],
        F.count(F.lit(1)).alias("_symbols"),
    )
    by_symbol = F.col("_gid") == 1  # report_month aggregated away
    by_cell = ~by_symbol

    def on_symbol(c):
        return F.sum(F.when(by_symbol, F.col(c)))

    s = (
        grains.groupBy("bin_order")
        .agg(
            F.count_if(by_symbol).alias("stock_count"),
            F.try_divide(on_symbol("_ret_sum"), on_symbol("_ret_n")).alias("avg_annual_return"),
            stats.round_half_up(on_symbol("_pos") * 100.0 / on_symbol("_rows"), 1).alias("positive_rate"),
            F.max(F.when(by_cell, F.col("_symbols"))).alias("mx"),
        )
        .withColumn("return_bin", bin_label("bin_order"))
    )
    down = F.col("bin_order") <= LAST_DOWN_BIN
    up = ~down
    worst_key = F.struct(F.col("avg_annual_return"), F.col("bin_order"))
    best_key = F.struct(F.col("avg_annual_return"), -F.col("bin_order"))
    w = F.when(down, worst_key)
    b = F.when(up, best_key)
    row = s.agg(
        F.min_by(F.when(down, F.col("return_bin")), w).alias("worst_bin"),
        F.min_by(F.when(down, F.col("avg_annual_return")), w).alias("worst_avg_return"),
        F.min_by(F.when(down, F.col("positive_rate")), w).alias("worst_positive_rate"),
        F.max_by(F.when(up, F.col("return_bin")), b).alias("best_bin"),
        F.max_by(F.when(up, F.col("avg_annual_return")), b).alias("best_avg_return"),
        F.max_by(F.when(up, F.col("positive_rate")), b).alias("best_positive_rate"),
        F.coalesce(F.sum(F.when(down, F.col("stock_count"))), F.lit(0)).alias("down_count"),
        F.coalesce(F.sum(F.when(up, F.col("stock_count"))), F.lit(0)).alias("up_count"),
        F.sum("mx").alias("total_samples"),
    )
    return row.select(
        "worst_bin", "worst_avg_return", "worst_positive_rate",
        "best_bin", "best_avg_return", "best_positive_rate",
        F.col("down_count").cast("long").alias("down_count"),
        F.col("up_count").cast("long").alias("up_count"),
        F.try_divide(F.col("down_count") * 100.0, F.col("total_samples")).alias("down_share"),
        F.try_divide(F.col("up_count") * 100.0, F.col("total_samples")).alias("up_share"),
        F.col("total_samples").cast("long").alias("total_samples"),
    )


def meaningful_remark(col: str = "remark"):
    """Not NULL, not '-', not empty (F16)."""
    c = F.col(col)
    return c.isNotNull() & (c != "-") & (c != "")


def latest_remark(revenue: DataFrame, *, year) -> DataFrame:
    """Latest meaningful remark of each entity within the year's window.

    An entity has at most twelve rows here, so they are listed by a hash
    aggregation (a maximum over texts would sort all rows first) and the last
    month's is taken from the list."""
    r = reporting_window(revenue, year=year).filter(meaningful_remark())
    last = F.array_max(F.collect_list(F.struct("report_month", "remark")))
    return r.groupBy("stock_id").agg(last.alias("_last")).select("stock_id", F.col("_last.remark").alias("remark"))


def bin_drilldown(
    annual: DataFrame,
    revenue: DataFrame,
    *,
    year,
    bin_order: int,
    price: str = "year_close",
    keyword: str = "",
    limit: int | None = None,
    resort: str | None = None,
) -> DataFrame:
    """Entities of one bin: rounded return, mean and std of both growth
    metrics, latest remark, by return, NULL first; the first ``limit`` of them
    if the caller gives one (G21, J2, J3, F14, F17, O3).  ``resort`` re-orders
    these rows by another output column, descending -- after the limit, as
    the reference does (O4, Q20)."""
    t = return_bins(annual, year=year, price=price).filter(F.col("bin_order") == int(bin_order))
    t = t.select("stock_id", "annual_return")
    m = reporting_window(revenue, year=year).select(
        "stock_id", "stock_name", "yoy_pct", "mom_pct", "report_month", F.col("remark").alias("_rm")
    )
    # The latest meaningful remark (W3, J3) comes from the bin's own joined
    # rows -- the same window months -- through a window by entity (its 12
    # months per symbol), so remarks of entities outside the bin are never
    # aggregated; the grouping below is keyed by the entity too and reuses
    # the window's partitioning instead of shuffling again.
    latest = F.max(F.when(meaningful_remark("_rm"), F.struct("report_month", "_rm"))).over(Window.partitionBy("stock_id"))
    j = m.join(t, "stock_id", "inner").select(
        "stock_id", "stock_name", "yoy_pct", "mom_pct", "annual_return", latest.getField("_rm").alias("remark")
    )
    kw = F.col("stock_name").contains(keyword) | (F.col("remark").isNotNull() & F.col("remark").contains(keyword))
    j = j.filter(kw)
    r1 = stats.round_half_up
    g = j.groupBy("stock_id", "stock_name", "annual_return", "remark").agg(
        r1(F.avg("yoy_pct"), 1).alias("yoy_mean"),
        r1(F.avg("mom_pct"), 1).alias("mom_mean"),
        r1(F.stddev_samp("yoy_pct"), 1).alias("yoy_std"),
        r1(F.stddev_samp("mom_pct"), 1).alias("mom_std"),
    )
    out = g.select(
        "stock_id", "stock_name", r1("annual_return", 1).alias("annual_return"),
        "yoy_mean", "mom_mean", "yoy_std", "mom_std", F.col("remark").alias("latest_remark"),
        F.col("annual_return").alias("_ret"),
    )
    top = out.orderBy(
        F.desc_nulls_first("annual_return"), "stock_id", F.asc_nulls_first("stock_name"), F.asc_nulls_first("_ret")
    )
    if limit is not None:
        top = top.limit(int(limit))
    top = top.drop("_ret")
    if resort is not None:
        if resort not in ("annual_return", "yoy_mean", "mom_mean", "yoy_std", "mom_std"):
            raise ValueError(f"cannot re-sort by {resort}")
        top = top.orderBy(F.desc(resort), "stock_id")
    return top
