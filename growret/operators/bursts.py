"""Burst probability: count the months an entity's growth falls in
[low, high) and describe the annual returns per burst count (survey 3.2).

Plan: the hit table is a pre-aggregation (one row per entity) built before
any join, so the join to the year's returns is entity-to-entity with bounded
multiplicity.  The grouping by hit count has at most 13 groups however large
the data: counts, sums, min / max and standard deviation merge partially on
the map side, and the median uses the bucketed exact percentile.  The id list
the reference pastes into SQL text becomes a semi join (no driver round trip).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growret.functions import stats
from growret.functions.periods import reporting_window
from growret.functions.returns import annual_returns, pct_change
from growret.operators.quantiles import grouped_with_quantiles


def burst_hits(revenue: DataFrame, *, year, metric: str = "yoy_pct", low: float = 100, high: float = 1000) -> DataFrame:
    """stock_id, hits: months of the 12-month window with low <= growth < high."""
    r = reporting_window(revenue, year=year).filter((F.col(metric) >= low) & (F.col(metric) < high))
    return r.groupBy("stock_id").agg(F.count(F.lit(1)).alias("hits"))


def hit_returns(hits: DataFrame, annual: DataFrame, *, year, price: str = "year_close") -> DataFrame:
    """hits, ret per entity (and per symbol of the entity)."""
    perf = annual_returns(annual, year=year, price=price).select("stock_id", F.col("annual_return").alias("ret"))
    return hits.join(perf, "stock_id", "inner").select("stock_id", "hits", "ret")


def burst_distribution(
    hits: DataFrame,
    annual: DataFrame,
    *,
    year,
    price: str = "year_close",
    half_even: bool = False,
    single_std_zero: bool = False,
    quantiles: str = "exact",
) -> DataFrame:
    """Return distribution per hit count, 1 decimal.

    ``half_even`` / ``single_std_zero`` give the second (pandas) path: banker's
    rounding, and a 0 standard deviation for a single entity (G20, Q16, Q18).
    A NULL return counts in the share denominators (Q15).
    """
    j = hit_returns(hits, annual, year=year, price=price)
    aggs = [
        F.count(F.lit(1)).alias("stock_count"),
        F.avg("ret").alias("_mean"),
        stats.share_above("ret", 20).alias("_win"),
        stats.share_above("ret", 100).alias("_dbl"),
        F.min("ret").alias("_min"),
        F.max("ret").alias("_max"),
        F.stddev_samp("ret").alias("_std"),
    ]
    g = grouped_with_quantiles(j, ["hits"], aggs, "ret", {"_med": 0.5}, strategy=quantiles)
    rnd = stats.round_half_even if half_even else stats.round_half_up
    std = F.col("_std")
    if single_std_zero:
        std = F.when(F.col("stock_count") == 1, F.lit(0.0)).otherwise(std)
    return (
        g.select(
            "hits",
            "stock_count",
            rnd("_mean", 1).alias("mean_ret"),
            rnd("_med", 1).alias("median_ret"),
            rnd("_win", 1).alias("win_rate_20"),
            rnd("_dbl", 1).alias("double_rate_100"),
            rnd("_min", 1).alias("min_ret"),
            rnd("_max", 1).alias("max_ret"),
            rnd(std, 1).alias("std_ret"),
        )
        .orderBy(F.desc("hits"))
    )


def burst_scores(dist: DataFrame) -> DataFrame:
    """Expected-value scores over the already rounded distribution rows.

    ev = mean * count; risk = mean / max(std, 1) with a NULL std giving 0;
    success = mean * win / 100; composite = (ev / 100 + risk + success) / 3,
    0 when ev is 0.  Rounded half-even like Python's ``round``.
    """
    mean = F.col("mean_ret")
    ev = mean * F.col("stock_count")
    risk = F.when(F.col("std_ret").isNull(), F.lit(0.0)).otherwise(mean / F.greatest(F.col("std_ret"), F.lit(1.0)))
    succ = mean * (F.col("win_rate_20") / 100)
    rnd = stats.round_half_even
    return dist.select(
        "hits",
        "stock_count",
        "mean_ret",
        "median_ret",
        rnd(mean - F.col("median_ret"), 1).alias("mean_median_diff"),
        "win_rate_20",
        "double_rate_100",
        F.when(ev != 0, rnd(ev / 100, 2)).otherwise(F.lit(0.0)).alias("ev_score"),
        rnd(risk, 2).alias("risk_score"),
        rnd(succ, 2).alias("success_score"),
        F.when(ev != 0, rnd((ev / 100 + risk + succ) / 3, 2)).otherwise(F.lit(0.0)).alias("composite_score"),
    )


def burst_best(scores: DataFrame) -> DataFrame:
    """Hit count with the highest composite score; ties go to the larger hit
    count, the first row of the hits-descending table (G41)."""
    key = F.struct(F.col("composite_score"), F.col("hits"))
    return scores.agg(
        F.max_by("hits", key).alias("best_hits"),
        F.max_by("composite_score", key).alias("best_score"),
        F.max_by("stock_count", key).alias("best_stock_count"),
    )


def burst_totals(dist: DataFrame) -> DataFrame:
    """Total sampled entities and the share of right-skewed groups."""
    return dist.agg(
        F.sum("stock_count").alias("total_stocks"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("mean_ret") - F.col("median_ret") > 0).alias("right_skewed_groups"),
    ).select(
        "total_stocks",
        "groups",
        "right_skewed_groups",
        (F.col("right_skewed_groups") * 100.0 / F.col("groups")).alias("right_skewed_share"),
    )


def burst_list(
    hits: DataFrame,
    annual: DataFrame,
    revenue: DataFrame,
    *,
    year,
    n_hits: int,
    metric: str = "yoy_pct",
    price: str = "year_close",
    limit: int | None = None,
) -> DataFrame:
    """Entities with exactly ``n_hits`` bursts: name, return, mean growth over
    13 months and their distinct meaningful remarks, by return, NULLs last;
    the first ``limit`` of them if the caller gives one (G22, G23, J5, J6,
    F18, F21, O6)."""
    h = hits.filter(F.col("hits") == int(n_hits))
    k = annual.filter(F.col("year") == F.lit(str(int(year)))).select(
        F.split_part(F.col("symbol"), F.lit("."), F.lit(1)).alias("stock_id"), F.col(price).alias("_p"), "year_open"
    )
    m = reporting_window(revenue, year=year, include_current_december=True).select(
        "stock_id", "stock_name", F.col(metric).alias("_g"), "remark"
    )
    j = h.join(k, "stock_id", "left").join(m, "stock_id", "left")
    clean = F.when((F.col("remark") != "-") & (F.col("remark") != ""), F.col("remark"))
    g = j.groupBy("stock_id", "stock_name", "_p", "year_open", "hits").agg(
        F.avg("_g").alias("_avg"),
        F.array_sort(F.collect_set(clean)).alias("_remarks"),  # at most 13 texts per entity
    )
    r1 = stats.round_half_up
    out = g.select(
        "stock_id",
        F.coalesce(F.col("stock_name"), F.lit("N/A")).alias("stock_name"),
        "hits",
        r1(pct_change(F.col("_p"), F.col("year_open")), 1).alias("annual_return"),
        r1("_avg", 1).alias("avg_growth"),
        F.when(F.size("_remarks") > 0, F.array_join("_remarks", " | ")).alias("remarks"),
        F.col("stock_name").alias("_name"),
        F.col("_p"),
    )
    out = out.orderBy(F.desc_nulls_last("annual_return"), "stock_id", F.asc_nulls_first("_name"), F.asc_nulls_first("_p"))
    if limit is not None:
        out = out.limit(int(limit))
    return out.drop("_name", "_p")


def burst_list_metrics(blist: DataFrame) -> DataFrame:
    """Mean, median, positive count and rate of the listed returns; NULL
    returns are skipped by mean and median but stay in the rate's
    denominator (G44)."""
    aggs = [
        F.count(F.lit(1)).alias("listed"),
        F.avg("annual_return").alias("mean_return"),
        F.count_if(F.col("annual_return") > 0).alias("positive_count"),
        F.try_divide(F.count_if(F.col("annual_return") > 0) * 100.0, F.count(F.lit(1))).alias("positive_rate"),
    ]
    return grouped_with_quantiles(blist, [], aggs, "annual_return", {"median_return": 0.5})


def multi_year_stats(
    hits: DataFrame,
    annual: DataFrame,
    *,
    year,
    price: str = "year_close",
    back: int = 2,
    ahead: int = 1,
    quantiles: str = "exact",
) -> DataFrame:
    """Returns of the hit entities in years y-back .. y+ahead, per hit count
    and year: mean, median (1 decimal, half-even) and n, over every hit
    entity (F6, J7, J8, G26, C3, O7).
    """
    j = _hit_years(hits, annual, year=year, price=price, back=back, ahead=ahead)
    keys = ["hits", "year"]
    g = grouped_with_quantiles(
        j, keys, [F.avg("annual_return").alias("_mean"), F.count(F.lit(1)).alias("n")], "annual_return",
        {"_med": 0.5}, strategy=quantiles,
    )
    rnd = stats.round_half_even
    return g.select(
        "hits", "year", rnd("_mean", 1).alias("mean_ret"), rnd("_med", 1).alias("median_ret"), "n"
    )


def _hit_years(hits: DataFrame, annual: DataFrame, *, year, price: str, back: int, ahead: int) -> DataFrame:
    y = int(year)
    yrs = annual_returns(annual, years=(y - back, y + ahead), price=price).select("stock_id", "year", "annual_return")
    return hits.join(yrs, "stock_id", "inner")


def multi_year_means(
    hits: DataFrame, annual: DataFrame, *, year, price: str = "year_close", back: int = 2, ahead: int = 1
) -> DataFrame:
    """The means of :func:`multi_year_stats` alone, in one aggregation without percentiles (V2)."""
    j = _hit_years(hits, annual, year=year, price=price, back=back, ahead=ahead)
    return j.groupBy("hits", "year").agg(stats.round_half_even(F.avg("annual_return"), 1).alias("mean_ret"))


def multi_year_pivot(ystats: DataFrame, *, year, value: str, back: int = 2, ahead: int = 1) -> DataFrame:
    """Hit counts x years of one statistic (V2, V3)."""
    y = int(year)
    years = [str(v) for v in range(y - back, y + ahead + 1)]
    p = ystats.groupBy("hits").pivot("year", years).agg(F.first(value))
    return p.select("hits", *[F.col(v).alias(f"y{v}") for v in years]).orderBy("hits")
