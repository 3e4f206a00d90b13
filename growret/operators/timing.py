"""Announcement timing: an event study of weekly returns around the first
month an entity's growth crosses a threshold (survey section 3.3).

Plan:

* first crossings -- LAG over the 13 report months of each entity (window
  partitioned by entity, a calendar-bounded number of rows each), then the
  threshold / year / keyword filters *after* the lag (Q10);
* weekly returns -- LAG over each symbol's bars, restricted to the dates
  any event can look at plus each symbol's one bar before them (its lag
  input), or with the previous prices stored beside each bar, no window;
* event x bars -- an equi join on the entity with the date range
  ``base - 38 d .. base + 30 d`` as a residual condition: bars outside the
  range would only feed NULL to every stage mean, and an event without bars
  is dropped by ``pre_week IS NOT NULL`` anyway (survey 4.2).  Both sides
  carry bounded rows per key, and AQE chooses broadcast or sort-merge from
  runtime sizes;
* stage statistics -- the five stage columns unpivoted to (stage, ret), so
  every statistic is one grouped aggregate over 5 groups, with percentiles
  from the bucketed exact operator.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growret.functions import stats
from growret.functions.periods import announcement_date, reporting_window, year_months
from growret.functions.returns import weekly_returns
from growret.operators.quantiles import grouped_with_quantiles

# Stage windows in days around the announcement date, as
# (name, low, low inclusive, high, high inclusive), and the pre-month scale.
STAGES = [
    ("pre_month", -38, True, -9, False),
    ("pre_week", -9, True, -3, True),
    ("announce_week", -3, False, 4, True),
    ("after_week_1", 4, False, 11, True),
    ("after_month", 11, False, 30, True),
]
PRE_MONTH_SCALE = 4
STAGE_NAMES = [s[0] for s in STAGES]
REACH_BEFORE = 38
REACH_AFTER = 30

# The five-bucket distribution edges (-inf, -5, -1, 1, 5, inf)
# and the +-5 tail cut-offs, the +-0.5 skew and +-2 kurtosis class limits.
DIST_EDGES = [-5.0, -1.0, 1.0, 5.0]
DIST_LABELS = [
    f"below {DIST_EDGES[0]:g}%",
    *[f"{a:g}% to {b:g}%" for a, b in zip(DIST_EDGES, DIST_EDGES[1:])],
    f"{DIST_EDGES[-1]:g}% and above",
]
TAIL = 5.0
SKEW_LIMIT = 0.5
KURT_LIMIT = 2.0


def first_bursts(revenue: DataFrame, *, year, metric: str = "yoy_pct", threshold: float = 100, keyword: str = "") -> DataFrame:
    """Months where growth first reaches ``threshold``.

    The previous value is the previous report *row* of the entity within the
    13-month window (Q9); a NULL previous value counts as below threshold.
    """
    r = reporting_window(revenue, year=year, include_current_december=True)
    prev = F.lag(metric).over(Window.partitionBy("stock_id").orderBy("report_month"))
    r = r.select("stock_id", "stock_name", "report_month", F.col(metric).alias("growth_val"), "remark", prev.alias("_prev"))
    kw = F.col("remark").contains(keyword) | F.col("stock_name").contains(keyword)
    ev = r.filter(
        (F.col("growth_val") >= threshold)
        & (F.col("_prev").isNull() | (F.col("_prev") < threshold))
        & F.col("report_month").isin(year_months(year))
        & kw
    )
    return ev.select(
        "stock_id", "stock_name", "report_month", "growth_val", "remark", announcement_date("report_month").alias("base_date")
    )


def event_dates(year) -> tuple[dt.date, dt.date]:
    """First and last weekly-bar date any event of ``year`` can use."""
    y = int(year)
    first_base = dt.date(y, 2, 10)  # January report
    last_base = dt.date(y + 1, 1, 10)  # December report
    return first_base - dt.timedelta(days=REACH_BEFORE), last_base + dt.timedelta(days=REACH_AFTER)


def year_weekly_returns(weekly: DataFrame, *, year, price: str = "w_close") -> DataFrame:
    lo, hi = event_dates(year)
    return weekly_returns(weekly, price=price, since=lo, until=hi)


def _in_stage(offset, lo, lo_inc, hi, hi_inc):
    a = offset >= lo if lo_inc else offset > lo
    b = offset <= hi if hi_inc else offset < hi
    return a & b


def event_study(events: DataFrame, wret: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Five stage means of weekly returns per event.

    ``ordered=False`` skips the final global sort, for a study that is stored
    and then aggregated (its row order is never seen)."""
    e = events.alias("e")
    c = wret.select(F.col("stock_id").alias("_sid"), "date", "weekly_ret").alias("c")
    cond = (
        (F.col("e.stock_id") == F.col("c._sid"))
        & (F.col("c.date") >= F.date_sub(F.col("e.base_date"), REACH_BEFORE))
        & (F.col("c.date") <= F.date_add(F.col("e.base_date"), REACH_AFTER))
    )
    j = e.join(c, cond, "inner")
    offset = F.datediff(F.col("date"), F.col("base_date"))
    aggs = []
    for name, lo, lo_inc, hi, hi_inc in STAGES:
        m = F.avg(F.when(_in_stage(offset, lo, lo_inc, hi, hi_inc), F.col("weekly_ret")))
        if name == "pre_month":
            m = m * PRE_MONTH_SCALE
        aggs.append(m.alias(name))
    g = j.groupBy("stock_id", "stock_name", "report_month", "growth_val", "remark", "base_date").agg(*aggs)
    study = g.filter(F.col("pre_week").isNotNull()).select(
        "stock_id", "stock_name", "report_month", "growth_val", "remark", *STAGE_NAMES
    )
    return study.orderBy(F.desc_nulls_first("pre_month"), "stock_id", "report_month") if ordered else study


def stage_values(study: DataFrame) -> DataFrame:
    """One row per event and stage: stage, stage_no, ret (V4)."""
    ids = ["stock_id", "stock_name", "report_month", "remark"]
    u = study.unpivot(ids, STAGE_NAMES, "stage", "ret")
    no = F.element_at(F.create_map(*[x for i, s in enumerate(STAGE_NAMES) for x in (F.lit(s), F.lit(i))]), F.col("stage"))
    return u.withColumn("stage_no", no)


def stage_means(study: DataFrame, *, quantiles: str = "exact") -> DataFrame:
    """Mean, median (2 decimals) and count per stage, zeros when a stage is
    empty, and the number of events, the same in each row (G27, F23)."""
    v = stage_values(study)
    g = grouped_with_quantiles(
        v, ["stage_no", "stage"], [F.avg("ret").alias("_mean"), F.count("ret").alias("n"), F.count(F.lit(1)).alias("events")], "ret", {"_med": 0.5},
        strategy=quantiles,
    )
    r2 = stats.round_half_even
    return (
        g.select(
            "stage_no", "stage",
            F.coalesce(r2("_mean", 2), F.lit(0.0)).alias("mean"),
            F.coalesce(r2("_med", 2), F.lit(0.0)).alias("median"),
            "n",
            "events",
        )
        .orderBy("stage_no")
    )


def stage_stats(study: DataFrame, *, quantiles: str = "exact") -> DataFrame:
    """Advanced statistics per stage with at least two values.

    Skew and kurtosis are the bias-adjusted estimators; CV and tail ratio are
    +infinity when their denominator is 0; classes use the rounded values."""
    v = stage_values(study).filter(F.col("ret").isNotNull())
    aggs = [
        F.count("ret").alias("data_points"),
        F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_std"),
        stats.skew_bias_adjusted("ret").alias("_skew"),
        stats.kurt_bias_adjusted("ret").alias("_kurt"),
        F.count_if(F.col("ret") > 0).alias("_wins"),
        F.count_if(F.col("ret") < -TAIL).alias("left_tail"),
        F.count_if(F.col("ret") > TAIL).alias("right_tail"),
    ]
    g = grouped_with_quantiles(
        v, ["stage_no", "stage"], aggs, "ret", {"_q25": 0.25, "_q50": 0.5, "_q75": 0.75},
        strategy=quantiles,
    )
    r = stats.round_half_even
    inf = F.lit(float("inf"))
    s = g.filter(F.col("data_points") >= 2)
    s = s.select(
        "stage_no", "stage",
        r("_mean", 2).alias("mean"),
        r("_q50", 2).alias("median"),
        r("_std", 2).alias("std"),
        r("_skew", 3).alias("skew"),
        r("_kurt", 3).alias("kurtosis"),
        F.when(F.col("_mean") != 0, r(F.try_divide(F.col("_std"), F.abs(F.col("_mean"))) * 100, 2)).otherwise(inf).alias("cv"),
        r("_q25", 2).alias("q25"),
        r("_q75", 2).alias("q75"),
        r(F.col("_q75") - F.col("_q25"), 2).alias("iqr"),
        r(F.col("_wins") / F.col("data_points") * 100, 1).alias("win_rate"),
        F.when(F.col("left_tail") > 0, r(F.try_divide(F.col("right_tail"), F.col("left_tail")), 2)).otherwise(inf).alias("tail_ratio"),
        "left_tail",
        "right_tail",
        r(F.col("_mean") - F.col("_q50"), 2).alias("mean_median_diff"),
        "data_points",
    )
    skew_class = (
        F.when(F.col("skew") > SKEW_LIMIT, F.lit("right skewed"))
        .when(F.col("skew") < -SKEW_LIMIT, F.lit("left skewed"))
        .otherwise(F.lit("near symmetric"))
    )
    kurt_class = (
        F.when(F.col("kurtosis") > KURT_LIMIT, F.lit("heavy tails"))
        .when(F.col("kurtosis") < -KURT_LIMIT, F.lit("light tails"))
        .otherwise(F.lit("normal tails"))
    )
    return s.withColumn("skew_class", skew_class).withColumn("kurtosis_class", kurt_class).orderBy("stage_no")


def stage_distribution(study: DataFrame) -> DataFrame:
    """Counts and shares of five fixed return buckets per stage; empty buckets
    are left out (G35)."""
    v = stage_values(study).filter(F.col("ret").isNotNull())
    r = F.col("ret")
    bucket = F.when(r < DIST_EDGES[0], 0)
    for i, edge in enumerate(DIST_EDGES[1:], start=1):
        bucket = bucket.when(r < edge, i)
    bucket = bucket.otherwise(len(DIST_EDGES))
    c = v.groupBy("stage_no", "stage", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("stage"))  # at most 5 rows per stage
    label = F.element_at(F.array(*[F.lit(x) for x in DIST_LABELS]), F.col("bucket") + 1)
    return c.select(
        "stage_no", "stage", "bucket", label.alias("label"), "count", (F.col("count") / total * 100).alias("pct")
    ).orderBy("stage_no", "bucket")


def stage_histogram(study: DataFrame, *, bins: int = 25) -> DataFrame:
    """Equal-width histogram per stage between its min and max, last bin
    closed, a constant stage widened by 0.5 each side; empty bins kept (G36, Q25, Q27)."""
    v = stage_values(study).filter(F.col("ret").isNotNull())
    b = v.groupBy("stage").agg(F.min("ret").alias("_min"), F.max("ret").alias("_max"))
    same = F.col("_min") == F.col("_max")
    b = b.select(
        "stage",
        F.when(same, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        F.when(same, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"),
    ).withColumn("_step", (F.col("_hi") - F.col("_lo")) / bins)

    def edge(i):
        return i.cast("double") * F.col("_step") + F.col("_lo")

    # one row per stage: a broadcast of at most five rows
    vb = v.join(F.broadcast(b), "stage", "inner")
    # the bin by division, then set right against its own two edges, which decide ties
    near = F.least(F.greatest(F.floor((F.col("ret") - F.col("_lo")) / F.col("_step")), F.lit(0)), F.lit(bins - 1)).cast("int")
    vb = vb.withColumn("bin", near)
    k = F.col("bin")
    right = F.when((k > 0) & (F.col("ret") < edge(k)), k - 1).when((k < bins - 1) & (F.col("ret") >= edge(k + 1)), k + 1).otherwise(k)
    counts = vb.withColumn("bin", right).groupBy("stage", "_lo", "_hi", "_step", "bin").agg(F.count(F.lit(1)).alias("count"))
    per_stage = counts.groupBy("stage", "_lo", "_hi", "_step").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_counts")  # at most `bins` entries
    )
    grid = per_stage.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    lo_e = edge(F.col("bin"))
    hi_e = F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise(edge(F.col("bin") + 1))
    no = F.element_at(F.create_map(*[x for i, s in enumerate(STAGE_NAMES) for x in (F.lit(s), F.lit(i))]), F.col("stage"))
    return grid.select(
        no.alias("stage_no"), "stage", "bin",
        lo_e.alias("bin_lo"), hi_e.alias("bin_hi"), (0.5 * (lo_e + hi_e)).alias("center"),
        F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0)).alias("count"),
    ).orderBy("stage_no", "bin")


def stage_outliers(study: DataFrame, *, stage: str | None = None, k: float = 1.5, quantiles: str = "exact") -> DataFrame:
    """Events whose stage return lies strictly outside [q25 - k IQR, q75 + k IQR];
    stages with fewer than four values report none (C2)."""
    v = stage_values(study).filter(F.col("ret").isNotNull())
    if stage is not None:
        if stage not in STAGE_NAMES:
            raise ValueError(f"stage must be one of {STAGE_NAMES}")
        v = v.filter(F.col("stage") == stage)
    q = grouped_with_quantiles(
        v, ["stage"], [F.count(F.lit(1)).alias("_n")], "ret", {"_q25": 0.25, "_q75": 0.75},
        strategy=quantiles,
    )
    iqr = F.col("_q75") - F.col("_q25")
    fences = q.filter(F.col("_n") >= 4).select(
        "stage", (F.col("_q25") - k * iqr).alias("_lower"), (F.col("_q75") + k * iqr).alias("_upper")
    )
    o = v.join(F.broadcast(fences), "stage", "inner").filter((F.col("ret") < F.col("_lower")) | (F.col("ret") > F.col("_upper")))
    return o.select("stock_id", "stock_name", "report_month", "stage_no", "stage", "ret", "remark").orderBy(
        "stage_no", "stock_id", "report_month"
    )


def report_slice(study: DataFrame, *, rows: int | None = None) -> DataFrame:
    """The event list with eight columns, as handed to a report; its first ``rows`` if given."""
    out = study.select(
        "stock_id", "stock_name", "growth_val", "pre_month", "pre_week", "after_week_1", "after_month", "remark",
        "report_month",
    ).orderBy(F.desc_nulls_first("pre_month"), "stock_id", "report_month")
    return (out if rows is None else out.limit(rows)).drop("report_month")
