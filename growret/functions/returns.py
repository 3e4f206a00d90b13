"""Annual and weekly returns, return bins, entity key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANNUAL_PRICE_FIELDS = ("year_close", "year_high")
WEEKLY_PRICE_FIELDS = ("w_close", "w_high")

# The 22 return bins.  Bin 0 is a return <= -100; bins 1-10
# are left-closed ten-point steps up to 0 (each "< edge"); bins 11-20 are
# hundred-point steps up to 1000; bin 21 is everything else, a NULL return
# included.
DOWN_EDGES = [-100, -90, -80, -70, -60, -50, -40, -30, -20, -10, 0]
UP_EDGES = [100, 200, 300, 400, 500, 600, 700, 800, 900, 1000]
TOP_BIN = len(DOWN_EDGES) + len(UP_EDGES)  # 21
LAST_DOWN_BIN = len(DOWN_EDGES) - 1  # 10


def _bin_label(order: int) -> str:
    if order == 0:
        return f"{order:02d}. down {DOWN_EDGES[0]}% or worse"
    if order <= LAST_DOWN_BIN:
        return f"{order:02d}. down {DOWN_EDGES[order - 1]}% to {DOWN_EDGES[order]}%"
    if order < TOP_BIN:
        lo = 0 if order == LAST_DOWN_BIN + 1 else UP_EDGES[order - LAST_DOWN_BIN - 2]
        return f"{order:02d}. up {lo}% to {UP_EDGES[order - LAST_DOWN_BIN - 1]}%"
    return f"{order:02d}. up {UP_EDGES[-1]}% or more"


BIN_LABELS = [_bin_label(i) for i in range(TOP_BIN + 1)]


def entity_key(col: str | Column = "symbol") -> Column:
    """Entity code: the text of a symbol before its first dot."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split_part(c, F.lit("."), F.lit(1))


def _stored_key(df: DataFrame) -> Column:
    """The entity key, stored with the bars or taken from the symbol."""
    return (F.col("stock_id") if "stock_id" in df.columns else entity_key("symbol")).alias("stock_id")


def pct_change(new: Column, base: Column) -> Column:
    """(new - base) / base * 100; a zero or NULL base gives NULL, never an error."""
    return F.try_divide(new - base, base) * 100


def annual_return(price: str = "year_close") -> Column:
    if price not in ANNUAL_PRICE_FIELDS:
        raise ValueError(f"annual price field must be one of {ANNUAL_PRICE_FIELDS}")
    return pct_change(F.col(price), F.col("year_open"))


def bin_order(ret: str | Column) -> Column:
    """Return -> bin order 0..21 by comparison with the fixed edges."""
    r = F.col(ret) if isinstance(ret, str) else ret
    expr = F.when(r <= DOWN_EDGES[0], F.lit(0))
    for i, edge in enumerate(DOWN_EDGES[1:] + UP_EDGES, start=1):
        expr = expr.when(r < edge, F.lit(i))
    return expr.otherwise(F.lit(TOP_BIN))


def bin_label(order: str | Column) -> Column:
    """Bin order -> label text (F2)."""
    o = F.col(order) if isinstance(order, str) else order
    return F.element_at(F.array(*[F.lit(x) for x in BIN_LABELS]), o + 1)


def annual_returns(
    annual: DataFrame, *, year: int | str | None = None, price: str = "year_close", years: tuple[int, int] | None = None
) -> DataFrame:
    """symbol, stock_id, year, annual_return for one year (F5) or a year range.

    A zero ``year_open`` would abort the reference's statement; such bars are
    dropped here.  A NULL open gives a NULL return (binned into the top bin).
    """
    df = annual
    if year is not None:
        df = df.filter(F.col("year") == F.lit(str(int(year))))
    if years is not None:
        lo, hi = years
        df = df.filter(F.col("year").isin([str(y) for y in range(int(lo), int(hi) + 1)]))
    df = df.filter(F.col("year_open").isNull() | (F.col("year_open") != 0))
    return df.select(
        "symbol",
        _stored_key(df),
        "year",
        annual_return(price).alias("annual_return"),
    )


def return_bins(annual: DataFrame, *, year: int | str, price: str = "year_close", null_bin: str = "top") -> DataFrame:
    """Annual returns with bin order and label."""
    df = annual_returns(annual, year=year, price=price)
    if null_bin == "drop":
        df = df.filter(F.col("annual_return").isNotNull())
    elif null_bin != "top":
        raise ValueError("null_bin is 'top' or 'drop'")
    return df.withColumn("bin_order", bin_order("annual_return")).withColumn("return_bin", bin_label("bin_order"))


def _change(price: Column, prev: Column) -> Column:
    return F.try_divide(price - prev, F.nullif(prev, F.lit(0.0))) * 100


def weekly_price_field(price: str) -> str:
    """Anything other than ``w_high`` means ``w_close``."""
    return "w_high" if price == "w_high" else "w_close"


def previous_bar(bars: DataFrame, values: list[str]) -> DataFrame:
    """``bars`` with ``_prev``, a struct of ``values`` of the symbol's bar before (NULL for its first one).

    A symbol's history is cut into months, so no task sorts more of it than one
    month, however long or hot it is; the last bar of each month is carried to
    the symbol's next month that has bars.  Symbol and month are one key, which
    is never null, so the window, the months' last bars and the join with what is
    carried share one shuffle of the bars.
    """
    dealt = bars.withColumn("_block", F.struct("symbol", F.trunc("date", "month").alias("month"))).drop("symbol").repartition("_block")
    near = dealt.withColumn("_near", F.lag(F.struct(*values)).over(Window.partitionBy("_block").orderBy("date")))
    last = dealt.groupBy("_block").agg(*[F.max_by(v, "date").alias(v) for v in values])  # hash maps: widths are fixed
    months = Window.partitionBy("_block.symbol").orderBy("_block.month")  # a row per month
    carried = last.select(F.col("_block").alias("_to"), F.lag(F.struct(*values)).over(months).alias("_carried"))
    out = near.join(carried, F.col("_block") == F.col("_to"), "left").withColumn("symbol", F.col("_block.symbol"))
    return out.select(*bars.columns, F.coalesce("_near", "_carried").alias("_prev"))


def with_previous(weekly: DataFrame) -> DataFrame:
    """Weekly bars with their entity key and the previous bar's prices
    (``prev_close``, ``prev_high``), to be stored with the bars so that later
    reads need no window."""
    out = previous_bar(weekly, ["w_close", "w_high"])
    return out.withColumns(
        {"stock_id": entity_key("symbol"), "prev_close": F.col("_prev.w_close"), "prev_high": F.col("_prev.w_high")}
    ).drop("_prev")


def weekly_returns(weekly: DataFrame, *, price: str = "w_close", since=None, until=None) -> DataFrame:
    """symbol, stock_id, date, weekly_ret: change against the previous bar.

    The previous bar is the previous *row* of the symbol, whatever the gap.
    ``until`` (a date) drops later bars before the window: a lag only looks
    back, so they never change earlier returns.  ``since`` keeps bars from
    that date on; their lags still see the true predecessor, because each
    symbol's last bar before ``since`` is added back -- found by a ``max_by``
    that merges partially on the map side -- so only the kept range plus one bar
    per symbol is sorted, a month at a time (:func:`previous_bar`).  Bars that
    :func:`with_previous` has prepared need neither: the date filter is the
    only read.
    """
    p = weekly_price_field(price)
    stored = f"prev_{p[2:]}"
    if stored in weekly.columns:
        df = weekly
        if since is not None:
            df = df.filter(F.col("date") >= F.lit(since))
        if until is not None:
            df = df.filter(F.col("date") <= F.lit(until))
        return df.select("symbol", "stock_id", "date", _change(F.col(p), F.col(stored)).alias("weekly_ret"))
    df = weekly.select("symbol", "date", F.col(p).alias("price"))
    if until is not None:
        df = df.filter(F.col("date") <= F.lit(until))
    if since is not None:
        recent = df.filter(F.col("date") >= F.lit(since))
        last_before = (
            df.filter(F.col("date") < F.lit(since))
            .groupBy("symbol")
            .agg(F.max_by(F.struct("date", "price"), "date").alias("_b"))
            .select("symbol", F.col("_b.date").alias("date"), F.col("_b.price").alias("price"))
        )
        df = recent.unionByName(last_before)
    out = previous_bar(df, ["price"]).select(
        "symbol",
        entity_key("symbol").alias("stock_id"),
        "date",
        _change(F.col("price"), F.col("_prev.price")).alias("weekly_ret"),
    )
    if since is not None:
        out = out.filter(F.col("date") >= F.lit(since))
    return out
