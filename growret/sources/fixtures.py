"""Model tables derived from the star-schema test tables.

Entity = supplier, price = unit price of a line (extended price / quantity),
revenue = discounted line value summed per month.  The definitions equal the
text in FIXTURES.md, which also runs in DuckDB as the oracle's CTE prefix.

Plan shape: lineitem is joined to part's name ranks and scanned once; one hash
aggregation reduces it to (supplier, day) cells.  The model tables are
roll-ups of that cell table, so the large shuffle happens once.  Every buffer
of the aggregation has a fixed width -- sums, counts, a price by the smallest
or largest line number, and for the largest part name its rank in the order
of all names -- so Spark combines in hash maps and never sorts the lines.

Most days of a supplier have one line, so combining before the shuffle would
save nothing and only fill memory: the lines are dealt out first, by supplier
and month, to tasks of about ``LINES`` lines, whatever the input's size.  The
months of a supplier then lie in one file each, which the roll-ups combine
before their own shuffles.  A supplier holding a third of all lines is spread
over its months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the fixture definition: entity codes zero-padded to six
# digits at least, suffix '.TW' for even supplier keys and '.TWO' for odd
# ones, remark codes by line count (1 -> '-', 2 -> '', 3 -> NULL, else the
# largest part name).
ID_WIDTH = 6
EVEN_SUFFIX = ".TW"
ODD_SUFFIX = ".TWO"
MINGUO_OFFSET = 1911
#: Lines that one task aggregates, about.
LINES = 400_000


def read_star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate",
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    return {"lineitem": li, "part": part, "supplier": supplier}


def name_ranks(part: DataFrame) -> DataFrame:
    """p_partkey, p_name, name_rank: rises with the name.  To be stored before
    use, as the ids follow the sort's partitions."""
    return part.orderBy("p_name").withColumn("name_rank", F.monotonically_increasing_id())


def line_values(lineitem: DataFrame, part: DataFrame, name: str) -> DataFrame:
    """Lines with a known part: supplier, day ``d``, column ``name`` of the part, ``amt``, ``px`` and their place ``line``.

    A day's lines are ordered by (time, order, line number, price, quantity).
    The five are the digits of one number, whose casts fail loudly if a value
    has more digits than its place."""
    places = [
        (F.hour("l_shipdate") * 3600 + F.minute("l_shipdate") * 60 + F.second("l_shipdate"), 5),
        (F.col("l_orderkey"), 16),
        (F.col("l_linenumber"), 4),
        (F.round(F.col("l_extendedprice") * 100), 10),
        (F.round(F.col("l_quantity")), 3),
    ]
    digits = F.concat(*[F.lpad(c.cast(f"decimal({n},0)").cast("string"), n, "0") for c, n in places])
    return lineitem.join(part.select("p_partkey", name), F.col("l_partkey") == F.col("p_partkey"), "inner").select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("d"),
        name,
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("amt"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        digits.cast("decimal(38,0)").alias("line"),
    )


def line_cells(lineitem: DataFrame, ranks: DataFrame) -> DataFrame:
    """(supplier, day) cells of lineitem x part: the one heavy pass."""
    month = F.year("d") * 12 + F.month("d")
    rows = line_values(lineitem, ranks, "name_rank").withColumn("_month", month)
    rows = rows.repartition(1 + lineitem.count() // LINES, "l_suppkey", "_month")
    return rows.groupBy("l_suppkey", "_month", "d").agg(
        F.sum("amt").alias("amt"),
        F.count(F.lit(1)).alias("n"),
        F.max("name_rank").alias("name_rank"),
        F.min_by("px", "line").alias("px_first"),
        F.max_by("px", "line").alias("px_last"),
        F.max("px").alias("px_high"),
    ).drop("_month")


def _stock_id(suppkey: Column) -> Column:
    text = suppkey.cast("string")
    return F.when(F.length(text) < ID_WIDTH, F.lpad(text, ID_WIDTH, "0")).otherwise(text)


def _symbol(suppkey: Column) -> Column:
    return F.concat(
        _stock_id(suppkey),
        F.when(suppkey % 2 == 0, F.lit(EVEN_SUFFIX)).otherwise(F.lit(ODD_SUFFIX)),
    )


def monthly_revenue(cells: DataFrame, supplier: DataFrame, ranks: DataFrame) -> DataFrame:
    rev = cells.groupBy("l_suppkey", F.to_date(F.date_trunc("month", "d")).alias("mon")).agg(
        F.sum("amt").cast("double").alias("revenue"),
        F.sum("n").alias("n"),
        F.max("name_rank").alias("name_rank"),
    )
    # Revenue exactly one and twelve months earlier (NULL when that month is
    # missing): a range frame over a month index selects precisely that row,
    # like the fixture's self joins, with a single shuffle by supplier whose
    # partitions hold one row per month.
    idx = F.year("mon") * 12 + F.month("mon")
    by_supp = Window.partitionBy("l_suppkey").orderBy(idx)
    r = rev.select(
        "*",
        F.max("revenue").over(by_supp.rangeBetween(-1, -1)).alias("rev_prev"),
        F.max("revenue").over(by_supp.rangeBetween(-12, -12)).alias("rev_year_ago"),
    ).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "inner")
    r = r.join(ranks.select("name_rank", "p_name"), "name_rank", "inner")
    report_month = F.concat(
        F.lpad((F.year("mon") - MINGUO_OFFSET).cast("string"), 3, "0"),
        F.lit("_"),
        F.lpad(F.month("mon").cast("string"), 2, "0"),
    )
    remark = (
        F.when(F.col("n") == 1, F.lit("-"))
        .when(F.col("n") == 2, F.lit(""))
        .when(F.col("n") == 3, F.lit(None).cast("string"))
        .otherwise(F.col("p_name"))
    )
    return r.select(
        _stock_id(F.col("l_suppkey")).alias("stock_id"),
        F.col("s_name").alias("stock_name"),
        report_month.alias("report_month"),
        ((F.col("revenue") - F.col("rev_year_ago")) / F.col("rev_year_ago") * 100).alias("yoy_pct"),
        ((F.col("revenue") - F.col("rev_prev")) / F.col("rev_prev") * 100).alias("mom_pct"),
        remark.alias("remark"),
    )


def stock_annual_k(cells: DataFrame) -> DataFrame:
    a = cells.groupBy("l_suppkey", F.year("d").alias("yr")).agg(
        F.min_by("px_first", "d").alias("year_open"),
        F.max("px_high").alias("year_high"),
        F.max_by("px_last", "d").alias("year_close"),
    )
    return a.select(
        _symbol(F.col("l_suppkey")).alias("symbol"),
        F.col("yr").cast("string").alias("year"),
        "year_open", "year_high", "year_close",
    )


def stock_weekly_k(cells: DataFrame) -> DataFrame:
    w = cells.groupBy("l_suppkey", F.to_date(F.date_trunc("week", "d")).alias("wk")).agg(
        F.max_by("px_last", "d").alias("w_close"),
        F.max("px_high").alias("w_high"),
    )
    return w.select(_symbol(F.col("l_suppkey")).alias("symbol"), F.col("wk").alias("date"), "w_close", "w_high")


def stock_prices(cells: DataFrame) -> DataFrame:
    """The date of every line, from the cells' counts."""
    return cells.select(F.explode(F.array_repeat("d", F.col("n").cast("int"))).alias("date"))


def derive_model_tables(cells: DataFrame, supplier: DataFrame, ranks: DataFrame) -> dict[str, DataFrame]:
    return {
        "stock_annual_k": stock_annual_k(cells),
        "monthly_revenue": monthly_revenue(cells, supplier, ranks),
        "stock_weekly_k": stock_weekly_k(cells),
        "stock_prices": stock_prices(cells),
    }
