"""Incremental load of the model tables: new lines are merged folder by folder.

The tables lie under one root on shared storage, each in folders by time:
``cells`` (the mergeable state of a supplier's day) and ``monthly_revenue`` by
month, ``stock_annual_k`` by year, ``stock_weekly_k`` by the month its week
starts in.  A load reads its own lines and the folders they touch, never the
lines of earlier loads:

1. the new lines, each as a cell of its own, are dealt out by month and supplier
   together with the stored cells of their months (late lines of old months too);
   one aggregation, after one shuffle, writes the cells to ``staged/{load}`` by month;
2. the months' folders are replaced from there by dynamic partition overwrite,
   file by file, without a shuffle;
3. the folders of the model tables that depend on them are derived again: the
   months themselves, the next ones (growth to the month before) and those a
   year later (growth to the year before), the years, and the weeks.

Steps 2 and 3 depend on the staged cells alone, so a load that was interrupted
is finished by running it again, or by the next load, and adds nothing twice.  A
load's name is remembered: loading it again does nothing.  One writer at a time.

What reaches the driver is the list of touched months, and how many lines and cells each has.  Defined results: lines
without a supplier, a ship date or a known part are in no model table, as these
declare their keys not null; the name of a line's part is the one it had when
the line was loaded; an empty load leaves all folders alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.functions.periods import report_month_text
from growret.functions.returns import entity_key
from growret.sources import fixtures
from growret.sources.model import MODEL_SCHEMAS

#: Folder column of each stored table, and the columns its rows are clustered by (staged cells lie in their folders).
FOLDERS = {
    "cells": ("month", []),
    "monthly_revenue": ("report_month", ["stock_id"]),
    "stock_annual_k": ("year", ["symbol"]),
    "stock_weekly_k": ("bar_month", ["date", "symbol"]),
}
#: Rows of a month that one task merges, about.
SHARE = 250_000
_CELLS = (
    "l_suppkey bigint, d date, amt decimal(28,4), n bigint, top_name string, px_first double, line_first decimal(38,0), "
    "px_last double, line_last decimal(38,0), px_high double, month string"
)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def month_after(month: str, by: int) -> str:
    """``YYYY-MM`` ``by`` months later."""
    no = int(month[:4]) * 12 + int(month[5:]) - 1 + by
    return f"{no // 12:04d}-{no % 12 + 1:02d}"


def _overwrite(df: DataFrame, root: str, table: str) -> None:
    """Replace the folders of ``table`` that ``df`` has rows of."""
    folder, cluster = FOLDERS[table]
    df = df.repartitionByRange(folder, *cluster) if cluster else df
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w.partitionBy(folder).parquet(f"{root}/{table}")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], _CELLS)
    return spark.read.schema(_CELLS).parquet(path)


def lines_as_cells(lines: DataFrame, part: DataFrame) -> DataFrame:
    """Each line with a known part as a cell, as cells are stored: with the ends' places, so that cells can be merged later."""
    rows = fixtures.line_values(_known(lines), part, "p_name")
    return _as_stored(
        rows.select(
            "l_suppkey", "d", "amt", F.lit(1).alias("n"), F.col("p_name").alias("top_name"),
            F.when(F.col("line").isNotNull(), F.col("px")).alias("px_first"), F.col("line").alias("line_first"),
            F.when(F.col("line").isNotNull(), F.col("px")).alias("px_last"), F.col("line").alias("line_last"),
            F.col("px").alias("px_high"), F.date_format("d", "yyyy-MM").alias("month"),
        )
    )


def _known(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull())


def _as_stored(cells: DataFrame) -> DataFrame:
    fields = [f.strip().split(" ", 1) for f in re.split(r",(?![^(]*\))", _CELLS)]
    return cells.select(*[F.col(c).cast(t).alias(c) for c, t in fields])


def merged(cells: DataFrame, rows: dict[str, int]) -> DataFrame:
    """One cell for each supplier and day of ``cells``, which has about so many ``rows`` of each month.

    They are dealt out by month and a share of the suppliers, at most so many
    that a share has ``SHARE`` rows; a task writes few folders then, and the
    largest month is no larger a task than others.
    """
    shares = 1 + max(rows.values(), default=0) // SHARE
    tasks = 1 + sum(rows.values()) // SHARE
    by = ["month", "share", "l_suppkey", "d"]
    dealt = cells.withColumn("share", F.pmod(F.xxhash64("l_suppkey"), F.lit(shares))).repartition(tasks, "month", "share")
    ends = [
        e for name, pick, edge in (("first", F.min_by, F.min), ("last", F.max_by, F.max))
        for e in (pick(f"px_{name}", f"line_{name}").alias(f"px_{name}"), edge(f"line_{name}").alias(f"line_{name}"))
    ]
    sums = [F.sum("amt").alias("amt"), F.sum("n").alias("n")]
    return _as_stored(dealt.groupBy(*by).agg(*sums, F.max("top_name").alias("top_name"), *ends, F.max("px_high").alias("px_high")))


def _rows_by_month(cells: DataFrame) -> dict[str, int]:
    return {r["month"]: r["count"] for r in cells.groupBy("month").count().collect()}


def load_lines(spark: SparkSession, root: str, load: str, lines: DataFrame, part: DataFrame, supplier: DataFrame) -> bool:
    """Merge ``lines`` (columns of ``fixtures.read_star``) into the tables under ``root``; False if ``load`` was loaded before.

    Loads that were interrupted are finished first."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", load):
        raise ValueError(f"a load's name has letters, digits, _ and - only: {load!r}")
    root = root.rstrip("/")
    for name in _names(spark, f"{root}/staged"):
        if _exists(spark, f"{root}/staged/{name}/cells/_SUCCESS") or _exists(spark, f"{root}/loads/{name}"):
            _finish(spark, root, name, supplier)
    if _exists(spark, f"{root}/loads/{load}"):
        return False
    new = lines_as_cells(lines, part)
    rows = _rows_by_month(_known(lines).select(F.date_format("l_shipdate", "yyyy-MM").alias("month")))
    old = read_cells(spark, f"{root}/cells").filter(F.col("month").isin(list(rows)))
    for month, n in _rows_by_month(old).items():
        rows[month] += n
    cells = merged(old.unionByName(new), rows)
    cells.write.mode("overwrite").partitionBy("month").parquet(f"{root}/staged/{load}/cells")
    _finish(spark, root, load, supplier)
    return True


def _finish(spark: SparkSession, root: str, load: str, supplier: DataFrame) -> None:
    staged, done = f"{root}/staged/{load}", f"{root}/loads/{load}"
    if not _exists(spark, done):
        cells = read_cells(spark, f"{staged}/cells")
        months = sorted(r.month for r in cells.select("month").distinct().collect())
        if months:
            _overwrite(cells, root, "cells")
            _derive(spark, root, months, supplier)
        fs, at = _fs(spark, done)
        fs.mkdirs(at.getParent())
        fs.create(at, True).close()
    fs, at = _fs(spark, staged)
    fs.delete(at, True)


def _derive(spark: SparkSession, root: str, months: list[str], supplier: DataFrame) -> None:
    """Derive the folders of the model tables again that depend on the cells of ``months``."""
    cells = read_cells(spark, f"{root}/cells")

    def of(wanted: set[str]) -> DataFrame:
        return cells.filter(F.col("month").isin(sorted(wanted)))

    def reach(base, *steps: int) -> set[str]:
        return {month_after(m, k) for m in base for k in steps}

    report = reach(months, 0, 1, 12)
    # ranks in the order of the names that these cells hold
    needed = of(reach(report, 0, -1, -12))
    ranks_at = f"{root}/names/{'-'.join((months[0], months[-1]))}"
    fixtures.name_ranks(needed.select(F.col("top_name").alias("p_name")).distinct()).write.mode("overwrite").parquet(ranks_at)
    ranks = spark.read.parquet(ranks_at)
    ranked = needed.join(ranks, F.col("top_name").eqNullSafe(F.col("p_name")), "inner").drop("p_name")
    texts = [report_month_text(int(m[:4]), int(m[5:])) for m in sorted(report)]
    _overwrite(fixtures.monthly_revenue(ranked, supplier, ranks).filter(F.col("report_month").isin(texts)), root, "monthly_revenue")
    fs, at = _fs(spark, ranks_at)
    fs.delete(at, True)

    years = {m[:4] for m in months}
    annual = fixtures.stock_annual_k(of({f"{y}-{k:02d}" for y in years for k in range(1, 13)}))
    _overwrite(annual.withColumn("stock_id", entity_key("symbol")), root, "stock_annual_k")

    starts = reach(months, 0, -1)  # a week may start in the month before
    weekly = fixtures.stock_weekly_k(of(reach(starts, 0, 1))).withColumn("bar_month", F.date_format("date", "yyyy-MM"))
    _overwrite(weekly.filter(F.col("bar_month").isin(sorted(starts))), root, "stock_weekly_k")


def loaded_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The model tables under ``root``, as all analyses take them."""
    root = root.rstrip("/")
    out = {}
    for name, (folder, _) in FOLDERS.items():
        if name == "cells":
            continue
        columns = [f"{f.name} {f.dataType.simpleString()}" for f in MODEL_SCHEMAS[name].fields]
        columns += ["stock_id string"] if name == "stock_annual_k" else []
        kept = [c.split(" ")[0] for c in columns]
        columns += [] if folder in kept else [f"{folder} string"]
        at = f"{root}/{name}"
        schema = ", ".join(columns)
        df = spark.read.schema(schema).parquet(at) if _exists(spark, at) else spark.createDataFrame([], schema)
        out[name] = df.select(*kept)
    cells = read_cells(spark, f"{root}/cells")
    return out | {"stock_prices": fixtures.stock_prices(cells), "price_days": cells.select(F.col("d").alias("date"))}
