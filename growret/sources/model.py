"""The four model tables, their schemas, and loaders.

The analyses read four tables:

* ``stock_annual_k``  one bar per symbol and year
* ``monthly_revenue`` one growth row per entity and report month (``YYY_MM``,
  YYY = Gregorian year - 1911, zero padded to three digits)
* ``stock_weekly_k``  one bar per symbol and week
* ``stock_prices``    only ``MAX(date)`` is read

They can come from parquet folders, from a JDBC database, or be derived from
the star-schema test tables (:mod:`growret.sources.fixtures`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growret.functions.periods import report_month_text

MODEL_SCHEMAS: dict[str, T.StructType] = {
    "stock_annual_k": T.StructType(
        [
            T.StructField("symbol", T.StringType(), False),
            T.StructField("year", T.StringType(), False),
            T.StructField("year_open", T.DoubleType(), True),
            T.StructField("year_high", T.DoubleType(), True),
            T.StructField("year_close", T.DoubleType(), True),
        ]
    ),
    "monthly_revenue": T.StructType(
        [
            T.StructField("stock_id", T.StringType(), False),
            T.StructField("stock_name", T.StringType(), True),
            T.StructField("report_month", T.StringType(), False),
            T.StructField("yoy_pct", T.DoubleType(), True),
            T.StructField("mom_pct", T.DoubleType(), True),
            T.StructField("remark", T.StringType(), True),
        ]
    ),
    "stock_weekly_k": T.StructType(
        [
            T.StructField("symbol", T.StringType(), False),
            T.StructField("date", T.DateType(), False),
            T.StructField("w_close", T.DoubleType(), True),
            T.StructField("w_high", T.DoubleType(), True),
        ]
    ),
    "stock_prices": T.StructType([T.StructField("date", T.DateType(), True)]),
}

MODEL_TABLES = tuple(MODEL_SCHEMAS)

#: Columns a stored table may hold beside the declared ones (``store.store_model_tables`` adds them).
PREPARED: dict[str, dict[str, str]] = {
    "stock_annual_k": {"stock_id": "string"},
    "stock_weekly_k": {"stock_id": "string", "prev_close": "double", "prev_high": "double"},
}


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """Select and cast the declared columns of ``name`` and those prepared ones
    it has; fail on missing ones."""
    schema = MODEL_SCHEMAS[name]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks columns {missing}")
    prepared = {c: t for c, t in PREPARED.get(name, {}).items() if c in df.columns}
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields],
        *[F.col(c).cast(t).alias(c) for c, t in prepared.items()],
    )


def jdbc_predicates(name: str, years: range) -> list[str]:
    """Disjoint conditions that cover every row of a table, one per year or
    report month of ``years`` and one for all other rows (NULL keys too).

    The keys of the two largest tables are texts, which numeric bounds cannot
    split; each condition becomes one task with a connection of its own."""
    if name == "stock_annual_k":
        column, values = "year", [str(y) for y in years]
    elif name == "monthly_revenue":
        column, values = "report_month", [report_month_text(y, m) for y in years for m in range(1, 13)]
    else:
        spans = [(f"{y}-01-01", f"{y + 1}-01-01") for y in years]
        inside = [f"date >= DATE '{a}' AND date < DATE '{b}'" for a, b in spans]
        return [*inside, f"date < DATE '{spans[0][0]}' OR date >= DATE '{spans[-1][1]}' OR date IS NULL"] if spans else ["1 = 1"]
    if not values:
        return ["1 = 1"]
    listed = ", ".join(f"'{v}'" for v in values)
    return [*[f"{column} = '{v}'" for v in values], f"{column} NOT IN ({listed}) OR {column} IS NULL"]


def load_model_tables(
    spark: SparkSession,
    path: str | None = None,
    *,
    jdbc_url: str | None = None,
    jdbc_properties: dict | None = None,
    jdbc_partitions: dict | None = None,
    jdbc_years: range = range(2010, 2031),
) -> dict[str, DataFrame]:
    """Load the model tables from ``{path}/{name}`` parquet folders, or over JDBC.

    Over JDBC each table is read by parallel queries: one per year or report
    month of ``jdbc_years`` and one for the rest (:func:`jdbc_predicates`).
    ``jdbc_partitions`` maps a table name to other options of
    ``spark.read.jdbc``, such as ``dict(predicates=[...])`` or ``dict(column=,
    lowerBound=, upperBound=, numPartitions=)``.
    """
    out: dict[str, DataFrame] = {}
    for name in MODEL_TABLES:
        if jdbc_url is not None:
            opts = (jdbc_partitions or {}).get(name) or {"predicates": jdbc_predicates(name, jdbc_years)}
            df = spark.read.jdbc(jdbc_url, name, properties=jdbc_properties or {}, **opts)
        elif path is not None:
            df = spark.read.parquet(f"{path}/{name}")
        else:
            raise ValueError("give a parquet path or a JDBC url")
        out[name] = check_schema(df, name)
    return out
