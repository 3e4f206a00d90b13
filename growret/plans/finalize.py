"""Output normalization shared by the registered queries and their oracle.

Floating results are rounded to 6 decimals through DECIMAL(38,10) on both
engines, so summation-order noise (last bits) cannot make equal answers look
different; NaN, infinities and values of 1e27 and more pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fits = ~F.isnan(c) & (F.abs(c) < F.lit(1e27))
            c = F.when(fits, F.round(c.try_cast("decimal(38,10)"), DIGITS).cast("double")).otherwise(c.cast("double"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sql_finalize(body: str, doubles: list[str] | tuple[str, ...]) -> str:
    """Wrap an oracle query so its double columns get the same rounding."""
    if not doubles:
        return body
    reps = ", ".join(
        f"CASE WHEN isfinite({c}) AND abs({c}) < 1e27 THEN CAST(ROUND(TRY_CAST({c} AS DECIMAL(38,10)), {DIGITS}) AS DOUBLE) "
        f"ELSE CAST({c} AS DOUBLE) END AS {c}"
        for c in doubles
    )
    return f"SELECT * REPLACE ({reps}) FROM (\n{body}\n) AS q"
