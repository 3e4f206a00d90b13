"""SQL functions for the derived columns, so that queries can be written in SQL alone.

Each one is a temporary function whose body is a SQL expression: Spark puts the
expression in the place of the call, so filters still reach the scan, constants
fold and the plan has no user-defined function left.  Their values equal those
of the Column functions in :mod:`growret.functions.returns` and
:mod:`growret.functions.periods`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from growret.functions.periods import MINGUO_OFFSET
from growret.functions.returns import BIN_LABELS, DOWN_EDGES, TOP_BIN, UP_EDGES


def _bin_case(r: str) -> str:
    first, *others = DOWN_EDGES
    arms = [f"WHEN {r} <= {first} THEN 0"]
    arms += [f"WHEN {r} < {edge} THEN {k}" for k, edge in enumerate([*others, *UP_EDGES], start=1)]
    return f"CASE {' '.join(arms)} ELSE {TOP_BIN} END"


def _bodies() -> dict[str, tuple[str, str]]:
    """name(arguments) -> (type, expression), each only using those before it."""
    labels = ", ".join(f"'{x}'" for x in BIN_LABELS)
    year, month = "try_cast(split_part(m, '_', 1) AS INT)", "try_cast(split_part(m, '_', 2) AS INT)"
    return {
        "entity_key(symbol STRING)": ("STRING", "split_part(symbol, '.', 1)"),
        "pct_change(new DOUBLE, base DOUBLE)": ("DOUBLE", "try_divide(new - base, base) * 100"),
        "weekly_change(price DOUBLE, previous DOUBLE)": ("DOUBLE", "try_divide(price - previous, nullif(previous, 0D)) * 100"),
        "return_bin(r DOUBLE)": ("INT", _bin_case("r")),
        "return_bin_label(bin INT)": ("STRING", f"element_at(array({labels}), bin + 1)"),
        "report_month_text(y INT, mo INT)": (
            "STRING",
            f"concat(lpad(CAST(y - {MINGUO_OFFSET} AS STRING), 3, '0'), '_', lpad(CAST(mo AS STRING), 2, '0'))",
        ),
        "report_period(m STRING)": (
            "DATE",
            f"CASE WHEN m RLIKE '^[0-9]{{3}}_[0-9]{{2}}$' AND {month} BETWEEN 1 AND 12 THEN make_date({year} + {MINGUO_OFFSET}, {month}, 1) END",
        ),
        "announcement_date(m STRING)": ("DATE", "date_add(add_months(report_period(m), 1), 9)"),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for head, (kind, body) in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in _bodies()]
