"""Query registry: key -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from growret.plans.finalize import finalize, sql_finalize
from growret.sources.store import model_tables, shared


@dataclass
class Query:
    key: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    order: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = finalize(self.build(model_tables(spark, sf_dir, now=())))
        if self.order is None:
            return out
        # the place of each row in the result as returned; these results are
        # bounded by bins, months, hits or stages, so one task numbers them
        return out.withColumn("position", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = sql_finalize(self.sql, self.doubles)
        if self.order is None:
            return body
        return f"SELECT *, CAST(row_number() OVER (ORDER BY {self.order}) AS INTEGER) AS position FROM (\n{body}\n) AS ordered"


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None = None, doubles: tuple[str, ...] = (), order: str | None = None):
    """``order`` is SQL for the row order the result promises; it adds a ``position`` column to both engines."""

    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, sql, tuple(doubles), order)
        return fn

    return deco


# Shared inputs: intermediate results several queries start from, stored
# once per model-table set (like the reference's cached fetch results).
SHARED: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}


def register_shared(name: str):
    def deco(fn):
        if name in SHARED:
            raise KeyError(f"duplicate shared input {name}")
        SHARED[name] = fn
        return fn

    return deco


def shared_input(tables: dict[str, DataFrame], name: str) -> DataFrame:
    return shared(tables, name, SHARED[name])


def load_all() -> dict[str, Query]:
    from growret.plans import q_bursts, q_heatmap, q_loads, q_sql, q_timing  # noqa: F401  (registration side effects)

    return REGISTRY
