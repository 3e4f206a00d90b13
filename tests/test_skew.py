"""A hot key: one supplier and one part hold a third of all lines.

The skewed star is written from the sf0.001 tables; the derived model tables
and a set of registered queries must still equal the DuckDB oracle on the
same files."""

import duckdb
import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from growret.plans.sqltext import FIXTURE_CTES
from growret.sources.store import model_tables
from tests.conftest import SF_SMALL
from tests.test_parity import _norm

HOT_SUPP, HOT_PART = 1, 1
KEYS = ["heatmap_median", "bin_summary", "bin_findings", "bin_drilldown", "bin_drilldown_keyword", "burst_distribution", "event_study", "stage_stats", "latest_remark"]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    d = tmp_path_factory.mktemp("skewed")
    li = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    hot = np.zeros(li.num_rows, dtype=bool)
    hot[::3] = True
    for col, val in (("l_suppkey", HOT_SUPP), ("l_partkey", HOT_PART)):
        i = li.schema.get_field_index(col)
        li = li.set_column(i, col, pc.if_else(hot, pc.cast(val, li.schema.field(col).type), li[col]))
    pq.write_table(li, d / "lineitem.parquet")
    for name in ("part", "supplier"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{name}.parquet"), d / f"{name}.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet')")
    return str(d), con


def test_skewed_derived_tables(spark, skewed):
    d, con = skewed
    for name in ("monthly_revenue", "stock_annual_k", "stock_weekly_k"):
        s = model_tables(spark, d)[name].toPandas()
        o = con.execute(f"WITH {FIXTURE_CTES} SELECT * FROM {name}").df()
        assert _norm(s[o.columns]) == _norm(o), name


@pytest.mark.parametrize("key", KEYS)
def test_skewed_queries(spark, skewed, key):
    d, con = skewed
    s = E.queries()[key](spark, d).toPandas()
    o = con.execute(E.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert _norm(s) == _norm(o), key


def test_long_supplier_keys_stay_apart(spark, tmp_path):
    """Entity ids are padded to six digits, never cut: keys beyond 1,000,000 stay different entities."""
    li = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    sup = pq.read_table(f"{SF_SMALL}/supplier.parquet")
    big = 2_000_000
    for table, name, col in ((li, "lineitem", "l_suppkey"), (sup, "supplier", "s_suppkey")):
        i = table.schema.get_field_index(col)
        pq.write_table(table.set_column(i, col, pc.add(table[col], pc.cast(big, table.schema.field(col).type))), tmp_path / f"{name}.parquet")
    pq.write_table(pq.read_table(f"{SF_SMALL}/part.parquet"), tmp_path / "part.parquet")
    t = model_tables(spark, str(tmp_path))
    n = pc.count_distinct(li["l_suppkey"]).as_py()
    assert t["monthly_revenue"].select("stock_id").distinct().count() == n
    assert t["stock_annual_k"].select("symbol").distinct().count() == n
    assert t["monthly_revenue"].groupBy("stock_id", "report_month").count().filter("count > 1").count() == 0
