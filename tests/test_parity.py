"""Every registered query against its DuckDB oracle, plus the derived tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from growret.plans.registry import load_all
from growret.plans.sqltext import FIXTURE_CTES
from growret.sources.store import model_tables
from tests.conftest import SF_MID, SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def mid():
    c = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    return c


def _norm(df: pd.DataFrame):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        elif df[c].dtype.kind == "M":
            df[c] = df[c].dt.date
        df[c] = df[c].astype(str)
    return sorted(map(tuple, df.values.tolist()))


@pytest.mark.parametrize("name,cols", [
    ("monthly_revenue", ["stock_id", "report_month"]),
    ("stock_annual_k", ["symbol", "year"]),
    ("stock_weekly_k", ["symbol", "date"]),
    ("stock_prices", ["date"]),
])
def test_derived_tables(spark, con, name, cols):
    s = model_tables(spark, SF_SMALL)[name].toPandas()
    d = con.execute(f"WITH {FIXTURE_CTES} SELECT * FROM {name}").df()
    assert set(d.columns) <= set(s.columns)  # the stored tables may hold prepared columns beside the declared ones
    assert _norm(s[d.columns]) == _norm(d)


KEYS = sorted(load_all())


def test_every_query_has_oracle():
    assert all(q.sql for q in load_all().values())
    assert load_all().keys() <= E.queries().keys() and load_all().keys() <= E.oracle_sql().keys()


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    s = E.queries()[key](spark, SF_SMALL).toPandas()
    d = con.execute(E.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(d.columns), key
    assert len(s) == len(d)
    assert _norm(s) == _norm(d)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["return_bin", "bin_order", "report_month"]
    assert df.count() > 0


ORDERED = {  # rows as numerous as the entities or events: no position column, so their order is compared here
    "event_study": "pre_month DESC NULLS FIRST, stock_id, report_month",
    "event_study_high": "pre_month DESC NULLS FIRST, stock_id, report_month",
    "report_slices": None,
    "burst_list": None,
    "bin_drilldown": None,
}


@pytest.mark.parametrize("key", sorted(ORDERED))
def test_row_order(spark, mid, key):
    s = E.queries()[key](spark, SF_MID).toPandas()
    sql = E.oracle_sql()[key]
    d = mid.execute(sql if ORDERED[key] is None else f"SELECT * FROM ({sql}) ORDER BY {ORDERED[key]}").df()
    assert len(s) > 5
    plain = lambda df: [tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in df[sorted(d.columns)].values]
    assert plain(s) == plain(d)


@pytest.mark.parametrize("column", ["annual_return", "yoy_mean", "mom_mean", "yoy_std", "mom_std"])
def test_resorted_drilldown(spark, column):
    from growret.operators.heatmap import bin_drilldown

    t = model_tables(spark, SF_MID)
    rows = bin_drilldown(t["stock_annual_k"], t["monthly_revenue"], year=1998, bin_order=11, limit=30, resort=column).collect()
    got = [(-float("inf") if r[column] is None else r[column], r["stock_id"]) for r in rows]
    assert len(got) > 5 and got == sorted(got, key=lambda x: (-x[0], x[1]))


def test_positions_number_the_rows_as_returned(spark):
    for key, q in load_all().items():
        if q.order:
            df = q.run(spark, SF_SMALL).toPandas()
            assert df["position"].tolist() == list(range(1, len(df) + 1)), key


def test_building_a_percentile_query_runs_no_job(spark):
    model_tables(spark, SF_SMALL)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "plans", False)
    try:
        for key in ("heatmap_median", "bin_summary", "burst_distribution", "multi_year_stats", "bin_list_desc", "multi_year_mean_pivot"):
            load_all()[key].run(spark, SF_SMALL)
        assert tracker.getJobIdsForGroup("build-only") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
