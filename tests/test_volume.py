"""What a query stores and shuffles: only the tables that it reads, and no line or bar more often than needed."""

import os
import re

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from growret.functions.returns import with_previous
from growret.sources import fixtures, incremental
from growret.sources.fixtures import line_cells, name_ranks, read_star
from growret.sources.store import model_tables
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def star_dir(tmp_path):
    li = pq.read_table(f"{SF_SMALL}/lineitem.parquet").slice(0, 2000)
    pq.write_table(li, tmp_path / "lineitem.parquet")
    for name in ("part", "supplier"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{name}.parquet"), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def _stored(spark, d):
    root = model_tables(spark, d, now=()).root.removeprefix("file:")
    return {x for x in os.listdir(root) if not x.startswith(".")} if os.path.exists(root) else set()


@pytest.mark.parametrize("key", ["heatmap_median", "heatmap_totals", "heatmap_mean", "sql_heatmap_mean"])
def test_a_heatmap_stores_no_weekly_bars(spark, star_dir, key):
    E.queries()[key](spark, star_dir).collect()
    assert _stored(spark, star_dir) == {"name_ranks", "cells", "supplier", "stock_annual_k", "monthly_revenue"}
    t = model_tables(spark, star_dir)
    assert t["stock_weekly_k"].count() > 0 and "stock_weekly_k" in _stored(spark, star_dir)  # stored when asked for
    assert "nothing" not in t and len(dict(t)) == len(t) == 5
    with pytest.raises(KeyError):
        t["nothing"]


def test_a_load_stores_no_tables_of_all_lines(spark, star_dir):
    rows = E.queries()["loaded_annual_bars"](spark, star_dir).count()
    assert _stored(spark, star_dir) == {"loaded"}
    assert rows == model_tables(spark, star_dir)["stock_annual_k"].count()


def test_lines_are_dealt_out_before_they_are_combined(spark, star_dir, monkeypatch):
    star = read_star(spark, star_dir)
    plan = _plan(line_cells(star["lineitem"], name_ranks(star["part"])))
    dealt = plan.index("REPARTITION_BY_NUM")
    assert plan.rindex("HashAggregate") < dealt  # all of them above it: nothing is combined on the way to the shuffle
    monkeypatch.setattr(fixtures, "LINES", 500)
    cells = line_cells(star["lineitem"], name_ranks(star["part"]))
    assert "REPARTITION_BY_NUM" in _plan(cells) and cells.rdd.getNumPartitions() == 5  # 2000 lines, at most 500 each
    assert cells.columns == ["l_suppkey", "d", "amt", "n", "name_rank", "px_first", "px_last", "px_high"]


def test_bars_are_shuffled_once_for_their_previous_ones(spark):
    bars = spark.createDataFrame([("1.TW", None, 1.0, 2.0), (None, None, 3.0, 4.0)], "symbol string, date date, w_close double, w_high double")
    out = with_previous(bars)
    assert out.count() == len(out.collect()) == 2
    plan = _plan(out)
    assert plan.count("REPARTITION_BY_COL") >= 1 and "ReusedExchange" in plan and "SortAggregate" not in plan


def test_a_load_merges_lines_with_one_shuffle(spark, star_dir, tmp_path, monkeypatch):
    star, root = read_star(spark, star_dir), str(tmp_path / "root")
    lines = incremental.lines_as_cells(star["lineitem"], star["part"])
    plan = _plan(incremental.merged(lines, {"1996-01": 600_000}))
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) == 1 and "Join" not in plan.split("Exchange hashpartitioning")[0]
    seen = {}
    real = incremental._overwrite
    monkeypatch.setattr(incremental, "_overwrite", lambda df, root, table: (seen.update({table: _plan(df)}), real(df, root, table)))
    monkeypatch.setattr(incremental, "SHARE", 7)  # several shares of a month, several tasks
    for name, half in (("a", "l_linenumber < 3"), ("b", "l_linenumber >= 3")):
        assert incremental.load_lines(spark, root, name, star["lineitem"].filter(half), star["part"], star["supplier"])
    assert "Exchange" not in seen["cells"] and incremental.FOLDERS["cells"] == ("month", [])
    full, got = model_tables(spark, star_dir), incremental.loaded_tables(spark, root)
    for table in ("stock_annual_k", "monthly_revenue"):
        assert sorted(map(str, got[table].collect())) == sorted(map(str, full[table].select(got[table].columns).collect()))
    assert got["stock_prices"].count() == full["stock_prices"].count() == 2000
