"""Loads merged folder by folder equal a full rebuild, whatever the order and the interruptions."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from growret.sources import incremental as I
from growret.sources.fixtures import derive_model_tables, line_cells, name_ranks, read_star
from tests.conftest import SF_SMALL

TABLES = ("monthly_revenue", "stock_annual_k", "stock_weekly_k", "stock_prices")


def rows(df):
    got = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect()]
    return sorted(got, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    s = read_star(spark, SF_SMALL)
    at = str(tmp_path_factory.mktemp("star") / "lineitem")
    s["lineitem"].filter(F.year("l_shipdate").isin(1995, 1996)).write.parquet(at)
    return s | {"lineitem": spark.read.parquet(at)}


@pytest.fixture(scope="module")
def full(spark, star, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("full") / "ranks")
    name_ranks(star["part"]).write.parquet(at)
    ranks = spark.read.parquet(at)
    tables = derive_model_tables(line_cells(star["lineitem"], ranks), star["supplier"], ranks)
    return {k: rows(tables[k]) for k in TABLES}


def pieces(lines):
    late = F.col("l_linenumber") > 3
    old = F.col("l_shipdate") < F.lit("1996-03-15").cast("timestamp")
    return {"a": lines.filter(old & ~late), "b": lines.filter(~old & ~late), "c": lines.filter(late)}


def load(spark, root, name, lines, star):
    return I.load_lines(spark, root, name, lines, star["part"], star["supplier"])


def same(spark, root, full):
    got = I.loaded_tables(spark, root)
    for k in TABLES:
        assert rows(got[k].drop("stock_id") if k == "stock_annual_k" else got[k]) == full[k], k


@pytest.mark.parametrize("order", ["cba"])
def test_loads_equal_a_full_rebuild(spark, star, full, tmp_path, order):
    root, parts = str(tmp_path), pieces(star["lineitem"])
    for name in order:
        assert load(spark, root, name, parts[name], star)
    same(spark, root, full)
    assert not load(spark, root, order[0], parts[order[0]], star)  # known by name
    same(spark, root, full)
    assert os.listdir(f"{root}/staged") == [] and sorted(n for n in os.listdir(f"{root}/loads") if not n.startswith(".")) == ["a", "b", "c"]


@pytest.mark.parametrize("at", ["monthly_revenue"])
def test_an_interrupted_load_is_finished_and_adds_nothing_twice(spark, star, full, tmp_path, monkeypatch, at):
    root, parts, real = str(tmp_path), pieces(star["lineitem"]), I._overwrite
    load(spark, root, "a", parts["a"], star)

    def broken(df, root, table):
        real(df, root, table)
        if table == at:
            raise RuntimeError("lost")

    monkeypatch.setattr(I, "_overwrite", broken)
    with pytest.raises(RuntimeError, match="lost"):
        load(spark, root, "b", parts["b"], star)
    monkeypatch.setattr(I, "_overwrite", real)
    load(spark, root, "c", parts["c"], star)  # finishes b first
    assert not load(spark, root, "b", parts["b"], star)
    same(spark, root, full)


def folders(root, table):
    return {os.path.basename(d): sorted(os.listdir(d)) for d in glob.glob(f"{root}/{table}/*=*")}


def test_only_touched_folders_are_written(spark, star, tmp_path):
    root, lines = str(tmp_path), star["lineitem"]
    month = F.date_format("l_shipdate", "yyyy-MM")
    new = (month == "1996-05") & (F.col("l_linenumber") == 2)
    load(spark, root, "most", lines.filter(~new), star)
    before = {t: folders(root, t) for t in I.FOLDERS}
    load(spark, root, "more", lines.filter(new), star)
    changed = {t: sorted(d.split("=")[1] for d, files in folders(root, t).items() if before[t].get(d) != files) for t in I.FOLDERS}
    assert changed == {
        "cells": ["1996-05"],
        "monthly_revenue": ["085_05", "085_06"],
        "stock_annual_k": ["1996"],
        "stock_weekly_k": ["1996-04", "1996-05"],
    }


def test_empty_loads_odd_rows_and_names(spark, star, tmp_path):
    root, lines = str(tmp_path), star["lineitem"]
    assert load(spark, root, "none", lines.limit(0), star)
    assert all(df.count() == 0 for df in I.loaded_tables(spark, root).values())
    some = lines.filter(F.col("l_orderkey") < 50)
    odd = some.withColumn("l_suppkey", F.lit(None).cast("long")).union(some.withColumn("l_shipdate", F.lit(None).cast("timestamp")))
    odd = odd.union(some.withColumn("l_partkey", F.lit(-1).cast("long")))
    assert load(spark, root, "odd", odd, star)
    assert all(df.count() == 0 for df in I.loaded_tables(spark, root).values())
    assert load(spark, root, "some", some, star)
    assert I.loaded_tables(spark, root)["stock_prices"].count() == some.count()
    with pytest.raises(ValueError, match="name"):
        load(spark, root, "a/b", some, star)


def test_earlier_months_are_not_read(spark, star, tmp_path):
    root = str(tmp_path)
    load(spark, root, "all", star["lineitem"], star)
    kept = I.read_cells(spark, f"{root}/cells").filter(F.col("month").isin(["1996-05"]))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "(month" in plan.split("PartitionFilters")[1] and "1996-05" in plan
