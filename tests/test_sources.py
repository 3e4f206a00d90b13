"""Loaders, schema checks and sinks."""

import pytest
from pyspark.sql import functions as F

from growret.sources.model import MODEL_SCHEMAS, check_schema, load_model_tables
from growret.sources.sinks import register_views, write_csv
from growret.sources.store import model_tables
from tests.conftest import SF_SMALL


def test_parquet_loader_round_trip(spark, tmp_path):
    derived = model_tables(spark, SF_SMALL)
    for name, df in derived.items():
        df.write.mode("overwrite").parquet(str(tmp_path / name))
    loaded = load_model_tables(spark, str(tmp_path))
    for name, df in loaded.items():
        assert df.schema.fieldNames()[: len(MODEL_SCHEMAS[name])] == MODEL_SCHEMAS[name].fieldNames()
        assert sorted(df.columns) == sorted(derived[name].columns)
        assert df.count() == derived[name].count()


def test_schema_check_rejects_missing_column(spark):
    df = spark.createDataFrame([("1.TW", "1998")], "symbol string, year string")
    with pytest.raises(ValueError, match="year_open"):
        check_schema(df, "stock_annual_k")


def test_schema_check_casts(spark):
    df = spark.createDataFrame([("1.TW", 1998, 1, 2, 3)], "symbol string, year int, year_open int, year_high int, year_close int")
    out = check_schema(df, "stock_annual_k")
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "string", "double", "double", "double"]


def test_sql_views_with_bound_parameters(spark):
    register_views(spark, model_tables(spark, SF_SMALL))
    got = spark.sql(
        "SELECT count(*) AS n FROM stock_annual_k WHERE year = :y", args={"y": "1998"}
    ).collect()[0].n
    assert got == model_tables(spark, SF_SMALL)["stock_annual_k"].filter(F.col("year") == "1998").count()


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("000001", "acme", 2, 12.5, None)], "stock_id string, stock_name string, hits int, annual_return double, remarks string")
    p1 = write_csv(df, str(tmp_path / "bl"))
    p2 = write_csv(df, str(tmp_path / "ev"), single_file=True)
    for p in (p1, p2):
        back = spark.read.option("header", True).csv(p)
        assert back.columns == df.columns and back.count() == 1


def _rows(df):
    rows = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()]
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


def test_shared_study_stored_once_and_equal_to_fresh(spark):
    import __spark_entry__ as E  # noqa: F401  (registers the shared inputs)
    from growret.plans import q_timing as QT
    from growret.plans.registry import shared_input

    t = model_tables(spark, SF_SMALL)
    a = shared_input(t, "event_study")
    assert shared_input(t, "event_study") is a
    assert _rows(a) == _rows(QT._study(t))


def test_tables_expire_and_refresh(spark, tmp_path):
    import pyarrow.parquet as pq

    from growret.sources.store import CACHE_SECONDS_CONF, refresh

    for name in ("lineitem", "part", "supplier"):
        pq.write_table(pq.read_table(f"{SF_SMALL}/{name}.parquet"), tmp_path / f"{name}.parquet")
    d = str(tmp_path)
    first = model_tables(spark, d)
    before = first["monthly_revenue"].count()
    assert model_tables(spark, d) is first
    half = pq.read_table(f"{SF_SMALL}/lineitem.parquet").slice(0, 500)
    pq.write_table(half, tmp_path / "lineitem.parquet")
    assert refresh(spark, d)["monthly_revenue"].count() < before
    assert first["monthly_revenue"].count() == before  # a reader of the old tables keeps them
    spark.conf.set(CACHE_SECONDS_CONF, "0")
    try:
        second = model_tables(spark, d)
        assert model_tables(spark, d) is not second
    finally:
        spark.conf.unset(CACHE_SECONDS_CONF)


def test_jdbc_predicates_cover_each_row_once(spark):
    from growret.sources.model import jdbc_predicates

    t = model_tables(spark, SF_SMALL)
    odd = spark.createDataFrame([("x", None), ("y", "abc")], "symbol string, year string")
    frames = {
        "stock_annual_k": t["stock_annual_k"].select("symbol", "year").union(odd),
        "monthly_revenue": t["monthly_revenue"],
        "stock_weekly_k": t["stock_weekly_k"],
        "stock_prices": t["stock_prices"],
    }
    for name, df in frames.items():
        predicates = jdbc_predicates(name, range(1994, 1997))
        assert len(predicates) > 3
        hits = df.select(sum(F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates).alias("n"))
        assert [r.n for r in hits.distinct().collect()] == [1], name
        assert jdbc_predicates(name, range(0)) == ["1 = 1"]


def test_prepared_bars_give_the_same_weekly_returns(spark):
    import datetime as dt

    from growret.functions.returns import weekly_returns, with_previous

    # a gap before the range, a symbol that starts inside it, a zero and a missing price
    rows = [("1.TW", "1997-11-03", 10.0), ("1.TW", "1998-01-05", 11.0), ("1.TW", "1998-01-19", 0.0), ("1.TW", "1998-02-02", 5.0),
            ("2.TW", "1998-01-12", 7.0), ("2.TW", "1998-01-26", None), ("2.TW", "1998-02-09", 8.0), ("2.TW", "1998-03-09", 9.0)]
    bars = spark.createDataFrame([(s, dt.date.fromisoformat(d), p, p) for s, d, p in rows], "symbol string, date date, w_close double, w_high double")
    lo, hi = dt.date(1998, 1, 1), dt.date(1998, 2, 28)
    for price in ("w_close", "w_high"):
        plain = weekly_returns(bars, price=price, since=lo, until=hi)
        stored = weekly_returns(with_previous(bars), price=price, since=lo, until=hi)
        assert _rows(stored) == _rows(plain) and stored.count() == 6
        assert "Window" not in weekly_returns(with_previous(bars).limit(10).select("*"), price=price, since=lo)._jdf.queryExecution().analyzed().toString().split("Limit")[0]


def test_heatmap_csv_keeps_bin_key_and_month_columns(spark, tmp_path):
    import __spark_entry__ as E
    pivot = E.queries()["heatmap_pivot"](spark, SF_SMALL)
    p = write_csv(pivot, str(tmp_path / "hm"), single_file=True)
    back = spark.read.option("header", True).csv(p)
    assert back.columns == pivot.columns
    assert {"bin_order", "return_bin"} <= set(back.columns)
    assert back.count() == pivot.count()


def test_no_scratch_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace

    from growret.session import ensure_checkpoint_dir

    cluster = SimpleNamespace(
        sparkContext=SimpleNamespace(master="spark://head:7077", getCheckpointDir=lambda: None),
        conf=SimpleNamespace(get=lambda key, default=None: default),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(cluster)
    named = SimpleNamespace(
        sparkContext=SimpleNamespace(master="spark://head:7077", getCheckpointDir=lambda: None),
        conf=SimpleNamespace(get=lambda key, default=None: "hdfs:///shared/ckpt" if key == "spark.checkpoint.dir" else default),
    )
    assert ensure_checkpoint_dir(named) == "hdfs:///shared/ckpt"


def test_changed_input_is_seen_and_folders_are_removed(spark, tmp_path):
    import os
    import shutil

    from growret.session import ensure_checkpoint_dir
    from growret.sources.store import KEEP_SECONDS_CONF, model_tables

    d = str(tmp_path)
    for name in ("part", "supplier"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", d)
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    lines.limit(500).write.parquet(f"{d}/lineitem.parquet")
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    folders = lambda: {x for x in os.listdir(base) if x.startswith("growret-model-")}
    start = folders()
    old = model_tables(spark, d)
    rows = old["monthly_revenue"].count()
    assert model_tables(spark, d) is old and len(folders() - start) == 1
    lines.limit(3000).write.mode("append").parquet(f"{d}/lineitem.parquet")
    new = model_tables(spark, d)
    assert new is not old and new["monthly_revenue"].count() > rows
    assert old["monthly_revenue"].count() == rows and len(folders() - start) == 2  # readers keep theirs for a while
    spark.conf.set(KEEP_SECONDS_CONF, "-1")
    try:
        assert model_tables(spark, d) is new
        assert len(folders() - start) == 1 and new["monthly_revenue"].count() > rows
        (tmp_path / "part.parquet").touch()
        assert model_tables(spark, d) is not new
        model_tables(spark, d)  # removes what the look before it replaced
        assert len(folders() - start) == 1
    finally:
        spark.conf.unset(KEEP_SECONDS_CONF)


def test_results_are_kept_by_arguments(spark):
    from growret.operators import heatmap as H
    from growret.sources.store import model_tables, shared

    t = model_tables(spark, SF_SMALL)
    calls = []

    def cells(tables, year, stat):
        calls.append((year, stat))
        return H.heatmap_cells(tables["stock_annual_k"], tables["monthly_revenue"], year=year, metric="yoy_pct", stat=stat)

    a = shared(t, "cells", cells, year=1998, stat="mean")
    assert shared(t, "cells", cells, stat="mean", year=1998) is a and calls == [(1998, "mean")]
    b = shared(t, "cells", cells, year=1997, stat="mean")
    assert b is not a and _rows(b) == _rows(cells(t, 1997, "mean")) and _rows(a) == _rows(cells(t, 1998, "mean"))
    plain = dict(t)
    assert _rows(shared(plain, "cells", cells, year=1998, stat="mean")) == _rows(a)
