"""Plan shapes: what Catalyst is expected to do with the registered queries."""

import re

import pytest

from growret.plans.registry import load_all
from growret.sources.fixtures import line_cells, name_ranks, read_star
from growret.sources.store import model_tables
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scan_lines(plan: str) -> list[str]:
    return [ln for ln in plan.splitlines() if "FileScan parquet" in ln]


@pytest.fixture(scope="module")
def plans(spark):
    return {k: _plan(q.run(spark, SF_SMALL)) for k, q in load_all().items()}


def test_no_python_in_any_plan(plans):
    for k, p in plans.items():
        assert not any(n in p for n in PYTHON_NODES), k


def test_heatmap_prunes_folders_and_columns(plans):
    scans = _scan_lines(plans["heatmap_median"])
    annual = [ln for ln in scans if "PartitionFilters: [isnotnull(year" in ln]
    monthly = [ln for ln in scans if "PartitionFilters: [report_month" in ln]
    assert scans and len(annual) + len(monthly) == len(scans)
    assert {"struct<symbol:string,year_open:double,year_close:double,stock_id:string>",
            "struct<year_open:double,year_close:double,stock_id:string>"} >= {ln.split("ReadSchema: ")[1].split(">")[0] + ">" for ln in annual}
    assert all("ReadSchema: struct<stock_id:string,yoy_pct:double>" in ln for ln in monthly)
    assert all("PushedFilters: [IsNotNull(yoy_pct)" in ln for ln in monthly)


def test_findings_reads_the_join_once(plans):
    assert len(_scan_lines(plans["bin_findings"])) == 2  # annual bars and monthly rows, once each


def test_stage_keys_read_the_stored_study(plans):
    for k in ("stage_means", "stage_stats", "stage_distribution", "stage_histogram", "stage_outliers", "report_slices"):
        scans = _scan_lines(plans[k])
        assert scans and all("pre_week" in ln and "w_close" not in ln and "w_high" not in ln for ln in scans), k


def test_event_study_reads_the_event_dates_once(plans):
    weekly = [ln for ln in _scan_lines(plans["event_study"]) if "w_close" in ln]
    assert len(weekly) == 1 and "GreaterThanOrEqual(date" in weekly[0] and "LessThanOrEqual(date" in weekly[0]
    assert "lag(w_close" not in plans["event_study"]


def test_lines_are_reduced_by_hashing(spark):
    star = read_star(spark, SF_SMALL)
    plan = _plan(line_cells(star["lineitem"], name_ranks(star["part"])))
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "RoundRobin" not in plan


def test_text_is_never_a_sorted_aggregate(spark, plans):
    assert "SortAggregate" not in plans["latest_remark"]
    assert model_tables(spark, SF_SMALL).root


def test_drilldown_shuffles_only_the_bin_rows_once(plans):
    p = plans["bin_drilldown"]
    # one shuffle by entity for the remark window, reused by the grouping;
    # the annual side is joined by broadcast when small (AQE's size check)
    assert len(re.findall(r"Exchange hashpartitioning\(stock_id", p)) == 1
    assert len(_scan_lines(p)) == 2
