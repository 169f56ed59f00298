"""Registered queries against their expected results in DuckDB.

A selection on the smallest data by default; ORACLE_ALL=1 runs every query, ORACLE_DIR
chooses the data.
"""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_points  # noqa: E402
from remitlake.plans import registry  # noqa: E402

ROOT = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
SELECTION = [
    "kpi_days_in_ar_trend", "kpi_net_collection_rate_value", "kpi_ar_aging", "kpi_payer_mix_filtered", "kpi_cpt_analysis",
    "kpi_provider_performance", "kpi_data_freshness", "kpi_core_kpis_dept", "gold_department_performance",
    "gold_payer_performance", "proc_all", "diag_gold_counts", "dq_all", "view_page_scorecards",
    "view_department_drilldown_detail", "view_cascade_sizes", "ts_forecast_summary", "ts_model_stats", "ts_what_if_grid",
    "metric_filtered", "metric_q_revenue_per_encounter", "etl_claims", "etl_denials", "etl_pipeline_charges", "etl_broken_lines_charges", "etl_replaced_claims", "gold_kept_monthly_kpis", "gold_kept_department_performance", "etl_broken_lines_claims",
    "etl_pipeline_log", "lake_kpi_core_kpis_filtered", "lake_view_cascade_sizes", "loader_claims", "loader_operating_costs",
    "export_payer_analysis_payer_mix", "view_aging_detail", "view_cpt_summary",
]
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
NAMES = sorted(registry.all_queries()) if os.environ.get("ORACLE_ALL") else SELECTION


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in STAR:
        con.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return con


def table(columns, data):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(rows, key=lambda r: [(v is None, str(type(v)), v) for v in r])


def test_every_query_has_an_expected_result():
    assert set(registry.all_queries()) == set(registry.all_oracles())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, engine, name):
    df = QUERIES[name](spark, ROOT)
    result = engine.execute(ORACLES[name])
    expected = table([c[0] for c in result.description], result.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["period", "charges", "payments", "gcr"] and df.count() > 0
