"""Every operator as a named query over the given tables, with its expected result as SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.operators import filters, gold, kpis, process, quality, semantic, series, summaries, views
from remitlake.operators.filters import FilterParams
from remitlake.plans.oracle_kpis import KPI_SQL, kpi_statement
from remitlake.plans.oracle_series import SERIES, series_statements
from remitlake.plans.oracle_views import ROW_SHEETS, loaded_at, loader_statements, row_sheet_statements, search_statement, typed_statement, view_statements
from remitlake.plans.params import (
    AS_OF,
    AS_OF_TIME,
    DEPARTMENT,
    DISPLAY_SUFFIXES,
    EVERYTHING,
    LEFT_OUT,
    LOADS,
    PAYER,
    PAYER_NAME,
    PROVIDER,
    VARIANTS,
    VIEW_VARIANTS,
)
from remitlake.session import partitions_for, set_scale_conf, shuffles_end_with_write
from remitlake.sources import export, ingest, layout
from remitlake.sources.changes import Changes, read_partitioned, replace_rows, write_partitioned
from remitlake.sources.interleave import with_interleaved, write_interleaved
from remitlake.sources.schemas import DATE_COLUMNS, KEYS, TABLES
from remitlake.sources.silver import Silver, dashboard_types
from remitlake.sources.star import large_paths, star_raw, star_silver
from remitlake.sources.text_index import indexed_search, write_indexed
from remitlake.streaming.incremental import load_new_files_typed

Query = Callable[[SparkSession, str], DataFrame]

# Measures that also run with one department (the join to encounters then filters).
WITH_DEPARTMENT = ("gross_collection_rate_trend", "payer_mix", "cpt_analysis", "core_kpis", "charge_lag_value")


# Decimals of the results. Both engines add doubles in any order, so values are compared
# rounded. Amounts here are multiples of 0.0001 (costs of 0.000001), which such rounding
# leaves alone; means of a few amounts have more decimals.
DIGITS = 4
MORE_DIGITS = {
    "kpi_avg_reimbursement_trend": 6, "kpi_avg_reimbursement_trend_filtered": 6, "metric_facts_operating_costs": 6,
    "etl_operating_costs": 6,
}


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.selectExpr(*[f"round(`{c}`, {digits}) as `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes])


def _query(
    build: Callable[[Silver], DataFrame], digits: int = DIGITS,
    source: Callable[[SparkSession, str], Silver] = star_silver,
) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        set_scale_conf(spark)
        return _rounded(build(source(spark, root)), digits)

    run.over = lambda other: _query(build, digits, other)  # the same operator over tables from elsewhere
    return run


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _kpi_queries() -> dict[str, Query]:
    out = {}
    for name in KPI_SQL:
        for suffix, p in VARIANTS.items():
            if suffix == "_dept" and name not in WITH_DEPARTMENT:
                continue
            measure = getattr(kpis, name)
            key = f"kpi_{name}{suffix}"
            out[key] = _query(lambda s, measure=measure, p=p: measure(s, p), MORE_DIGITS.get(key, DIGITS))
    return out


def _kpi_oracles() -> dict[str, str]:
    return {
        f"kpi_{name}{suffix}": kpi_statement(name, p, MORE_DIGITS.get(f"kpi_{name}{suffix}", DIGITS))
        for name in KPI_SQL
        for suffix, p in VARIANTS.items()
        if suffix != "_dept" or name in WITH_DEPARTMENT
    }


def _freshness(spark: SparkSession, root: str) -> DataFrame:
    """The log that the loads of the raw files have written, looked at as of a fixed time."""
    log = ingest.read_log(spark, f"{_loaded(spark, root)}/metadata/pipeline_runs")
    return kpis.data_freshness(log, F.lit(AS_OF_TIME).cast("timestamp_ntz"))


def _cascade_sizes(s: Silver, dates: FilterParams) -> DataFrame:
    return filters.cascade_sizes(s, FilterParams(dates.start_date, dates.end_date, PAYER, DEPARTMENT, "1-URGENT"))


def _view_queries() -> dict[str, Query]:
    out = {}
    for suffix, p in VIEW_VARIANTS.items():
        out |= {f"{name}{suffix}": query for name, query in _dated_views(p).items()}
    return out | _undated_views()


def _dated_views(dates: FilterParams) -> dict[str, Query]:
    def view(build: Callable[[Silver, FilterParams], DataFrame]) -> Query:
        return _query(lambda s: build(s, dates))

    out = {
        f"view_{name}": view(getattr(views, name))
        for name in (
            "kpi_alerts", "kpi_scorecard", "page_scorecards", "monthly_volume", "revenue_waterfall", "gcr_ncr_trend",
            "financial_summary", "claim_status_distribution", "top_denial_reasons", "scrub_summary", "ar_under_60_share",
            "cash_flow", "charge_lag_histogram", "caption_counts", "payer_comparison", "payer_type_summary",
            "encounter_type_by_department", "provider_summary", "provider_scorecard", "cpt_summary",
            "underpayment_summary", "patient_resp_summary", "patient_resp_by_payer_type", "aging_detail",
        )
    }
    for part in ("totals", "status", "reasons", "detail"):
        out[f"view_payer_drilldown_{part}"] = view(lambda s, p, part=part: views.payer_drilldown(s, p, PAYER)[part])
    for part in ("totals", "types", "status", "detail"):
        out[f"view_department_drilldown_{part}"] = view(
            lambda s, p, part=part: views.department_drilldown(s, p, DEPARTMENT)[part]
        )
    for part in ("totals", "status", "reasons"):
        out[f"view_provider_drilldown_{part}"] = view(
            lambda s, p, part=part: views.provider_drilldown(s, p, PROVIDER)[part]
        )
    for name, by, ascending in (
        ("top_payments", "total_payments", False), ("top_denial", "denial_rate", False),
        ("low_clean", "clean_claim_rate", True), ("top_per_encounter", "avg_payment_per_encounter", False),
    ):
        out[f"view_provider_{name}"] = view(
            lambda s, p, by=by, ascending=ascending: views.provider_ranking(s, p, by, ascending)
        )
    for which in ("revenue", "denial", "share", "unit_charge"):
        out[f"view_cpt_top_{which}"] = view(lambda s, p, which=which: views.cpt_top(s, p, which))
    for by in ("total_underpaid", "underpayment_rate", "total_allowed"):
        out[f"view_underpayment_by_{by}"] = view(lambda s, p, by=by: views.underpayment_order(s, p, by))
    for by in ("department", "encounter_type"):
        out[f"view_patient_resp_by_{by}"] = view(lambda s, p, by=by: views.patient_resp_sums(s, p, by))
    for which in ("denial_reasons", "scrubbing", "department", "cpt", "underpayment", "patient_resp"):
        out[f"view_detail_{which}"] = view(lambda s, p, which=which: views.detail_table(s, p, which))
    for table, columns in {
        "claims": ("claim_id", "encounter_id", "payer_id", "total_charge_amount", "claim_status"),
        "encounters": ("encounter_id", "date_of_service", "department"),
        "payments": ("payment_id", "claim_id", "payment_amount"),
        "denials": ("denial_id", "claim_id", "denied_amount"),
        "adjustments": ("adjustment_id", "claim_id", "adjustment_amount"),
        "charges": ("charge_id", "encounter_id", "charge_amount"),
    }.items():
        out[f"view_cascade_{table}"] = view(
            lambda s, p, table=table, columns=columns: getattr(filters.cascade(s, p), table).select(*columns)
        )
    out["view_cascade_sizes"] = view(_cascade_sizes)
    return out


def _undated_views() -> dict[str, Query]:
    out = {}
    out["view_filter_date_bounds"] = _query(lambda s: _as_text(filters.date_bounds(s), "min_date", "max_date"))
    for name, column in (
        ("payer_names", "payer_name"), ("departments", "department"), ("encounter_types", "encounter_type"),
    ):
        out[f"view_filter_{name}"] = _query(lambda s, column=column: filters.options(s, column))
    out["view_filter_payer_id"] = _query(lambda s: filters.payer_id_of(s, PAYER_NAME))
    out["view_search_providers"] = _query(lambda s: filters.search(s.providers, "00000001", department="DEPT_3"))
    return out


def _other_queries() -> dict[str, Query]:
    out = {f"gold_{name}": _query(lambda s, name=name: gold.load_gold(s, AS_OF)[name]) for name in gold.VIEWS}
    for name in process.PROCESS_KPIS:
        out[f"proc_{name}"] = _query(lambda s, name=name: process.process_kpi(s, name))
    out["proc_all"] = _query(process.process_kpis)
    out["diag_silver_counts"] = _query(lambda s: process.row_counts("SILVER", s.tables()))
    out["diag_bronze_counts"] = _query(lambda s: process.row_counts("BRONZE", {t: star_raw(s, t) for t in TABLES}))
    out["diag_gold_counts"] = _query(lambda s: process.gold_row_counts(s, AS_OF))
    for name in (
        "payment_profile", "claims_with_payments", "orphan_payments", "gcr_spot_check", "unparseable_dates",
        "status_distribution",
    ):
        out[f"diag_{name}"] = _query(getattr(process, name))
    out["diag_date_parse_sample"] = _query(lambda s: _as_text(process.date_parse_sample(s), "parsed_date"))
    for name in quality.CHECKS + [r.name for r in quality.EXTRA_REFERENCES]:
        out[f"dq_{name}"] = _query(lambda s, name=name: quality.run_check(s, name).drop("message"))
    out["dq_all"] = _query(lambda s: quality.run_all(s, extra=True).drop("message"))
    out["dq_issues"] = _query(lambda s: quality.issues(s).drop("message"))
    out["dq_issue_rollup"] = _query(lambda s: quality.issue_rollup(quality.issues(s)))
    for level, table in (("error", None), (None, "claims_have_valid_payers"), ("warning", None)):
        found = _query(lambda s, level=level, table=table: quality.issue_filter(quality.issues(s), level, table).drop("message"))
        out[f"dq_issues_of_{level or table}"] = found
    out["proc_display"] = _query(lambda s: process.display_values(process.process_kpis(s), DISPLAY_SUFFIXES))
    out["diag_layer_counts"] = _query(lambda s: process.layer_counts({
        "SILVER": s.tables(), "GOLD": gold.load_gold(s, AS_OF), "BRONZE": {t: star_raw(s, t) for t in TABLES},
    }))
    out["diag_column_report"] = _query(lambda s: process.column_report(
        {t: getattr(s, t).drop(*LEFT_OUT.get(t, ())) for t in TABLES}
    ))
    return out


def _series_queries() -> dict[str, Query]:
    def points(s: Silver, only: str | None = None) -> DataFrame:
        everything = series.kpi_series(s, EVERYTHING)
        return everything.filter(F.col("series") == only) if only else everything

    def on_points(build: Callable[[DataFrame], DataFrame], only: str | None = None) -> Query:
        return _query(lambda s: build(points(s, only)), 3)

    out = {}
    for name in SERIES:
        out[f"ts_anomalies_{name}"] = on_points(series.detect_anomalies, name)
        out[f"ts_fit_{name}"] = on_points(
            lambda d: series.fit_line(d).select("series", "period", "value", "fitted", "is_anomaly"), name
        )
        out[f"ts_forecast_{name}"] = on_points(
            lambda d: series.linear_forecast(d).drop("resid_std", "last_value"), name
        )
    out["ts_anomaly_list"] = on_points(series.anomaly_list)
    out["ts_seasonality"] = on_points(series.detect_seasonality)
    out["ts_seasonal_pattern"] = on_points(series.seasonal_pattern)
    out["ts_forecast_summary"] = on_points(series.forecast_summary)
    out["ts_model_stats"] = on_points(series.model_stats)
    out["ts_what_if"] = _query(lambda s: series.what_if(s, EVERYTHING), 3)
    out["ts_what_if_grid"] = _query(lambda s: series.what_if(s, EVERYTHING, [1.0, 2.0], [5, 10], [3.0]), 3)
    return out


def _metric_queries() -> dict[str, Query]:
    def metrics(table: str) -> list[str]:
        return [f"{table}.{m}" for m in semantic.METRICS[table]]

    def ask(names: list[str], by: list | None = None, where: list | None = None, digits: int = DIGITS) -> Query:
        return _query(lambda s: semantic.metric_query(s, names, by, where), digits)

    out = {f"metric_{t}": ask(metrics(t)) for t in semantic.METRICS}
    out |= {
        f"metric_facts_{t}": ask([f"{t}.{f}" for f in fs], digits=MORE_DIGITS.get(f"metric_facts_{t}", DIGITS))
        for t, fs in semantic.FACTS.items()
    }
    for name, table, by in (
        ("claims_to_encounters", "claims", "encounters.department"),
        ("claims_to_payers", "claims", "payers.payer_type"),
        ("claims_to_patients", "claims", "patients.gender"),
        ("payments_to_claims", "payments", "claims.claim_status"),
        ("payments_to_payers", "payments", "payers.payer_name"),
        ("payments_to_claim_payers", "payments", "payers!claims.payer_name"),
        ("denials_to_claims", "denials", "claims.date_of_service_time@year=year"),
        ("adjustments_to_claims", "adjustments", "claims.claim_status"),
        ("charges_to_encounters", "charges", "encounters.encounter_type"),
        ("encounters_to_patients", "encounters", "patients.gender"),
        ("encounters_to_providers", "encounters", "providers.specialty"),
        ("patients_to_payers", "encounters", "payers!patients.payer_type"),
    ):
        out[f"metric_{name}"] = ask(metrics(table), [by])
    out["metric_filtered"] = ask(
        metrics("claims"),
        ["encounters.department", "claims.submission_date_time@month=submission_month"],
        [
            ("payers.payer_type", "=", "Government"),
            ("claims.date_of_service_time", ">=", "1998-01-01"),
            ("claims.claim_status", "in", ["Paid", "Denied"]),
        ],
    )
    for name in (
        "denial_rate_by_payer", "top_denial_reasons", "denial_trend", "revenue_per_encounter", "days_in_ar_by_payer",
        "charges_and_payments_by_month",
    ):
        out[f"metric_q_{name}"] = _query(getattr(semantic, name))
    return out


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


#: Text columns that get a line break, quotes and a comma before they are written, and are read back so.
BROKEN_TEXTS = {
    "payers": "payer_name", "providers": "provider_name", "charges": "cpt_description", "claims": "submission_method",
    "denials": "denial_reason_description",
}


def _through_files(table: str, broken: str | None = None) -> Query:
    """The table written as raw CSV files, loaded into the raw layer and typed from there."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        set_scale_conf(spark)
        folder = _scratch(spark)
        raw = star_raw(star_silver(spark, root), table)
        if broken:
            raw = raw.withColumn(broken, F.concat(broken, F.lit('\n"'), broken, F.lit('", x')))
        with shuffles_end_with_write(spark):
            # Broken lines are kept once more while they load, so their files are packed.
            export.write_csv(raw, f"{folder}/stage/{table}.csv", packed=bool(broken))
        ingest.load_raw(spark, f"{folder}/stage", f"{folder}/bronze", [table])
        typed = ingest.to_typed(spark.read.parquet(f"{folder}/bronze/{table}"), table)
        return _rounded(typed, MORE_DIGITS.get(f"etl_{table}", DIGITS))

    return run


def _through_stream(table: str) -> Query:
    """The table written as raw CSV files, taken to the typed layer in batches of two files."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        folder = _scratch(spark)
        export.write_csv(star_raw(star_silver(spark, root), table).repartition(5), f"{folder}/stage/{table}")
        load_new_files_typed(spark, f"{folder}/stage", folder, f"{folder}/state", table, 2).awaitTermination()
        typed = getattr(Silver.from_parquet(spark, f"{folder}/silver"), table)
        return _rounded(typed, MORE_DIGITS.get(f"etl_{table}", DIGITS))

    return run


STREAMED = ("claims", "denials")


def _once(write: Callable[[SparkSession, str, str], None]) -> Callable[[SparkSession, str], str]:
    """Folder that ``write`` fills from the tables of a root, once per application."""
    folders: dict[tuple[str, str], str] = {}

    def folder_of(spark: SparkSession, root: str) -> str:
        key = (spark.sparkContext.applicationId, root)
        if key not in folders:
            set_scale_conf(spark)
            folder = _scratch(spark)
            write(spark, root, folder)
            folders[key] = folder
        return folders[key]

    return folder_of


def _load_everything(spark: SparkSession, root: str, folder: str) -> None:
    raw = star_silver(spark, root)
    for table in TABLES:
        export.write_csv(star_raw(raw, table), f"{folder}/stage/{table}.csv", packed=True)
    for when, tables in LOADS:
        loaded_at = F.lit(when).cast("timestamp_ntz")
        ingest.run_pipeline(spark, f"{folder}/stage", folder, tables=tables or TABLES, loaded_at=loaded_at)


_loaded = _once(_load_everything)
_typed_layer = _once(
    lambda spark, root, folder: layout.write_bucketed(
        star_silver(spark, root), folder, partitions_for(spark, large_paths(root))
    )
)


def _stored_silver(spark: SparkSession, root: str) -> Silver:
    """The typed layer as files, laid out by claim and encounter."""
    folder = _typed_layer(spark, root)
    return layout.open_bucketed(spark, folder, f"lake_{folder.rsplit('/', 1)[-1]}")


def _pipeline_queries() -> dict[str, Query]:
    """All ten raw files through the raw and the typed layer; its tables and the load log, read back."""

    def table_of(spark: SparkSession, root: str, table: str) -> DataFrame:
        silver = Silver.from_parquet(spark, f"{_loaded(spark, root)}/silver")
        return _rounded(getattr(silver, table), MORE_DIGITS.get(f"etl_{table}", DIGITS))

    def log(spark: SparkSession, root: str) -> DataFrame:
        log = ingest.read_log(spark, f"{_loaded(spark, root)}/metadata/pipeline_runs")
        return _as_text(log, "last_loaded_at")

    def stamps(spark: SparkSession, root: str) -> DataFrame:
        return process.load_stamps(ingest.read_raw(spark, f"{_loaded(spark, root)}/bronze"))

    out: dict[str, Query] = {
        f"etl_pipeline_{t}": lambda spark, root, t=t: table_of(spark, root, t) for t in TABLES
    }
    return out | {
        "etl_pipeline_log": log, "etl_load_stamps": stamps,
        "kpi_data_freshness": lambda spark, root: _rounded(_as_text(_freshness(spark, root), "last_loaded_at"), DIGITS),
        "view_freshness_rollup": lambda spark, root: views.freshness_rollup(_freshness(spark, root)),
    }


def _earlier(s: Silver) -> tuple[Silver, Changes]:
    """A state of the tables before some of their rows came, changed or went, and the changes that lead to the tables."""

    def slot(table: str) -> Column:
        return F.pmod(F.hash(KEYS[table]), F.lit(100))

    extra = s.claims.filter(slot("claims") == 9).withColumn("claim_id", F.concat(F.lit("X"), "claim_id"))
    changed = s.claims.filter(slot("claims") == 7).withColumns({
        "claim_status": F.lit("Pending"), "total_charge_amount": F.col("total_charge_amount") + 1, "is_clean_claim": F.lit(0),
        "date_of_service": F.lit("1997-05-05"), "payer_id": F.lit("1"),
    })
    claims = s.claims.filter(~slot("claims").isin(0, 1, 7)).unionByName(changed).unionByName(extra)
    denied = F.when(slot("denials") == 5, F.col("denied_amount") * 2).otherwise(F.col("denied_amount"))
    old = s.with_tables(
        claims=claims, payments=s.payments.filter(slot("payments") > 2), charges=s.charges.filter(slot("charges") > 0),
        denials=s.denials.withColumn("denied_amount", denied),
    )
    rows = {
        "claims": s.claims.filter(slot("claims").isin(0, 1, 7)), "payments": s.payments.filter(slot("payments") <= 2),
        "charges": s.charges.filter(slot("charges") == 0), "denials": s.denials.filter(slot("denials") == 5),
    }
    return old, Changes(rows, {"claims": extra.select("claim_id")})


def _keep_summaries(spark: SparkSession, root: str, folder: str) -> None:
    old, changes = _earlier(star_silver(spark, root))
    kept = summaries.Summaries(spark, folder)
    kept.build(old)
    kept.refresh(1, old, changes)


def _replace_everything(spark: SparkSession, root: str, folder: str) -> None:
    old, changes = _earlier(star_silver(spark, root))
    for table in REPLACED:
        write_partitioned(getattr(old, table), folder, table)
        replace_rows(spark, folder, table, changes)


_kept, _replaced = _once(_keep_summaries), _once(_replace_everything)
REPLACED = ("claims", "payments", "charges")


_searchable = _once(
    lambda spark, root, folder: write_indexed(star_silver(spark, root).providers, folder, KEYS["providers"])
)


def _search_queries() -> dict[str, Query]:
    """The provider search over the indexed table: a long text, a short one, one that every row has."""

    def find(spark: SparkSession, root: str, text: str, **equal: str) -> DataFrame:
        return indexed_search(spark, _searchable(spark, root), KEYS["providers"], text, **equal)

    return {
        "view_search_providers_indexed": lambda spark, root: find(spark, root, "00000001", department="DEPT_3"),
        "view_search_providers_short": lambda spark, root: find(spark, root, "7|"),
        "view_search_providers_common": lambda spark, root: find(spark, root, "DEPT"),
    }


def _changed_queries() -> dict[str, Query]:
    """The aggregate views from sums that took changes in, and stored tables in which rows were replaced."""

    def view(spark: SparkSession, root: str, name: str) -> DataFrame:
        found = summaries.Summaries(spark, _kept(spark, root)).views(star_silver(spark, root), AS_OF)
        return _rounded(found[name], DIGITS)

    def table(spark: SparkSession, root: str, name: str) -> DataFrame:
        stored = read_partitioned(spark, _replaced(spark, root), name).select(*[c for c, _ in TABLES[name]])
        return _rounded(stored, DIGITS)

    out: dict[str, Query] = {f"gold_kept_{n}": lambda spark, root, n=n: view(spark, root, n) for n in gold.VIEWS}
    return out | {f"etl_replaced_{t}": lambda spark, root, t=t: table(spark, root, t) for t in REPLACED}


#: Queries that also run over the stored typed layer.
STORED = (
    "kpi_core_kpis", "kpi_core_kpis_filtered", "kpi_days_in_ar_trend_filtered", "kpi_provider_performance",
    "kpi_cpt_analysis", "gold_department_performance", "gold_payer_performance", "dq_all", "view_page_scorecards",
    "view_cascade_sizes", "view_cascade_claims_filtered", "metric_filtered", "metric_payments_to_claims",
)


_by_payer = _once(lambda spark, root, folder: write_interleaved(
    star_silver(spark, root), folder, max(16, partitions_for(spark, large_paths(root)))
))
#: Queries that also run over claims in interleaved order: by payer, by department, by date.
INTERLEAVED = (
    "kpi_core_kpis", "kpi_core_kpis_dept", "kpi_payer_mix_filtered", "kpi_gross_collection_rate_trend_dept",
    "view_cascade_claims_filtered", "view_cascade_sizes", "view_payer_drilldown_totals",
)


def _interleaved_silver(spark: SparkSession, root: str) -> Silver:
    return with_interleaved(spark, star_silver(spark, root), _by_payer(spark, root))


def _stored_queries(queries: dict[str, Query]) -> dict[str, Query]:
    out = {f"lake_{name}": queries[name].over(_stored_silver) for name in STORED}
    return out | {f"interleaved_{name}": queries[name].over(_interleaved_silver) for name in INTERLEAVED}


#: Export (set, sheet) -> the query whose rows it holds.
EXPORTS = {
    ("payer_analysis", "Payer Mix"): "kpi_payer_mix",
    ("payer_analysis", "Denial by Payer"): "kpi_denial_rate_by_payer",
    ("payer_analysis", "Payer Comparison"): "view_payer_comparison",
    ("ar_aging_cashflow", "AR Aging Summary"): "kpi_ar_aging",
    ("ar_aging_cashflow", "Cash Flow"): "view_cash_flow",
    ("department_performance", "Department Summary"): "kpi_department_performance",
    ("department_performance", "Encounter Type Mix"): "view_encounter_type_by_department",
    ("provider_performance", "Provider Scorecard"): "view_provider_scorecard",
    ("cpt_code_analysis", "CPT Code Analysis"): "view_detail_cpt",
    ("underpayment_analysis", "Underpayment by Payer"): "view_detail_underpayment",
    ("patient_responsibility", "Patient Responsibility"): "view_detail_patient_resp",
    ("claim_scrubbing_breakdown", "Scrubbing Breakdown"): "view_detail_scrubbing",
    ("collections_revenue", "Financial Summary"): "view_financial_summary",
    ("claims_denials", "Denial Reasons"): "view_detail_denial_reasons",
    (f"payer_drilldown_{PAYER}", "Claims"): "view_payer_drilldown_detail",
    (f"dept_drilldown_{DEPARTMENT}", "Encounters & Claims"): "view_department_drilldown_detail",
}
#: Sheets that hold rows of a table as they are.
ROW_EXPORTS = tuple(ROW_SHEETS)


def _export_name(label: str, sheet: str) -> str:
    return f"export_{label.lower()}_{re.sub('[^a-z]+', '_', sheet.lower())}"


def _exported(label: str, sheet: str) -> Query:
    """One sheet of an export set, written as CSV and read back."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        set_scale_conf(spark)
        frame = views.export_sets(star_silver(spark, root), EVERYTHING, PAYER, DEPARTMENT)[label][sheet]
        (path,) = export.write_sets({label: {sheet: frame}}, _scratch(spark))
        back = spark.read.schema(frame.schema).option("header", True).option("escape", '"').csv(path)
        return _rounded(back, DIGITS)

    return run


def _loader_queries() -> dict[str, Query]:
    """The loader's view of the typed layer (dates, flags, cost month), its dates written as text for comparison."""

    def of(table: str) -> Query:
        columns = [*DATE_COLUMNS.get(table, []), *(["period"] if table == "operating_costs" else [])]
        return _query(lambda s: _as_text(getattr(dashboard_types(s), table), *columns), MORE_DIGITS.get(f"etl_{table}", DIGITS))

    return {f"loader_{t}": of(t) for t in ("encounters", "claims", "payments", "denials", "operating_costs")}


def _etl_queries() -> dict[str, Query]:
    out = {
        f"etl_{t}": _query(lambda s, t=t: ingest.to_typed(star_raw(s, t), t), MORE_DIGITS.get(f"etl_{t}", DIGITS))
        for t in TABLES
    }
    out |= {f"etl_files_{t}": _through_files(t) for t in TABLES}
    out |= {f"etl_broken_lines_{t}": _through_files(t, column) for t, column in BROKEN_TEXTS.items()}
    out |= {f"etl_stream_{t}": _through_stream(t) for t in STREAMED}
    out["etl_load_log"] = _query(
        lambda s: _as_text(ingest.load_log_rows(s, F.lit(AS_OF_TIME).cast("timestamp_ntz")), "last_loaded_at")
    )
    return out


def all_queries() -> dict[str, Query]:
    found = (
        _kpi_queries() | _other_queries() | _view_queries() | _series_queries() | _metric_queries() | _etl_queries()
    )
    return (
        found | _pipeline_queries() | _changed_queries() | _search_queries() | _stored_queries(found) | _loader_queries()
        | {_export_name(*key): _exported(*key) for key in (*EXPORTS, *ROW_EXPORTS)}
    )


def all_oracles() -> dict[str, str]:
    found = _kpi_oracles() | view_statements() | series_statements(MORE_DIGITS)
    counts = " UNION ALL ".join(
        f"SELECT '{t}' AS domain, '{loaded_at(t)}' AS last_loaded_at, COUNT(*) AS row_count, '{t}.csv' AS source_file "
        f"FROM ({found[f'etl_{t}']})" for t in TABLES
    )
    return (
        found
        | {f"etl_pipeline_{t}": found[f"etl_{t}"] for t in TABLES}
        | {f"etl_stream_{t}": found[f"etl_{t}"] for t in STREAMED}
        | {"etl_pipeline_log": counts}
        | {
            f"etl_broken_lines_{t}": f"SELECT * REPLACE ({c} || chr(10) || '\"' || {c} || '\", x' AS {c}) FROM ({found[f'etl_{t}']})"
            for t, c in BROKEN_TEXTS.items()
        }
        | {"view_search_providers_indexed": found["view_search_providers"]}
        | {f"view_search_providers_{n}": search_statement(t) for n, t in (("short", "7|"), ("common", "dept"))}
        | {f"gold_kept_{n}": found[f"gold_{n}"] for n in gold.VIEWS}
        | {f"etl_replaced_{t}": f"SELECT * FROM ({typed_statement(t)})" for t in REPLACED}
        | {f"lake_{name}": found[name] for name in STORED}
        | {f"interleaved_{name}": found[name] for name in INTERLEAVED}
        | {_export_name(*key): found[name] for key, name in EXPORTS.items()}
        | {_export_name(*key): sql for key, sql in row_sheet_statements().items()}
        | loader_statements(MORE_DIGITS)
    )
