"""What the plans must and must not contain."""

import re

import pytest
from conftest import claim
from pyspark.sql import functions as F

from remitlake.operators import gold, kpis, quality, series, views
from remitlake.operators.filters import FilterParams, filtered_claims
from remitlake.session import set_scale_conf
from remitlake.sources import ingest
from remitlake.sources.schemas import TABLES
from remitlake.sources.silver import Silver

YEAR = FilterParams("2024-01-01", "2024-12-31")


@pytest.fixture(scope="module")
def stored(spark):
    """Typed tables on disk, and a session that never broadcasts: the plan for large data."""
    import tempfile

    from remitlake.sources.schemas import typed_schema

    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for t in TABLES:
        rows = [tuple(claim(1).get(c) for c, _ in TABLES[t])] if t == "claims" else []
        spark.createDataFrame(rows, typed_schema(t)).coalesce(1).write.parquet(f"{root}/{t}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Silver.from_parquet(spark, root)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text, kind="hashpartitioning"):
    return re.findall(rf"Exchange {kind}\(([^)]*)\)", text)


ALL_MEASURES = {
    **{n: lambda s, n=n: getattr(kpis, n)(s, YEAR) for n in (
        "days_in_ar_trend", "days_in_ar_value", "net_collection_rate_trend", "charge_lag_value", "cost_to_collect_value",
        "ar_aging", "payment_accuracy", "bad_debt_rate", "appeal_success_rate", "payer_mix", "denial_rate_by_payer",
        "department_performance", "provider_performance", "cpt_analysis", "underpayment_analysis", "underpayment_trend",
        "patient_resp_by_payer", "patient_resp_by_dept", "patient_resp_trend", "core_kpis",
    )},
    **{f"gold_{n}": lambda s, n=n: gold.load_gold(s, "2024-12-31")[n] for n in gold.VIEWS},
    "checks": lambda s: quality.run_all(s, extra=True),
    "forecast": lambda s: series.forecast_summary(series.kpi_series(s, YEAR)),
    "what_if": lambda s: series.what_if(s, YEAR),
    "scorecards": lambda s: views.page_scorecards(s, YEAR),
}


@pytest.mark.parametrize("name", ALL_MEASURES)
def test_no_cross_join_no_python_no_row_multiplication(stored, name):
    text = plan(ALL_MEASURES[name](stored))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Expand"):
        assert word not in text, word


def test_filter_and_columns_reach_the_scan(stored):
    p = FilterParams("2024-01-01", "2024-12-31", payer_id="A")
    text = plan(kpis.clean_claim_rate_trend(stored, p))
    assert "GreaterThanOrEqual(date_of_service,2024-01-01)" in text and "EqualTo(payer_id,A)" in text
    (schema,) = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert set(re.findall(r"(\w+):", schema)) == {"payer_id", "date_of_service", "submission_date", "is_clean_claim"}


def test_encounters_are_read_only_when_asked_for(stored):
    assert "encounters" not in plan(filtered_claims(stored, YEAR))
    assert "LeftSemi" in plan(filtered_claims(stored, FilterParams("2024-01-01", "2024-12-31", department="Heart")))


def test_payments_shuffle_as_partial_sums_and_claims_only_once(stored):
    """Claims and payment sums meet on claim_id; the three joins of the core numbers share that."""
    text = plan(kpis.core_kpis(stored, YEAR))
    on_claim = [e for e in exchanges(text) if e.startswith("claim_id")]
    assert len(on_claim) == 3
    assert text.count("partial_sum(payment_amount") == 1


def test_distinct_claims_need_no_further_shuffle(stored):
    text = plan(kpis.payer_mix(stored, YEAR))
    assert not [e for e in exchanges(text) if "payer_id" in e and "claim_id" in e]


def test_encounter_sums_come_before_the_encounter_join(stored):
    text = plan(kpis.department_performance(stored, YEAR))
    assert re.search(r"Exchange hashpartitioning\(encounter_id[^\n]*\n[^\n]*HashAggregate\(keys=\[encounter_id", text)


def test_typed_layer_is_laid_out_by_date(spark, stored, folder):
    claims = spark.range(0, 40_000, 1, 8).selectExpr(
        "cast(id as string) claim_id", "concat('e', id) encounter_id", "'p' patient_id", "'A' payer_id",
        "cast(date_add(date'2024-01-01', cast(id * 7919 % 300 as int)) as string) date_of_service",
        "'2024-12-20' submission_date", "1.0D total_charge_amount", "'Paid' claim_status", "1 is_clean_claim",
        "'Electronic' submission_method", "cast(null as string) fail_reason",
    )
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        ingest.write_typed(stored.with_tables(claims=claims), folder)
    finally:
        spark.conf.set(coalesce, before)
    written = Silver.from_parquet(spark, folder).claims
    files = written.groupBy(F.input_file_name().alias("f")).agg(
        F.min("date_of_service").alias("low"), F.max("date_of_service").alias("high")
    ).orderBy("low").collect()
    assert len(files) > 1 and all(a["high"] <= b["low"] for a, b in zip(files, files[1:]))


def test_scale_settings_reach_a_session_that_has_none(spark):
    """Settings are put where the owner chose nothing, and left where they did."""
    other = spark.newSession()
    other.conf.unset("spark.sql.adaptive.forceOptimizeSkewedJoin")
    other.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    set_scale_conf(other)
    assert other.conf.get("spark.sql.adaptive.skewJoin.enabled") == "false"
    assert other.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


def test_procedure_summary_has_no_window_over_all_codes(stored):
    """The windows that are there run per encounter or per code; one over all codes would begin with its order."""
    specifications = re.findall(r"windowspecdefinition\((\w+)", plan(views.cpt_summary(stored, YEAR)))
    assert set(specifications) == {"encounter_id", "cpt_code"}


def test_hot_encounter_is_split_in_the_semi_join(spark, stored):
    """Charges of one encounter fill a third of the rows; its partition is read by several tasks."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    charges = spark.range(0, 200_000, 1, 8).selectExpr(
        "cast(id as string) charge_id", "if(id % 3 = 0, 'e1', concat('e', id % 5000)) encounter_id",
        "cast(uuid() as string) cpt_code", "1.0D charge_amount", "'2024-01-10' service_date", "'2024-01-12' post_date",
    )
    claims = spark.range(0, 5000, 1, 4).selectExpr(
        "cast(id as string) claim_id", "concat('e', id) encounter_id", "'p' patient_id", "'A' payer_id",
        "'2024-01-10' date_of_service", "'2024-01-20' submission_date", "1.0D total_charge_amount",
        "'Paid' claim_status", "1 is_clean_claim",
    )
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = kpis.charge_lag_dist(stored.with_tables(charges=charges, claims=claims), YEAR)
        assert [tuple(r) for r in df.collect()] == [(2, 200_000)]
        assert "skew=true" in plan(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_date_ranges_reach_the_scan(spark, folder, make_silver):
    """The cascade's and the metric queries' date conditions are pushed filters on a stored typed layer."""
    from remitlake.operators import filters, semantic
    from remitlake.operators.filters import FilterParams
    from remitlake.sources import ingest
    from remitlake.sources.silver import Silver

    ingest.write_typed(make_silver(), f"{folder}/silver", True)
    stored = Silver.from_parquet(spark, f"{folder}/silver")
    scope = filters.cascade(stored, FilterParams("1997-01-01", "1998-12-31"))
    query = semantic.metric_query(
        stored, ["claims.denial_rate"], [], [("claims.date_of_service_time", ">=", "1998-01-01")]
    )
    for frame in (scope.claims, scope.encounters, query):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(date_of_service," in plan, plan


def test_metrics_are_summed_per_key_before_every_join(spark, make_silver):
    """One payer owns a third of the claims: what meets a looked-up table is one row per key, not one per claim."""
    from remitlake.operators import semantic

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claims = spark.range(0, 30_000, 1, 6).selectExpr(
            "cast(id as string) claim_id", "concat('e', id % 7) encounter_id", "'p' patient_id",
            "if(id % 3 = 0, 'A', concat('B', id % 50)) payer_id", "'2024-01-10' date_of_service", "'2024-01-20' submission_date",
            "1.0D total_charge_amount", "if(id % 4 = 0, 'Denied', 'Paid') claim_status", "1 is_clean_claim",
            "'Electronic' submission_method", "cast(null as string) fail_reason",
        )
        payers = spark.sql("select concat('B', id) payer_id, concat('name', id % 5) payer_name, 'x' payer_type, 1.0D avg_reimbursement_pct, 'k' contract_id from range(50)")
        silver = make_silver().with_tables(claims=claims, payers=payers)
        names = ["claims.total_charges", "claims.denial_rate", "claims.avg_charge_lag"]
        query = semantic.metric_query(silver, names, ["payers.payer_name", "encounters.department"])
        left = re.findall(r"Join LeftOuter[^\n]*\n[ :]*[:+]- (\w+)", query._jdf.queryExecution().optimizedPlan().toString())
        assert left == ["Aggregate", "Aggregate"]
        found = {r.payer_name: r for r in query.collect()}
        assert found[None].total_charges == 10_000.0 and sum(r.total_charges for r in found.values()) == 30_000.0
        assert found[None].denial_rate == 25.0 and {r.avg_charge_lag for r in found.values()} == {10.0}
        joined = re.search(r"SortMergeJoin", plan(query))
        assert joined or "ShuffledHashJoin" in plan(query)
        # Rows that reach the first join: (payer, encounter) pairs instead of claims.
        pairs = claims.select("payer_id", "encounter_id").distinct().count()
        shuffled = [int(m.apply("recordsRead").value()) for m in _metrics(query) if m.contains("recordsRead")]
        assert pairs < 1000 and max(shuffled) <= 6 * pairs
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _metrics(df):
    """Metric maps of all nodes of the executed plan, inside finished stages as well."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        out.append(node.metrics())
        if "AdaptiveSparkPlanExec" in node.getClass().getName():
            todo.append(node.executedPlan())
        elif "QueryStageExec" in node.getClass().getName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_scorecards_and_sizes_take_few_exchanges(stored):
    """Summed per claim, per encounter and payer, per provider; sizes counted per claim and per encounter."""
    from remitlake.operators import filters

    assert len(exchanges(plan(views.page_scorecards(stored, YEAR)))) <= 9
    sizes = plan(filters.cascade_sizes(stored, FilterParams("2024-01-01", "2024-12-31", "A", "Heart")))
    assert len(exchanges(sizes)) == 4 and sizes.count("Join ") <= 1  # the semi join of the scope and the two counts


def test_scorecards_equal_the_single_measures(make_silver):
    from conftest import PAYER_A, PAYER_B, PROVIDER, encounter, payment

    from remitlake.functions.columns import side_by_side
    from remitlake.functions.fixed_values import EXTRA_CUTS

    claims = [claim(i, payer_id="ABZ"[i % 3], claim_status=("Paid", "Denied", "Appealed")[i % 3], is_clean_claim=i % 2,
                    submission_date=(None, "2024-12-01", "2024-05-05")[i % 3], encounter_id=f"e{i % 9}") for i in range(40)]
    silver = make_silver(
        claims=claims, payers=[PAYER_A, PAYER_B], providers=[PROVIDER],
        encounters=[encounter(i, provider_id=("d1", "d2")[i % 4 == 0]) for i in range(8)],
        payments=[payment(i, f"c{i % 30}", 40.0 + i, (None, 50.0, 90.0)[i % 3]) for i in range(70)] + [payment(99, None, 1.0)],
        denials=[{"denial_id": f"n{i}", "claim_id": f"c{i}", "appeal_status": ("Won", "Lost", "Not Appealed", None)[i % 4]} for i in range(20)],
        operating_costs=[{"period": "2024-01", "total_rcm_cost": 33.0}],
    )
    single = side_by_side(
        views.ar_under_60_share(silver, YEAR), kpis.cost_to_collect_value(silver, YEAR),
        kpis.appeal_success_rate(silver, YEAR).select("appeal_success_rate"),
        views.provider_summary(silver, YEAR).select("avg_collection_rate", "avg_denial_rate", "avg_clean_claim_rate"),
        views.underpayment_summary(silver, YEAR).select("underpayment_rate"),
        views.patient_resp_summary(silver, YEAR).select("patient_resp_rate"),
    )
    expected = {r.kpi: (round(r.value, 9), r.status) for r in views.scorecard_from(single, EXTRA_CUTS).collect()}
    assert {r.kpi: (round(r.value, 9), r.status) for r in views.page_scorecards(silver, YEAR).collect()} == expected
    empty = make_silver()
    assert views.page_scorecards(empty, YEAR).count() == len(expected)
