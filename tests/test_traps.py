"""Small cases for the definitions that are easy to get wrong."""

import pytest
from conftest import PAYER_A, PAYER_B, PROVIDER, claim, encounter, one, payment, rows

from pyspark.sql import functions as F

from remitlake.operators import gold, kpis, process, semantic, views
from remitlake.operators.filters import FilterParams, cascade, filtered_claims, options, payer_id_of, search

YEAR = FilterParams("2024-01-01", "2024-12-31")


def test_denied_means_two_things(make_silver):
    s = make_silver(claims=[claim(1, claim_status="Denied"), claim(2, claim_status="Appealed"), claim(3), claim(4)])
    assert one(kpis.denial_rate_value(s, YEAR))["denial_rate"] == 50.0
    assert one(gold.monthly_kpis(s))["denial_rate"] == 0.25


def test_fan_out_counts_charges_once_per_payment(make_silver):
    s = make_silver(
        payers=[PAYER_A], claims=[claim(1), claim(2)], encounters=[encounter(1), encounter(2)], providers=[PROVIDER],
        payments=[payment(1, "c1", 30.0), payment(2, "c1", 20.0, payer_id="PATIENT")],
    )
    mix = one(kpis.payer_mix(s, YEAR))
    assert (mix["claim_count"], mix["total_charges"], mix["total_payments"]) == (2, 300.0, 50.0)
    assert one(gold.payer_performance(s))["total_charges"] == 300.0
    assert one(kpis.department_performance(s, YEAR))["total_charges"] == 300.0
    # These two sum both sides separately.
    assert one(kpis.provider_performance(s, YEAR))["total_charges"] == 200.0
    assert one(kpis.gross_collection_rate_value(s, YEAR))["gross_collection_rate"] == 25.0


def test_gold_department_multiplies_charges_and_payments(make_silver):
    charges = [
        {"charge_id": f"h{i}", "encounter_id": "e1", "charge_amount": a} for i, a in enumerate([10.0, 20.0, 30.0])
    ]
    s = make_silver(
        encounters=[encounter(1), encounter(2), encounter(3)], claims=[claim(1), claim(2)],
        charges=charges + [{"charge_id": "h9", "encounter_id": "e3", "charge_amount": 7.0}],
        payments=[payment(1, "c1", 5.0), payment(2, "c1", 6.0), payment(3, "c2", 9.0)],
    )
    r = one(gold.department_performance(s))
    assert r["total_encounters"] == 3
    assert r["total_charges"] == 60.0 * 2 + 7.0
    assert r["total_payments"] == 11.0 * 3 + 9.0


def test_months_come_from_different_dates(make_silver):
    s = make_silver(
        payers=[PAYER_A],
        claims=[claim(1, date_of_service="2024-01-31", submission_date="2024-02-01")],
        payments=[payment(1, "c1", 10.0, 20.0, payment_date="2024-03-01")],
    )
    assert one(kpis.gross_collection_rate_trend(s, YEAR))["period"] == "2024-01"
    assert one(kpis.clean_claim_rate_trend(s, YEAR))["period"] == "2024-02"
    assert one(kpis.underpayment_trend(s, YEAR))["period"] == "2024-03"
    assert one(kpis.patient_resp_trend(s, YEAR))["period"] == "2024-01"


def test_days_in_ar_value_and_trend_differ(make_silver):
    s = make_silver(
        claims=[claim(1), claim(2)], payments=[payment(1, "c1", 160.0)],
    )
    # Value: only the open claim (100) over 200 / 90 a day. Trend: net 200 - 160 = 40.
    assert one(kpis.days_in_ar_value(s, YEAR))["days_in_ar"] == 45.0
    trend = one(kpis.days_in_ar_trend(s, YEAR))
    assert trend["ar_balance"] == 40.0
    assert trend["days_in_ar"] == pytest.approx(18.0)


def test_rolling_window_counts_rows_not_months(make_silver):
    months = ["2024-01-10", "2024-02-10", "2024-06-10", "2024-07-10"]
    s = make_silver(claims=[claim(i, date_of_service=d, total_charge_amount=10.0 * (i + 1)) for i, d in enumerate(months)])
    trend = rows(kpis.days_in_ar_trend(s, YEAR))
    assert [r["ar_balance"] for r in trend] == [10.0, 30.0, 60.0, 90.0]


def test_cost_to_collect_ignores_the_date_range_for_costs(make_silver):
    s = make_silver(
        claims=[claim(1)], payments=[payment(1, "c1", 50.0)],
        operating_costs=[{"period": "2024-01", "total_rcm_cost": 5.0}, {"period": "1999-01", "total_rcm_cost": 5.0}],
    )
    assert one(kpis.cost_to_collect_value(s, YEAR))["cost_to_collect"] == 20.0
    assert one(kpis.cost_to_collect_trend(s, YEAR))["cost_to_collect_pct"] == 10.0


def test_reimbursement_is_per_claim(make_silver):
    s = make_silver(claims=[claim(1), claim(2, encounter_id="e1")], payments=[payment(1, "c1", 30.0)])
    assert one(kpis.avg_reimbursement_value(s, YEAR))["avg_reimbursement"] == 15.0


def test_aging_of_unknown_negative_and_paid_balances(make_silver):
    s = make_silver(
        claims=[
            claim(1, submission_date="bad"), claim(2, submission_date="2025-06-01"),
            claim(3, submission_date=None, date_of_service="2024-11-01"), claim(4),
        ],
        payments=[payment(1, "c4", 33.3), payment(2, "c4", 33.4), payment(3, "c4", 33.3)],
    )
    found = {r["aging_bucket"]: r["claim_count"] for r in rows(kpis.ar_aging(s, YEAR))}
    assert found == {"0-30": 1, "31-60": 1, "61-90": 0, "91-120": 0, "120+": 1}


def test_gold_aging_uses_service_date_and_a_given_day(make_silver):
    s = make_silver(claims=[
        claim(1, claim_status="Denied"), claim(2), claim(3, claim_status=None),
        claim(4, claim_status="Pending", date_of_service="x"),
    ])
    found = {r["aging_bucket"]: r["claim_count"] for r in rows(gold.ar_aging(s, "2024-02-01"))}
    assert found == {"0-30 days": 1, "120+ days": 1}


def test_cascade_differs_from_filtered_claims(make_silver):
    s = make_silver(
        encounters=[encounter(1, date_of_service="2023-12-31"), encounter(2)],
        claims=[claim(1), claim(2), claim(3, encounter_id="none")],
        charges=[{"charge_id": "h1", "encounter_id": "e2", "charge_amount": 1.0}],
        payments=[payment(1, "c1", 1.0), payment(2, "c9", 1.0)],
    )
    heart = FilterParams("2024-01-01", "2024-12-31", department="Heart")
    assert {r["claim_id"] for r in rows(filtered_claims(s, heart))} == {"c1", "c2"}
    scope = cascade(s, heart)
    assert {r["claim_id"] for r in rows(scope.claims)} == {"c2"}
    assert scope.payments.count() == 0
    # Payer narrows the claims, not the encounters and their charges.
    other = cascade(s, FilterParams("2024-01-01", "2024-12-31", payer_id="B"))
    assert (other.claims.count(), other.encounters.count(), other.charges.count()) == (0, 1, 1)


def test_unmatched_claims_stay_without_encounter_filter(make_silver):
    s = make_silver(claims=[claim(1)])
    assert filtered_claims(s, YEAR).count() == 1
    assert filtered_claims(s, FilterParams("2024-01-01", "2024-12-31", encounter_type="Outpatient")).count() == 0


def test_four_appeal_success_definitions(make_silver):
    states = ["Won", "Lost", "In Progress", "Not Appealed", None, " "]
    denials = [
        {"denial_id": f"d{i}", "claim_id": "c1", "denial_reason_code": "X", "denied_amount": 1.0, "appeal_status": a}
        for i, a in enumerate(states)
    ]
    s = make_silver(claims=[claim(1)], denials=denials)
    assert one(kpis.appeal_success_rate(s, YEAR)) == {"appeal_success_rate": 33.33, "total_appealed": 3, "won": 1}
    assert one(gold.denial_analysis(s))["appeal_success_rate"] == pytest.approx(1 / 6)
    assert one(semantic.metric_query(s, ["denials.appeal_success_rate"]))["appeal_success_rate"] == 25.0
    assert one(process.process_kpi(s, "appeal_success_rate"))["appeal_success_rate"] == 33.3


def test_underpayment_by_dollars_and_by_count(make_silver):
    s = make_silver(
        payers=[PAYER_A], claims=[claim(1)],
        payments=[payment(1, "c1", 50.0, 100.0), payment(2, "c1", 100.0, 100.0), payment(3, "c1", 5.0, 0.0),
                  payment(4, "c1", 5.0, None)],
    )
    assert one(kpis.underpayment_analysis(s, YEAR))["underpayment_rate"] == 25.0
    assert one(process.process_kpi(s, "underpayment_rate"))["underpayment_rate"] == 50.0
    assert one(semantic.metric_query(s, ["payments.underpayment_rate"]))["underpayment_rate"] == 25.0


def test_null_payment_counts_in_the_mean_patient_share(make_silver):
    s = make_silver(payers=[PAYER_A], claims=[claim(1)],
                    payments=[payment(1, "c1", 80.0, 100.0), payment(2, "c1", None, 100.0)])
    r = one(kpis.patient_resp_by_payer(s, YEAR))
    assert (r["payment_count"], r["total_patient_resp"], r["avg_patient_resp"]) == (2, 20.0, 10.0)


def test_unknown_month_gets_no_payments(make_silver):
    s = make_silver(
        claims=[claim(1), claim(2, date_of_service="2024-99-99")],
        payments=[payment(1, "c1", 10.0), payment(2, "c2", 10.0)],
        charges=[
            {"charge_id": "h1", "encounter_id": "e1", "charge_amount": 1.0, "service_date": "2024-01-01",
             "post_date": "2024-01-03"},
            {"charge_id": "h2", "encounter_id": "e1", "charge_amount": 1.0, "service_date": "2024-13-01",
             "post_date": "2024-01-03"},
        ],
    )
    trend = rows(kpis.gross_collection_rate_trend(s, FilterParams("2024-01-01", "2024-99-99")))
    assert [(r["period"], r["payments"]) for r in trend] == [("2024-01", 10.0), (None, 0.0)]
    assert [r["period"] for r in rows(kpis.charge_lag_trend(s, YEAR))] == ["2024-01"]


def test_zero_denominators(make_silver):
    s = make_silver(
        payers=[PAYER_A, PAYER_B], claims=[claim(1, total_charge_amount=0.0)], payments=[payment(1, "c1", 5.0)],
    )
    assert one(kpis.gross_collection_rate_value(s, YEAR))["gross_collection_rate"] == 0.0
    assert one(gold.monthly_kpis(s))["gross_collection_rate"] is None
    idle = next(r for r in rows(gold.payer_performance(s)) if r["payer_id"] == "B")
    assert (idle["total_claims"], idle["total_charges"], idle["denial_rate"]) == (0, None, None)
    assert one(views.payer_type_summary(s, YEAR))["collection_rate"] is None


@pytest.mark.parametrize("name", [n for n in dir(kpis) if n.endswith("_value") and n[0] != "_"])
def test_values_of_no_claims_are_zero(make_silver, name):
    (value,) = one(getattr(kpis, name)(make_silver(), YEAR)).values()
    assert value == 0.0


@pytest.mark.parametrize("name", [n for n in dir(kpis) if n.endswith("_trend") and n[0] != "_"])
def test_trends_of_no_claims_are_empty(make_silver, name):
    assert rows(getattr(kpis, name)(make_silver(), YEAR)) == []


def test_other_results_of_no_claims(make_silver):
    s = make_silver()
    assert [r["claim_count"] for r in rows(kpis.ar_aging(s, YEAR))] == [0] * 5
    assert one(kpis.payment_accuracy(s, YEAR))["payment_accuracy"] == 0.0
    assert one(kpis.bad_debt_rate(s, YEAR)) == {"bad_debt_rate": 0.0, "bad_debt": 0.0, "total_charges": 0.0}
    assert one(kpis.appeal_success_rate(s, YEAR))["total_appealed"] == 0
    for measure in (kpis.payer_mix, kpis.cpt_analysis, kpis.provider_performance, kpis.clean_claim_breakdown):
        assert rows(measure(s, YEAR)) == []


def test_charge_lag_has_two_definitions(make_silver):
    s = make_silver(
        claims=[claim(1)],
        charges=[{"charge_id": "h1", "encounter_id": "e1", "charge_amount": 1.0, "service_date": "2024-01-10",
                  "post_date": "2024-01-13"}],
    )
    assert one(kpis.charge_lag_value(s, YEAR))["charge_lag_days"] == 3.0
    assert one(semantic.metric_query(s, ["claims.avg_charge_lag"]))["avg_charge_lag"] == 10.0


def test_freshness_status(spark):
    log = spark.sql("""select * from values ('claims', timestamp_ntz'2024-01-01 00:00:00', 1L, 'claims.csv'),
        ('payers', timestamp_ntz'2024-01-01 00:00:00', 1L, 'payers.csv'), ('new', null, 1L, 'new.csv'),
        ('denials', timestamp_ntz'2024-01-01 10:00:00', 1L, 'x')
        t(domain, last_loaded_at, row_count, source_file)""")
    found = {r["domain"]: r for r in rows(kpis.data_freshness(log, F.lit("2024-01-02 01:00:00").cast("timestamp_ntz")))}
    assert found["claims"]["status"] == "critical" and found["claims"]["age_hours"] == 25.0
    assert found["payers"]["status"] == "stale"
    assert found["denials"]["status"] == "stale"
    assert found["new"]["status"] == "fresh" and found["new"]["label"] == "new" and found["new"]["cadence_hours"] == 24


def test_unknown_fail_reason_keeps_its_code(make_silver):
    s = make_silver(claims=[claim(1, is_clean_claim=0, fail_reason="ODD"), claim(2, is_clean_claim=0)])
    r = one(kpis.clean_claim_breakdown(s, YEAR))
    assert (r["label"], r["guidance"], r["pct_of_dirty"]) == ("ODD", "", 100.0)


def test_code_with_two_descriptions_counts_claims_once(make_silver):
    s = make_silver(
        claims=[claim(1, claim_status="Denied"), claim(2, encounter_id="e1")],
        charges=[
            {"charge_id": f"h{i}", "encounter_id": "e1", "cpt_code": "9", "cpt_description": d, "units": 1,
             "charge_amount": 10.0} for i, d in enumerate(["a", "b", "a"])
        ],
    )
    found = {r["cpt_description"]: r for r in rows(kpis.cpt_analysis(s, YEAR))}
    assert found["a"]["charge_count"] == 2 and found["b"]["charge_count"] == 1
    assert all((r["claim_count"], r["denied_claims"], r["denial_rate"]) == (2, 1, 50.0) for r in found.values())


def test_options_and_search(make_silver):
    s = make_silver(
        payers=[PAYER_B, PAYER_A, PAYER_A | {"payer_id": "C"}], encounters=[encounter(1), encounter(2)],
    )
    assert [r["payer_name"] for r in rows(options(s, "payer_name"))] == ["Alpha", "Alpha", "Beta"]
    assert [r["department"] for r in rows(options(s, "department"))] == ["Heart"]
    assert one(payer_id_of(s, "Beta"))["payer_id"] == "B"
    assert {r["payer_id"] for r in rows(search(s.payers, "ALPHA", payer_type="Commercial"))} == {"A", "C"}


def test_alerts_are_strict_and_graded(spark):
    values = spark.sql("""select 35.0D days_in_ar, 94.9D net_collection_rate, 90.0D clean_claim_rate, 10.1D denial_rate,
        70.0D gross_collection_rate, 85.0D first_pass_rate, 95.0D payment_accuracy, 3.0D bad_debt_rate""")
    assert {r["kpi"] for r in rows(views.alerts_from(values))} == {"Net Collection Rate", "Denial Rate"}
    grades = {r["kpi"]: r["status"] for r in rows(views.scorecard_from(values))}
    assert grades["Days in A/R"] == "warn" and grades["Net Collection Rate"] == "warn"
    assert grades["Bad Debt Rate"] == "warn" and grades["Gross Collection Rate"] == "warn"


def test_display_text(spark):
    values = spark.sql("select * from values (null), (1234567.0D), (1500.0D), (12.34D), (250000.5D) t(v)")
    shown = [r["s"] for r in rows(values.select(process.display_text(F.col("v"), "%").alias("s")))]
    assert shown == ["—", "$1.2M%", "1,500%", "12.3%", "250,000.5%"]


def test_balances_are_exact(make_silver):
    """Paid in full by ten payments of a tenth: nothing open; open by half a millionth: open."""
    from remitlake.operators.kpis import ar_aging
    from remitlake.plans.params import EVERYTHING

    day = {"date_of_service": "1998-01-05", "submission_date": "1998-01-06", "payer_id": "P"}
    silver = make_silver(
        claims=[{"claim_id": "full", "total_charge_amount": 1.0, **day}, {"claim_id": "open", "total_charge_amount": 5.0, **day}],
        payments=[{"payment_id": f"f{i}", "claim_id": "full", "payment_amount": 0.1} for i in range(10)]
        + [{"payment_id": "o", "claim_id": "open", "payment_amount": 4.9999995}],
    )
    rows = [r for r in ar_aging(silver, EVERYTHING).collect() if r["claim_count"]]
    assert [r["claim_count"] for r in rows] == [1]
