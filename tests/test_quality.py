"""A broken copy of each table fails exactly its check."""

import pytest
from conftest import PAYER_A, PROVIDER, claim, encounter, one, payment, rows

from remitlake.operators import quality

GOOD = {
    "payers": [PAYER_A],
    "patients": [{"patient_id": "p1", "primary_payer_id": "A"}],
    "providers": [PROVIDER],
    "encounters": [encounter(1)],
    "charges": [{"charge_id": "h1", "encounter_id": "e1", "charge_amount": 1.0}],
    "claims": [claim(1)],
    "payments": [payment(1, "c1", 1.0), payment(2, "c1", 1.0, payer_id="PATIENT")],
    "denials": [{"denial_id": "n1", "claim_id": "c1", "denied_amount": 1.0}],
    "adjustments": [{"adjustment_id": "j1", "claim_id": "c1", "adjustment_amount": 1.0}],
    "operating_costs": [{"period": "2024-01", "total_rcm_cost": 1.0}],
}


def failed(silver):
    return {r["check"]: r["failures"] for r in rows(quality.run_all(silver, extra=True)) if not r["passed"]}


def test_all_pass(make_silver):
    silver = make_silver(**GOOD)
    results = rows(quality.run_all(silver))
    assert sorted(r["check"] for r in results) == sorted(quality.CHECKS) and len(results) == 25
    assert failed(silver) == {} and rows(quality.issues(silver)) == []


@pytest.mark.parametrize("table, row, expected", [
    ("claims", claim(2, encounter_id="e1", payer_id="Z"), {"claims_have_valid_payers": 1}),
    ("claims", claim(2, encounter_id=None), {"claims_have_valid_encounters": 1}),
    ("claims", claim(2, encounter_id="e1", patient_id="zz"), {"claims_have_valid_patients": 1}),
    ("claims", claim(2, encounter_id="e1", claim_status="Lost"), {"claim_status_values": 1}),
    ("claims", claim(2, encounter_id="e1", claim_status=None, is_clean_claim=None), {}),
    ("claims", claim(2, encounter_id="e1", is_clean_claim=2), {"clean_claim_boolean": 1}),
    ("payments", payment(3, "zz", -1.0, payer_id="Q"),
     {"payments_have_valid_claims": 1, "no_negative_payments": 1, "payments_have_valid_payers": 1}),
    ("payments", payment(None, "c1", 1.0, is_accurate_payment=5) | {"payment_id": None},
     {"no_null_primary_keys": 1, "payment_accuracy_boolean": 1}),
    ("encounters", encounter(2, provider_id=None), {"encounters_have_valid_providers": 1}),
    ("encounters", encounter(2, patient_id="zz"), {"encounters_have_valid_patients": 1}),
    ("charges", {"charge_id": "h2", "encounter_id": "zz", "charge_amount": -1.0},
     {"no_negative_charges": 1, "charges_have_valid_encounters": 1}),
    ("denials", {"denial_id": "n2", "claim_id": "zz", "denied_amount": -1.0},
     {"denials_have_valid_claims": 1, "no_negative_denied_amounts": 1}),
    ("adjustments", {"adjustment_id": "j2", "claim_id": "zz"}, {"adjustments_have_valid_claims": 1}),
    ("patients", {"patient_id": "p2", "primary_payer_id": "zz"}, {"patients_have_valid_payers": 1}),
])
def test_broken_row(make_silver, table, row, expected):
    assert failed(make_silver(**{**GOOD, table: GOOD[table] + [row]})) == expected


def test_empty_tables(make_silver):
    found = failed(make_silver())
    assert found == {f"{t}_not_empty": 1 for t in GOOD}


def test_check_that_cannot_run_is_a_warning(make_silver):
    silver = make_silver(**GOOD)
    silver = silver.with_tables(
        payments=silver.payments.drop("payment_amount").withColumnRenamed("allowed_amount", "payment_amount")
        .withColumnRenamed("payer_id", "payer").withColumnRenamed("claim_id", "claim"),
    )
    with pytest.raises(ValueError):
        silver.payments
    # Denial amounts are gone, the required columns are there.
    silver = make_silver(**GOOD)
    silver._opened["denials"] = silver.denials.drop("denied_amount")
    found = rows(quality.issues(silver))
    assert [(r["level"], r["table"]) for r in found] == [("warning", "validate_no_negative_denied_amounts")]
    assert one(quality.issue_rollup(quality.issues(silver))) == {"level": "warning", "count": 1}
    assert rows(quality.issue_filter(quality.issues(silver), level="error")) == []


def test_single_check(make_silver):
    silver = make_silver(**GOOD)
    for name in quality.CHECKS:
        r = one(quality.run_check(silver, name))
        assert r["check"] == name and r["passed"] and r["message"]


def test_references_are_one_grouping(spark, make_silver):
    """All references together: every table is read once more, and keys meet in one exchange."""
    import re

    silver = make_silver(claims=[claim(1)])
    text = quality._reference_results(silver, quality.REFERENCES + quality.EXTRA_REFERENCES)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Join" not in text


def test_null_and_exempt_and_hot_references(spark, make_silver):
    """A NULL reference is an orphan, also if a parent's key is NULL; an exempt value is none; a hot orphan counts row by row."""
    silver = make_silver(
        claims=[claim(i, payer_id="gone") for i in range(50)] + [claim(60, payer_id=None), claim(61, payer_id="A")],
        payers=[{"payer_id": "A"}, {"payer_id": None}, {"payer_id": "A"}],
        payments=[payment(1, "c1", 1.0, payer_id="PATIENT"), payment(2, "c1", 1.0, payer_id=None), payment(3, "zz", 1.0, payer_id="B")],
    )
    found = {r["check"]: r["failures"] for r in quality.run_all(silver, extra=True).collect()}
    assert found["claims_have_valid_payers"] == 51 and found["payments_have_valid_payers"] == 2
    assert found["payments_have_valid_claims"] == 1 and found["adjustments_have_valid_claims"] == 0
    for name in ("claims_have_valid_payers", "payments_have_valid_payers"):
        assert quality.run_check(silver, name).first().failures == found[name]
