"""Summed-first plans against the literal joins, on data where one key owns a third of the rows."""

import random

import pytest
from conftest import PAYER_A, PAYER_B, PROVIDER, claim, encounter, payment

from remitlake.operators import gold, kpis, quality, views
from remitlake.operators.filters import FilterParams

ALL = FilterParams("2024-01-01", "2024-12-31")
N = 120


@pytest.fixture(scope="module")
def skewed():
    """Encounter e0, claim c0, payer A and code 9 each hold a third of the rows or more."""
    rnd = random.Random(7)
    claims = [
        claim(
            i, encounter_id="e0" if i % 3 == 0 else f"e{rnd.randrange(1, 60)}", payer_id=rnd.choice(["A", "A", "B", None]),
            total_charge_amount=float(rnd.randrange(50, 500)), is_clean_claim=rnd.randrange(2),
            claim_status=rnd.choice(["Paid", "Denied", "Appealed", "Pending", "Partially Paid"]),
            date_of_service=f"2024-{rnd.randrange(1, 13):02d}-10",
        )
        for i in range(N)
    ]
    payments = [
        payment(
            i, "c0" if i % 3 == 0 else f"c{rnd.randrange(N + 10)}", float(rnd.randrange(1, 90)),
            rnd.choice([None, 0.0, 40.0, 80.0]),
        )
        for i in range(300)
    ]
    charges = [
        {
            "charge_id": f"h{i}", "encounter_id": "e0" if i % 3 == 0 else f"e{rnd.randrange(70)}", "units": rnd.randrange(4),
            "cpt_code": rnd.choice(["9", "9", "8", "7"]), "charge_amount": float(rnd.randrange(1, 50)),
            "cpt_description": "d", "service_date": "2024-01-10", "post_date": f"2024-01-{rnd.randrange(10, 20)}",
        }
        for i in range(300)
    ]
    encounters = [
        encounter(i, department=rnd.choice(["Heart", "Skin", None]), provider_id=rnd.choice(["d1", "d2", None]))
        for i in range(65)
    ]
    return {
        "payers": [PAYER_A, PAYER_B, {"payer_id": "I", "payer_name": "Idle", "payer_type": "Commercial"}],
        "providers": [PROVIDER, PROVIDER | {"provider_id": "d2", "provider_name": "Dr Two"}],
        "claims": claims, "payments": payments, "charges": charges, "encounters": encounters,
    }


LITERAL = {
    "payer_mix": """select c.payer_id, py.payer_name, py.payer_type, count(distinct c.claim_id) claim_count,
        sum(c.total_charge_amount) total_charges, coalesce(sum(p.payment_amount), 0) total_payments
        from claims c join payers py on c.payer_id = py.payer_id left join payments p on c.claim_id = p.claim_id
        group by all""",
    "department_performance": """select e.department, count(distinct e.encounter_id) encounter_count,
        sum(c.total_charge_amount) total_charges, coalesce(sum(p.payment_amount), 0) total_payments
        from claims c join encounters e on c.encounter_id = e.encounter_id left join payments p on c.claim_id = p.claim_id
        group by all""",
    "provider_performance": """select pr.provider_id, count(distinct c.encounter_id) encounter_count,
        count(distinct c.claim_id) claim_count, sum(c.total_charge_amount) total_charges,
        sum(c.is_clean_claim) clean_claims from claims c join encounters e on c.encounter_id = e.encounter_id
        join providers pr on e.provider_id = pr.provider_id group by all""",
    "cpt_analysis": """select l.*, claim_count, denied_claims from (select cpt_code, count(*) charge_count,
        sum(units) total_units, sum(charge_amount) total_charges from charges
        where encounter_id in (select encounter_id from claims) group by all) l join (
        select cpt_code, count(distinct claim_id) claim_count,
        sum(if(claim_status in ('Denied', 'Appealed'), 1, 0)) denied_claims from (
        select distinct cpt_code, claim_id, claim_status from charges h join claims c on h.encounter_id = c.encounter_id)
        group by all) m on l.cpt_code = m.cpt_code""",
    "underpayment_analysis": """select c.payer_id, count(p.payment_id) payment_count, sum(p.allowed_amount) total_allowed,
        sum(greatest(p.allowed_amount - p.payment_amount, 0)) total_underpaid from claims c
        join payers py on c.payer_id = py.payer_id join payments p on c.claim_id = p.claim_id
        where p.allowed_amount > 0 group by all""",
    "patient_resp_by_dept": """select e.department, e.encounter_type, count(distinct c.claim_id) claim_count,
        sum(greatest(p.allowed_amount - p.payment_amount, 0)) total_patient_resp,
        avg(greatest(p.allowed_amount - p.payment_amount, 0)) avg_patient_resp from claims c
        join encounters e on c.encounter_id = e.encounter_id join payments p on c.claim_id = p.claim_id
        where p.allowed_amount > 0 group by all""",
}
GOLD_LITERAL = {
    "monthly_kpis": """select substr(c.date_of_service, 1, 7) period, count(distinct c.claim_id) total_claims,
        sum(c.total_charge_amount) total_charges, coalesce(sum(p.payment_amount), 0) total_payments,
        avg(if(c.is_clean_claim = 1, 1, 0)) clean_claim_rate, avg(if(c.claim_status = 'Denied', 1, 0)) denial_rate
        from claims c left join payments p on c.claim_id = p.claim_id group by all""",
    "payer_performance": """select py.payer_id, count(distinct c.claim_id) total_claims, sum(c.total_charge_amount) total_charges,
        coalesce(sum(p.payment_amount), 0) total_payments from payers py left join claims c on py.payer_id = c.payer_id
        left join payments p on c.claim_id = p.claim_id group by all""",
    "department_performance": """select e.department, count(distinct e.encounter_id) total_encounters,
        coalesce(sum(h.charge_amount), 0) total_charges, coalesce(sum(p.payment_amount), 0) total_payments
        from encounters e left join charges h on e.encounter_id = h.encounter_id
        left join claims c on e.encounter_id = c.encounter_id left join payments p on c.claim_id = p.claim_id group by all""",
}


def same(found, expected):
    columns = expected.columns
    key = [c for c, t in expected.dtypes if t == "string"]

    def table(df):
        out = []
        for r in df.select(*columns).collect():
            out.append(tuple(round(float(v), 6) if not isinstance(v, str) and v is not None else v for v in r))
        return sorted(out, key=str)

    assert key and table(found) == table(expected)


def views_of(silver):
    for name, frame in silver.tables().items():
        frame.createOrReplaceTempView(name)


@pytest.mark.parametrize("name", LITERAL)
def test_measure(spark, make_silver, skewed, name):
    silver = make_silver(**skewed)
    views_of(silver)
    same(getattr(kpis, name)(silver, ALL), spark.sql(LITERAL[name]))


@pytest.mark.parametrize("name", GOLD_LITERAL)
def test_gold(spark, make_silver, skewed, name):
    silver = make_silver(**skewed)
    views_of(silver)
    same(getattr(gold, name)(silver), spark.sql(GOLD_LITERAL[name]))


def test_core_numbers_equal_the_single_ones(make_silver, skewed):
    silver = make_silver(**skewed)
    core = kpis.core_kpis(silver, ALL).first().asDict()
    for name in ("days_in_ar", "net_collection_rate", "gross_collection_rate", "clean_claim_rate", "denial_rate",
                 "first_pass_rate"):
        assert core[name] == getattr(kpis, f"{name}_value")(silver, ALL).first()[0]
    assert core["payment_accuracy"] == kpis.payment_accuracy(silver, ALL).first()[0]
    assert core["bad_debt_rate"] == kpis.bad_debt_rate(silver, ALL).first()["bad_debt_rate"]


def test_hot_orphan_key(make_silver, skewed):
    silver = make_silver(**skewed, **{"patients": [{"patient_id": "p1", "primary_payer_id": "A"}]})
    expected = sum(p["claim_id"] not in {c["claim_id"] for c in skewed["claims"]} for p in skewed["payments"])
    assert quality.run_check(silver, "payments_have_valid_claims").first()["failures"] == expected > 0


def test_waterfall_balances(make_silver, skewed):
    steps = {r["label"]: r["amount"] for r in views.revenue_waterfall(make_silver(**skewed), ALL).collect()}
    paid = sum(
        p["payment_amount"] for p in skewed["payments"] if p["claim_id"] in {c["claim_id"] for c in skewed["claims"]}
    )
    assert sum(steps.values()) == pytest.approx(paid)
