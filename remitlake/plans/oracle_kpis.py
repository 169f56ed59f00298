"""Expected results of the measures as plain SQL with literal joins."""

from __future__ import annotations

import re

from remitlake.operators.filters import FilterParams
from remitlake.plans.star_sql import TABLES_SQL


def month(column: str) -> str:
    return f"strftime(TRY_CAST({column} AS DATE), '%Y-%m')"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN CAST({part} AS DOUBLE) / ({whole}) * 100 ELSE 0.0 END"


def per(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN CAST({part} AS DOUBLE) / ({whole}) ELSE 0.0 END"


DENIED = "claim_status IN ('Denied', 'Appealed')"


def half_up(value: str, digits: int = 2) -> str:
    """Rounding of a sum of doubles through an exact decimal, so that a tie is a tie."""
    return f"CAST(ROUND(CAST({value} AS DECIMAL(28, 6)), {digits}) AS DOUBLE)"


def scope(p: FilterParams) -> dict[str, str]:
    """The claims in scope, as one named relation."""
    where = [f"c.date_of_service >= '{p.start_date}'", f"c.date_of_service <= '{p.end_date}'"]
    if p.payer_id:
        where.append(f"c.payer_id = '{p.payer_id}'")
    if p.department:
        where.append(f"e.department = '{p.department}'")
    if p.encounter_type:
        where.append(f"e.encounter_type = '{p.encounter_type}'")
    return {
        "fc": "SELECT c.* FROM claims c LEFT JOIN encounters e ON c.encounter_id = e.encounter_id WHERE "
        + " AND ".join(where)
    }


def needed(body: str, named: dict[str, str]) -> dict[str, str]:
    """The named relations that the body refers to, directly or not, in their given order."""
    found, texts = set(), [body]
    while texts:
        words = set(re.findall(r"\w+", texts.pop()))
        for name in words & named.keys() - found:
            found.add(name)
            texts.append(named[name])
    return {n: sql for n, sql in named.items() if n in found}


def statement(columns: str, body: str, relations: dict[str, str], digits: int = 4) -> str:
    """``columns``: names, with ``:d`` for rounded doubles and ``:i`` for integers."""
    out = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        out.append({
            "d": f"ROUND(CAST({name} AS DOUBLE), {digits}) AS {name}",
            "i": f'CAST("{name}" AS BIGINT) AS "{name}"',
        }.get(kind, name))
    used = needed(body, {**TABLES_SQL, **relations})
    ctes = ",\n".join(f"{n} AS ({sql})" for n, sql in used.items())
    return f"{'WITH ' + ctes if ctes else ''}\nSELECT {', '.join(out)} FROM ({body}) result"


MONTHLY = {
    # Claims with one row per payment (one without payment columns if there is none).
    "paid_rows": """SELECT fc.*, p.payment_id, p.payment_amount, p.allowed_amount, p.payment_date,
            p.is_accurate_payment FROM fc LEFT JOIN payments p ON p.claim_id = fc.claim_id""",
    "short_rows": """SELECT *, GREATEST(allowed_amount - payment_amount, 0) AS short FROM paid_rows
            WHERE allowed_amount > 0""",
    "mc": f"SELECT {month('date_of_service')} AS period, SUM(total_charge_amount) AS charges FROM fc GROUP BY 1",
    "mp": f"""SELECT {month('date_of_service')} AS period, COALESCE(SUM(payment_amount), 0) AS payments
              FROM paid_rows GROUP BY 1""",
    "ma": f"""SELECT {month('fc.date_of_service')} AS period,
              COALESCE(SUM(CASE WHEN a.adjustment_type_code = 'CONTRACTUAL' THEN a.adjustment_amount ELSE 0 END), 0)
              AS contractual_adj
              FROM fc LEFT JOIN adjustments a ON fc.claim_id = a.claim_id GROUP BY 1""",
    "m": """SELECT mc.period, mc.charges, COALESCE(mp.payments, 0) AS payments
            FROM mc LEFT JOIN mp ON mc.period = mp.period""",
    "open_claims": """SELECT * FROM (SELECT claim_id, date_of_service, submission_date, payer_id,
            CAST(CAST(total_charge_amount AS DECIMAL(28, 10)) - COALESCE(SUM(CAST(payment_amount AS DECIMAL(28, 10))), 0)
            AS DOUBLE) AS balance
            FROM paid_rows GROUP BY 1, 2, 3, 4, total_charge_amount) WHERE balance > 0""",
    "dar": f"""SELECT period, charges, payments,
            GREATEST(SUM(charges - payments) OVER w, 0) AS ar_balance,
            {per('GREATEST(SUM(charges - payments) OVER w, 0)', 'SUM(charges) OVER w / 90')} AS days_in_ar
            FROM m WINDOW w AS (ORDER BY period NULLS LAST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "dar_value": f"""SELECT ROUND({per('(SELECT COALESCE(SUM(balance), 0) FROM open_claims)', 'SUM(charges) / 90')}, 1)
            AS days_in_ar FROM (SELECT * FROM m ORDER BY period DESC LIMIT 3)""",
    "ncr": f"""SELECT m.*, COALESCE(ma.contractual_adj, 0) AS contractual_adj,
            {pct('m.payments', 'm.charges - COALESCE(ma.contractual_adj, 0)')} AS ncr
            FROM m LEFT JOIN ma ON m.period = ma.period""",
    "gcr": f"SELECT m.*, {pct('payments', 'charges')} AS gcr FROM m",
    "ccr": f"""SELECT {month('submission_date')} AS period, COUNT(*) AS total_claims, SUM(is_clean_claim) AS clean_claims,
            {pct('SUM(is_clean_claim)', 'COUNT(*)')} AS ccr FROM fc GROUP BY 1""",
    "dr": f"""SELECT {month('submission_date')} AS period, COUNT(*) AS total_claims,
            SUM(CASE WHEN {DENIED} THEN 1 ELSE 0 END) AS denied_claims,
            {pct(f'SUM(CASE WHEN {DENIED} THEN 1 ELSE 0 END)', 'COUNT(*)')} AS denial_rate FROM fc GROUP BY 1""",
    "fpr": f"""SELECT {month('submission_date')} AS period, COUNT(*) AS total,
            SUM(CASE WHEN claim_status = 'Paid' THEN 1 ELSE 0 END) AS paid,
            {pct("SUM(CASE WHEN claim_status = 'Paid' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS fpr FROM fc GROUP BY 1""",
    "reasons": f"""SELECT d.denial_reason_code, d.denial_reason_description, COUNT(*) AS "count",
            SUM(d.denied_amount) AS total_denied_amount, COALESCE(SUM(d.recovered_amount), 0) AS total_recovered,
            {pct('COALESCE(SUM(d.recovered_amount), 0)', 'SUM(d.denied_amount)')} AS recovery_rate
            FROM fc JOIN denials d ON fc.claim_id = d.claim_id GROUP BY 1, 2""",
    "lags": f"""SELECT {month('service_date')} AS period,
            datediff('day', TRY_CAST(service_date AS DATE), TRY_CAST(post_date AS DATE)) AS lag_days
            FROM charges WHERE encounter_id IN (SELECT encounter_id FROM fc)
            AND post_date IS NOT NULL AND service_date IS NOT NULL""",
    "collections": f"""SELECT {month('date_of_service')} AS period, COALESCE(SUM(payment_amount), 0) AS collections
            FROM paid_rows GROUP BY 1""",
    "ctc": f"""SELECT c.period, collections, COALESCE(o.total_rcm_cost, 0) AS rcm_cost,
            {pct('COALESCE(o.total_rcm_cost, 0)', 'collections')} AS cost_to_collect_pct
            FROM collections c LEFT JOIN operating_costs o ON c.period = o.period""",
    "ctc_value": f"""SELECT ROUND({pct('(SELECT SUM(total_rcm_cost) FROM operating_costs)', 'SUM(collections)')}, 2)
            AS cost_to_collect FROM collections""",
    "accuracy": f"""SELECT ROUND({pct('COALESCE(SUM(is_accurate_payment), 0)', 'COUNT(*)')}, 2) AS payment_accuracy
            FROM paid_rows WHERE payment_id IS NOT NULL""",
    "debt": """SELECT (SELECT COALESCE(SUM(total_charge_amount), 0) FROM fc) AS total_charges,
            COALESCE((SELECT SUM(adjustment_amount) FROM adjustments WHERE adjustment_type_code = 'WRITEOFF'
            AND claim_id IN (SELECT claim_id FROM fc)), 0) AS bad_debt""",
    "bad_debt_value": f"""SELECT ROUND({pct('bad_debt', 'total_charges')}, 2) AS bad_debt_rate, bad_debt, total_charges
            FROM debt""",
    "appeals": f"""SELECT ROUND({pct('SUM(won)', 'COUNT(*)')}, 2) AS appeal_success_rate, COUNT(*) AS total_appealed,
            COALESCE(SUM(won), 0) AS won FROM (
            SELECT CASE WHEN d.appeal_status = 'Won' THEN 1 ELSE 0 END AS won FROM fc JOIN denials d
            ON fc.claim_id = d.claim_id WHERE d.appeal_status IN ('Won', 'Lost', 'In Progress'))""",
    "per_claim": f"""SELECT claim_id, {month('date_of_service')} AS period,
            COALESCE(SUM(payment_amount), 0) AS payment_amount FROM paid_rows GROUP BY claim_id, date_of_service""",
    "mix": f"""SELECT *, {pct('total_payments', 'total_charges')} AS collection_rate FROM (
            SELECT payer_id, payer_name, payer_type, COUNT(DISTINCT claim_id) AS claim_count,
            SUM(total_charge_amount) AS total_charges, COALESCE(SUM(payment_amount), 0) AS total_payments
            FROM paid_rows JOIN payers USING (payer_id) GROUP BY 1, 2, 3)""",
    "payer_denials": f"""SELECT *, {pct('denied', 'total_claims')} AS denial_rate FROM (
            SELECT payer_id, payer_name, COUNT(*) AS total_claims, COUNT(*) FILTER ({DENIED}) AS denied
            FROM fc JOIN payers USING (payer_id) GROUP BY 1, 2)""",
    "visits": "SELECT encounter_id, department, encounter_type, provider_id FROM encounters",
    "dept": f"""SELECT *, {pct('total_payments', 'total_charges')} AS collection_rate,
            {per('total_payments', 'encounter_count')} AS avg_payment_per_encounter FROM (
            SELECT department, COUNT(DISTINCT encounter_id) AS encounter_count,
            COALESCE(SUM(total_charge_amount), 0) AS total_charges, COALESCE(SUM(payment_amount), 0) AS total_payments
            FROM paid_rows JOIN visits USING (encounter_id) GROUP BY 1)""",
    "prov_claims": f"""SELECT provider_id, COUNT(DISTINCT encounter_id) AS encounter_count,
            COUNT(DISTINCT claim_id) AS claim_count, SUM(total_charge_amount) AS total_charges,
            SUM(is_clean_claim) AS clean_claims, COUNT(*) FILTER ({DENIED}) AS denied_claims
            FROM fc JOIN visits USING (encounter_id) GROUP BY 1""",
    "prov_pay": """SELECT provider_id, COALESCE(SUM(payment_amount), 0) AS total_payments
            FROM paid_rows JOIN visits USING (encounter_id) GROUP BY 1""",
    "prov": f"""SELECT *, {pct('total_payments', 'total_charges')} AS collection_rate,
            {pct('denied_claims', 'claim_count')} AS denial_rate, {pct('clean_claims', 'claim_count')} AS clean_claim_rate,
            {per('total_payments', 'encounter_count')} AS avg_payment_per_encounter
            FROM prov_claims JOIN prov_pay USING (provider_id)
            JOIN (SELECT provider_id, provider_name, specialty, department FROM providers) USING (provider_id)""",
    "cpt_lines": """SELECT cpt_code, cpt_description, COUNT(charge_id) AS charge_count, SUM(units) AS total_units,
            SUM(charge_amount) AS total_charges FROM charges WHERE encounter_id IN (SELECT encounter_id FROM fc)
            GROUP BY 1, 2""",
    "cpt_claims": f"""SELECT cpt_code, COUNT(DISTINCT claim_id) AS claim_count,
            SUM(CASE WHEN {DENIED} THEN 1 ELSE 0 END) AS denied_claims FROM (
            SELECT DISTINCT ch.cpt_code, fc.claim_id, fc.claim_status FROM charges ch
            JOIN fc ON ch.encounter_id = fc.encounter_id) GROUP BY 1""",
    "cpt": f"""SELECT l.*, COALESCE(c.claim_count, 0) AS claim_count, COALESCE(c.denied_claims, 0) AS denied_claims,
            {per('l.total_charges', 'l.total_units')} AS avg_charge_per_unit,
            {pct('COALESCE(c.denied_claims, 0)', 'COALESCE(c.claim_count, 0)')} AS denial_rate
            FROM cpt_lines l LEFT JOIN cpt_claims c ON l.cpt_code = c.cpt_code""",
    "under": f"""SELECT *, {pct('total_underpaid', 'total_allowed')} AS underpayment_rate FROM (
            SELECT payer_id, payer_name, payer_type, COUNT(payment_id) AS payment_count, SUM(allowed_amount) AS total_allowed,
            SUM(payment_amount) AS total_paid, SUM(short) AS total_underpaid, COUNT(*) FILTER (short > 0) AS underpaid_count
            FROM short_rows JOIN payers USING (payer_id) GROUP BY 1, 2, 3)""",
    "under_trend": f"""SELECT *, {pct('total_underpaid', 'total_allowed')} AS underpayment_rate FROM (
            SELECT {month('payment_date')} AS period, SUM(allowed_amount) AS total_allowed,
            SUM(payment_amount) AS total_paid, SUM(short) AS total_underpaid FROM short_rows GROUP BY 1)""",
    "scrub": f"""SELECT fail_reason, COUNT(*) AS "count", SUM(total_charge_amount) AS total_charges,
            {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_dirty,
            CASE fail_reason
              WHEN 'MISSING_AUTH' THEN 'Missing Prior Authorization'
              WHEN 'ELIGIBILITY_FAIL' THEN 'Patient Eligibility Not Verified'
              WHEN 'CODING_ERROR' THEN 'Invalid CPT/ICD-10 Combination'
              WHEN 'DUPLICATE_SUBMISSION' THEN 'Duplicate Claim Submission'
              WHEN 'TIMELY_FILING' THEN 'Outside Timely Filing Window'
              WHEN 'MISSING_INFO' THEN 'Missing Required Information' ELSE fail_reason END AS label,
            CASE fail_reason
              WHEN 'MISSING_AUTH' THEN 'Automate auth check at scheduling; obtain PA before service date.'
              WHEN 'ELIGIBILITY_FAIL' THEN 'Verify eligibility 24-48h before appointment via real-time check.'
              WHEN 'CODING_ERROR' THEN 'Add CPT/ICD-10 edit rules to charge capture; schedule coder training.'
              WHEN 'DUPLICATE_SUBMISSION' THEN 'Enable duplicate detection in clearinghouse scrubber settings.'
              WHEN 'TIMELY_FILING' THEN 'Set automated alerts when claims approach payer filing deadlines.'
              WHEN 'MISSING_INFO' THEN 'Implement front-desk registration checklists with required-field validation.'
              ELSE '' END AS guidance
            FROM fc WHERE is_clean_claim = 0 AND fail_reason IS NOT NULL GROUP BY fail_reason""",
    "resp_payer": f"""SELECT *, {pct('total_patient_resp', 'total_allowed')} AS pct_of_allowed FROM (
            SELECT payer_name, payer_type, COUNT(payment_id) AS payment_count, SUM(short) AS total_patient_resp,
            AVG(short) AS avg_patient_resp, SUM(allowed_amount) AS total_allowed
            FROM short_rows JOIN payers USING (payer_id) GROUP BY 1, 2)""",
    "resp_dept": """SELECT department, encounter_type, COUNT(DISTINCT claim_id) AS claim_count,
            SUM(short) AS total_patient_resp, AVG(short) AS avg_patient_resp
            FROM short_rows JOIN visits USING (encounter_id) GROUP BY 1, 2""",
    "resp_trend": f"""SELECT *, {pct('total_patient_resp', 'total_allowed')} AS patient_resp_rate FROM (
            SELECT {month('date_of_service')} AS period, SUM(short) AS total_patient_resp,
            SUM(allowed_amount) AS total_allowed, COUNT(DISTINCT claim_id) AS claim_count FROM short_rows GROUP BY 1)""",
}


def aging(p: FilterParams) -> dict[str, str]:
    """Five buckets, also when there is nothing to put in."""
    days = f"datediff('day', TRY_CAST(COALESCE(submission_date, date_of_service) AS DATE), DATE '{p.end_date}')"
    return {
        "aged": f"""SELECT balance, CASE WHEN d <= 30 THEN '0-30' WHEN d <= 60 THEN '31-60' WHEN d <= 90 THEN '61-90'
                    WHEN d <= 120 THEN '91-120' ELSE '120+' END AS aging_bucket
                    FROM (SELECT balance, {days} AS d FROM open_claims)""",
        "buckets": "SELECT UNNEST(['0-30', '31-60', '61-90', '91-120', '120+']) AS aging_bucket",
        "aging": f"""SELECT b.aging_bucket, COUNT(a.balance) AS claim_count, COALESCE(SUM(a.balance), 0) AS total_ar,
                    {pct('COALESCE(SUM(a.balance), 0)', 'SUM(COALESCE(SUM(a.balance), 0)) OVER ()')} AS pct_of_total
                    FROM buckets b LEFT JOIN aged a ON a.aging_bucket = b.aging_bucket GROUP BY 1""",
    }


CORE = f"""SELECT (SELECT days_in_ar FROM dar_value) AS days_in_ar,
    (SELECT ROUND({pct('SUM(payments)', 'SUM(charges) - SUM(contractual_adj)')}, 2) FROM ncr) AS net_collection_rate,
    (SELECT ROUND({pct('SUM(payments)', 'SUM(charges)')}, 2) FROM m) AS gross_collection_rate,
    (SELECT ROUND({pct('SUM(clean_claims)', 'SUM(total_claims)')}, 2) FROM ccr) AS clean_claim_rate,
    (SELECT ROUND({pct('SUM(denied_claims)', 'SUM(total_claims)')}, 2) FROM dr) AS denial_rate,
    (SELECT ROUND({pct('SUM(paid)', 'SUM(total)')}, 2) FROM fpr) AS first_pass_rate,
    (SELECT payment_accuracy FROM accuracy) AS payment_accuracy,
    (SELECT bad_debt_rate FROM bad_debt_value) AS bad_debt_rate,
    (SELECT bad_debt FROM bad_debt_value) AS bad_debt"""

# Measure -> (columns, body over the relations above).
KPI_SQL = {
    "days_in_ar_value": ("days_in_ar:d", "SELECT * FROM dar_value"),
    "days_in_ar_trend": ("period charges:d payments:d ar_balance:d days_in_ar:d", "SELECT * FROM dar"),
    "net_collection_rate_value": (
        "net_collection_rate:d",
        f"SELECT ROUND({pct('SUM(payments)', 'SUM(charges) - SUM(contractual_adj)')}, 2) AS net_collection_rate FROM ncr",
    ),
    "net_collection_rate_trend": ("period charges:d payments:d contractual_adj:d ncr:d", "SELECT * FROM ncr"),
    "gross_collection_rate_value": (
        "gross_collection_rate:d",
        f"SELECT ROUND({pct('SUM(payments)', 'SUM(charges)')}, 2) AS gross_collection_rate FROM m",
    ),
    "gross_collection_rate_trend": ("period charges:d payments:d gcr:d", "SELECT * FROM gcr"),
    "clean_claim_rate_value": (
        "clean_claim_rate:d",
        f"SELECT ROUND({pct('SUM(clean_claims)', 'SUM(total_claims)')}, 2) AS clean_claim_rate FROM ccr",
    ),
    "clean_claim_rate_trend": ("period total_claims:i clean_claims:i ccr:d", "SELECT * FROM ccr"),
    "denial_rate_value": (
        "denial_rate:d", f"SELECT ROUND({pct('SUM(denied_claims)', 'SUM(total_claims)')}, 2) AS denial_rate FROM dr",
    ),
    "denial_rate_trend": ("period total_claims:i denied_claims:i denial_rate:d", "SELECT * FROM dr"),
    "denial_reasons": (
        "denial_reason_code denial_reason_description count:i total_denied_amount:d total_recovered:d recovery_rate:d",
        "SELECT * FROM reasons",
    ),
    "first_pass_rate_value": (
        "first_pass_rate:d", f"SELECT ROUND({pct('SUM(paid)', 'SUM(total)')}, 2) AS first_pass_rate FROM fpr",
    ),
    "first_pass_rate_trend": ("period total:i paid:i fpr:d", "SELECT * FROM fpr"),
    "charge_lag_value": ("charge_lag_days:d", "SELECT ROUND(COALESCE(AVG(lag_days), 0), 1) AS charge_lag_days FROM lags"),
    "charge_lag_trend": (
        "period lag_days:d", "SELECT period, AVG(lag_days) AS lag_days FROM lags WHERE period IS NOT NULL GROUP BY 1",
    ),
    "charge_lag_dist": (
        "lag_days count:i", "SELECT CAST(lag_days AS INT) AS lag_days, COUNT(*) AS \"count\" FROM lags GROUP BY 1",
    ),
    "cost_to_collect_value": ("cost_to_collect:d", "SELECT * FROM ctc_value"),
    "cost_to_collect_trend": ("period collections:d rcm_cost:d cost_to_collect_pct:d", "SELECT * FROM ctc"),
    "ar_aging": ("aging_bucket claim_count:i total_ar:d pct_of_total:d", "SELECT * FROM aging"),
    "ar_aging_total": ("total_ar:d", "SELECT SUM(total_ar) AS total_ar FROM aging"),
    "payment_accuracy": ("payment_accuracy:d", "SELECT * FROM accuracy"),
    "bad_debt_rate": ("bad_debt_rate:d bad_debt:d total_charges:d", "SELECT * FROM bad_debt_value"),
    "appeal_success_rate": ("appeal_success_rate:d total_appealed:i won:i", "SELECT * FROM appeals"),
    "avg_reimbursement_value": (
        "avg_reimbursement:d", "SELECT ROUND(COALESCE(AVG(payment_amount), 0), 2) AS avg_reimbursement FROM per_claim",
    ),
    "avg_reimbursement_trend": (
        "period payment_amount:d",
        "SELECT period, AVG(payment_amount) AS payment_amount FROM per_claim WHERE period IS NOT NULL GROUP BY 1",
    ),
    "payer_mix": (
        "payer_id payer_name payer_type claim_count:i total_charges:d total_payments:d collection_rate:d",
        "SELECT * FROM mix",
    ),
    "denial_rate_by_payer": (
        "payer_id payer_name total_claims:i denied:i denial_rate:d", "SELECT * FROM payer_denials",
    ),
    "department_performance": (
        "department encounter_count:i total_charges:d total_payments:d collection_rate:d avg_payment_per_encounter:d",
        "SELECT * FROM dept",
    ),
    "provider_performance": (
        "provider_id provider_name specialty department encounter_count:i claim_count:i total_charges:d "
        "total_payments:d clean_claims:i denied_claims:i collection_rate:d denial_rate:d clean_claim_rate:d "
        "avg_payment_per_encounter:d",
        "SELECT * FROM prov",
    ),
    "cpt_analysis": (
        "cpt_code cpt_description charge_count:i total_units:i total_charges:d claim_count:i denied_claims:i "
        "avg_charge_per_unit:d denial_rate:d",
        "SELECT * FROM cpt",
    ),
    "underpayment_analysis": (
        "payer_id payer_name payer_type payment_count:i total_allowed:d total_paid:d total_underpaid:d "
        "underpaid_count:i underpayment_rate:d",
        "SELECT * FROM under",
    ),
    "underpayment_total": (
        "total_underpaid:d", "SELECT COALESCE(SUM(total_underpaid), 0) AS total_underpaid FROM under",
    ),
    "underpayment_trend": (
        "period total_allowed:d total_paid:d total_underpaid:d underpayment_rate:d", "SELECT * FROM under_trend",
    ),
    "clean_claim_breakdown": (
        "fail_reason label count:i total_charges:d pct_of_dirty:d guidance", "SELECT * FROM scrub",
    ),
    "patient_resp_by_payer": (
        "payer_name payer_type payment_count:i total_patient_resp:d avg_patient_resp:d total_allowed:d pct_of_allowed:d",
        "SELECT * FROM resp_payer",
    ),
    "patient_resp_by_dept": (
        "department encounter_type claim_count:i total_patient_resp:d avg_patient_resp:d", "SELECT * FROM resp_dept",
    ),
    "patient_resp_trend": (
        "period total_patient_resp:d total_allowed:d claim_count:i patient_resp_rate:d", "SELECT * FROM resp_trend",
    ),
    "core_kpis": (
        "days_in_ar:d net_collection_rate:d gross_collection_rate:d clean_claim_rate:d denial_rate:d "
        "first_pass_rate:d payment_accuracy:d bad_debt_rate:d bad_debt:d",
        CORE,
    ),
}


def relations(p: FilterParams) -> dict[str, str]:
    return {**scope(p), **MONTHLY, **aging(p)}


def kpi_statement(name: str, p: FilterParams, digits: int = 4) -> str:
    columns, body = KPI_SQL[name]
    return statement(columns, body, relations(p), digits)
