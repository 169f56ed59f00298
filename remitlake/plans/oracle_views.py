"""Expected results of gold views, process measures, diagnostics, checks and report views as plain SQL."""

from __future__ import annotations

from remitlake.plans.oracle_kpis import CORE, DENIED, KPI_SQL, half_up, month, pct, per, relations, statement
from remitlake.operators.filters import FilterParams
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
    UNFILTERED_VIEWS,
    VIEW_VARIANTS,
)
from remitlake.sources.schemas import DATE_COLUMNS, FLAG_COLUMNS, REQUIRED, TABLES

FANNED = "claims c LEFT JOIN payments p ON c.claim_id = p.claim_id"
AGE = f"datediff('day', TRY_CAST(c.date_of_service AS DATE), DATE '{AS_OF}')"

GOLD_REL = {
    "g_rows": f"SELECT c.*, p.payment_amount FROM {FANNED}",
    "g_monthly": f"""SELECT {month('date_of_service')} AS period, COUNT(DISTINCT claim_id) AS total_claims,
        SUM(total_charge_amount) AS total_charges, COALESCE(SUM(payment_amount), 0) AS total_payments,
        AVG(CASE WHEN is_clean_claim = 1 THEN 1.0 ELSE 0.0 END) AS clean_claim_rate,
        AVG(CASE WHEN claim_status = 'Denied' THEN 1.0 ELSE 0.0 END) AS denial_rate,
        COALESCE(SUM(payment_amount), 0) / NULLIF(SUM(total_charge_amount), 0) AS gross_collection_rate
        FROM g_rows GROUP BY 1""",
    "g_payer": """SELECT y.payer_id, y.payer_name, y.payer_type, COUNT(DISTINCT g.claim_id) AS total_claims,
        SUM(g.total_charge_amount) AS total_charges, COALESCE(SUM(g.payment_amount), 0) AS total_payments,
        AVG(CASE WHEN g.claim_id IS NULL THEN NULL WHEN g.claim_status = 'Denied' THEN 1.0 ELSE 0.0 END) AS denial_rate,
        COALESCE(SUM(g.payment_amount), 0) / NULLIF(SUM(g.total_charge_amount), 0) AS gross_collection_rate
        FROM payers y LEFT JOIN g_rows g ON g.payer_id = y.payer_id GROUP BY 1, 2, 3""",
    "g_dept": """SELECT *, total_payments / NULLIF(total_encounters, 0) AS revenue_per_encounter FROM (
        SELECT e.department, COUNT(DISTINCT e.encounter_id) AS total_encounters,
        COALESCE(SUM(h.charge_amount), 0) AS total_charges, COALESCE(SUM(g.payment_amount), 0) AS total_payments
        FROM encounters e LEFT JOIN charges h USING (encounter_id) LEFT JOIN g_rows g USING (encounter_id) GROUP BY 1)""",
    "g_aging": f"""SELECT CASE WHEN {AGE} <= 30 THEN '0-30 days' WHEN {AGE} <= 60 THEN '31-60 days'
        WHEN {AGE} <= 90 THEN '61-90 days' WHEN {AGE} <= 120 THEN '91-120 days' ELSE '120+ days' END AS aging_bucket,
        COUNT(c.claim_id) AS claim_count, SUM(c.total_charge_amount) AS total_billed,
        COALESCE(SUM(p.payment_amount), 0) AS total_collected,
        SUM(c.total_charge_amount) - COALESCE(SUM(p.payment_amount), 0) AS outstanding_balance
        FROM {FANNED} WHERE c.claim_status NOT IN ('Paid') GROUP BY 1""",
    "g_denial": """SELECT denial_reason_code, denial_reason_description, COUNT(denial_id) AS denial_count,
        SUM(denied_amount) AS total_denied, COALESCE(SUM(recovered_amount), 0) AS total_recovered,
        CAST(SUM(CASE WHEN appeal_status = 'Won' THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(COUNT(denial_id), 0)
        AS appeal_success_rate FROM denials GROUP BY 1, 2""",
}
GOLD_SQL = {
    "monthly_kpis": (
        "period total_claims:i total_charges:d total_payments:d clean_claim_rate:d denial_rate:d gross_collection_rate:d",
        "SELECT * FROM g_monthly",
    ),
    "payer_performance": (
        "payer_id payer_name payer_type total_claims:i total_charges:d total_payments:d denial_rate:d "
        "gross_collection_rate:d",
        "SELECT * FROM g_payer",
    ),
    "department_performance": (
        "department total_encounters:i total_charges:d total_payments:d revenue_per_encounter:d", "SELECT * FROM g_dept",
    ),
    "ar_aging": (
        "aging_bucket claim_count:i total_billed:d total_collected:d outstanding_balance:d", "SELECT * FROM g_aging",
    ),
    "denial_analysis": (
        "denial_reason_code denial_reason_description denial_count:i total_denied:d total_recovered:d "
        "appeal_success_rate:d",
        "SELECT * FROM g_denial",
    ),
}


def _share(part: str, whole: str, table: str, where: str = "") -> str:
    return f"SELECT ROUND(100.0 * {part} / NULLIF({whole}, 0), 1) AS v FROM {table} {where}"


def _ones(condition: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS DOUBLE)"


PROCESS = {
    "encounter_count": "SELECT COUNT(*) AS v FROM encounters",
    "patient_count": "SELECT COUNT(DISTINCT patient_id) AS v FROM encounters",
    "charge_lag_days": "SELECT ROUND(AVG(datediff('day', TRY_CAST(service_date AS DATE), TRY_CAST(post_date AS DATE))), 1)"
    " AS v FROM charges WHERE service_date IS NOT NULL AND post_date IS NOT NULL",
    "clean_claim_rate": _share(_ones("is_clean_claim = 1"), "COUNT(*)", "claims"),
    "total_claims": "SELECT COUNT(*) AS v FROM claims",
    "first_pass_rate": _share(_ones("claim_status = 'Paid'"), "COUNT(*)", "claims"),
    "gcr": _share("SUM(payment_amount)", "(SELECT SUM(charge_amount) FROM charges)", "payments"),
    "payment_accuracy": _share(_ones("is_accurate_payment = 1"), "COUNT(*)", "payments"),
    "denial_rate": _share(_ones(DENIED), "COUNT(*)", "claims"),
    "appeal_success_rate": _share(
        _ones("appeal_status = 'Won'"), "COUNT(*)", "denials",
        "WHERE appeal_status IS NOT NULL AND TRIM(appeal_status) <> '' AND appeal_status <> 'Not Appealed'",
    ),
    "days_in_ar": """SELECT ROUND((c - p - a) / NULLIF(c / GREATEST(days, 1), 0), 0) AS v FROM (
        SELECT SUM(charge_amount) AS c, (SELECT SUM(payment_amount) FROM payments) AS p,
        (SELECT SUM(adjustment_amount) FROM adjustments) AS a,
        datediff('day', MIN(TRY_CAST(service_date AS DATE)), MAX(TRY_CAST(service_date AS DATE))) + 1 AS days
        FROM charges)""",
    "patient_resp_rate": _share(
        "SUM(CASE WHEN allowed_amount > payment_amount AND allowed_amount > 0 THEN allowed_amount - payment_amount "
        "ELSE 0 END)", "SUM(CASE WHEN allowed_amount > 0 THEN allowed_amount END)", "payments",
    ),
    "underpayment_rate": _share(
        _ones("allowed_amount > payment_amount AND allowed_amount > 0"), "COUNT(*)", "payments",
        "WHERE allowed_amount > 0",
    ),
}
_COUNTS = {"encounter_count", "patient_count", "total_claims"}

TABLE_NAMES = [
    "payers", "patients", "providers", "encounters", "charges", "claims", "payments", "denials", "adjustments",
    "operating_costs",
]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


DIAG_SQL = {
    "silver_counts": (
        "layer table_name row_count:i",
        _union([f"SELECT 'SILVER' AS layer, '{t.upper()}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLE_NAMES]),
    ),
    "bronze_counts": (
        "layer table_name row_count:i",
        _union([f"SELECT 'BRONZE' AS layer, '{t.upper()}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLE_NAMES]),
    ),
    "gold_counts": (
        "layer table_name row_count:i",
        _union([
            f"SELECT 'GOLD' AS layer, '{n}' AS table_name, COUNT(*) AS row_count FROM {r}"
            for n, r in [("MONTHLY_KPIS", "g_monthly"), ("PAYER_PERFORMANCE", "g_payer"),
                         ("DEPARTMENT_PERFORMANCE", "g_dept"), ("AR_AGING", "g_aging"), ("DENIAL_ANALYSIS", "g_denial")]
        ]),
    ),
    "payment_profile": (
        "total_payments:i min_amount:d max_amount:d avg_amount:d total_amount:d",
        f"""SELECT COUNT(*) AS total_payments, MIN(payment_amount) AS min_amount, MAX(payment_amount) AS max_amount,
        ROUND(AVG(payment_amount), 2) AS avg_amount, {half_up('SUM(payment_amount)')} AS total_amount FROM payments""",
    ),
    "claims_with_payments": (
        "total_claims:i claims_with_payments:i claims_without_payments:i",
        f"""SELECT COUNT(DISTINCT c.claim_id) AS total_claims, COUNT(DISTINCT p.claim_id) AS claims_with_payments,
        COUNT(DISTINCT c.claim_id) - COUNT(DISTINCT p.claim_id) AS claims_without_payments FROM {FANNED}""",
    ),
    "orphan_payments": (
        "orphan_payments:i",
        """SELECT COUNT(*) AS orphan_payments FROM payments p LEFT JOIN claims c ON p.claim_id = c.claim_id
        WHERE c.claim_id IS NULL""",
    ),
    "gcr_spot_check": (
        "period charges:d payments:d gcr_pct:d",
        f"""SELECT {month('c.date_of_service')} AS period, {half_up('SUM(c.total_charge_amount)')} AS charges,
        {half_up('COALESCE(SUM(p.payment_amount), 0)')} AS payments,
        ROUND(COALESCE(SUM(p.payment_amount), 0) * 100 / NULLIF(SUM(c.total_charge_amount), 0), 1) AS gcr_pct
        FROM {FANNED} GROUP BY 1 ORDER BY 1 LIMIT 6""",
    ),
    "date_parse_sample": (
        "raw_value parsed_date period",
        f"""SELECT date_of_service AS raw_value, CAST(TRY_CAST(date_of_service AS DATE) AS VARCHAR) AS parsed_date,
        {month('date_of_service')} AS period FROM claims ORDER BY claim_id LIMIT 5""",
    ),
    "unparseable_dates": (
        "claims:i unparseable:i",
        """SELECT COUNT(*) AS claims, COUNT(CASE WHEN date_of_service IS NOT NULL
        AND TRY_CAST(date_of_service AS DATE) IS NULL THEN 1 END) AS unparseable FROM claims""",
    ),
    "status_distribution": (
        "claim_status cnt:i pct:d",
        """SELECT claim_status, COUNT(*) AS cnt, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1) AS pct
        FROM claims GROUP BY 1""",
    ),
}


# ------------------------------------------------------------------ checks

def _orphans(table: str, column: str, parent: str, key: str, where: str = "TRUE") -> str:
    return (f"SELECT COUNT(*) AS n FROM {table} x LEFT JOIN {parent} y ON x.{column} = y.{key} "
            f"WHERE y.{key} IS NULL AND {where}")


DQ = {
    **{f"{t}_not_empty": (t, f"SELECT CASE WHEN COUNT(*) > 0 THEN 0 ELSE 1 END AS n FROM {t}") for t in TABLE_NAMES},
    "claims_have_valid_payers": ("claims", _orphans("claims", "payer_id", "payers", "payer_id")),
    "claims_have_valid_encounters": ("claims", _orphans("claims", "encounter_id", "encounters", "encounter_id")),
    "claims_have_valid_patients": ("claims", _orphans("claims", "patient_id", "patients", "patient_id")),
    "payments_have_valid_claims": ("payments", _orphans("payments", "claim_id", "claims", "claim_id")),
    "denials_have_valid_claims": ("denials", _orphans("denials", "claim_id", "claims", "claim_id")),
    "adjustments_have_valid_claims": ("adjustments", _orphans("adjustments", "claim_id", "claims", "claim_id")),
    "encounters_have_valid_patients": ("encounters", _orphans("encounters", "patient_id", "patients", "patient_id")),
    "encounters_have_valid_providers": ("encounters", _orphans("encounters", "provider_id", "providers", "provider_id")),
    "no_negative_charges": ("charges", "SELECT COUNT(*) AS n FROM charges WHERE charge_amount < 0"),
    "no_negative_payments": ("payments", "SELECT COUNT(*) AS n FROM payments WHERE payment_amount < 0"),
    "no_negative_denied_amounts": ("denials", "SELECT COUNT(*) AS n FROM denials WHERE denied_amount < 0"),
    "claim_status_values": (
        "claims",
        "SELECT COUNT(*) AS n FROM claims WHERE claim_status NOT IN "
        "('Paid', 'Partially Paid', 'Denied', 'Pending', 'Appealed')",
    ),
    "clean_claim_boolean": ("claims", "SELECT COUNT(*) AS n FROM claims WHERE is_clean_claim NOT IN (0, 1)"),
    "payment_accuracy_boolean": ("payments", "SELECT COUNT(*) AS n FROM payments WHERE is_accurate_payment NOT IN (0, 1)"),
    "no_null_primary_keys": (
        "all",
        "SELECT SUM(n) AS n FROM (" + _union([
            f"SELECT COUNT(*) AS n FROM {t} WHERE {t[:-1]}_id IS NULL" for t in TABLE_NAMES if t != "operating_costs"
        ]) + ")",
    ),
    "patients_have_valid_payers": ("patients", _orphans("patients", "primary_payer_id", "payers", "payer_id")),
    "payments_have_valid_payers": (
        "payments", _orphans("payments", "payer_id", "payers", "payer_id", "(x.payer_id IS NULL OR x.payer_id <> 'PATIENT')"),
    ),
    "charges_have_valid_encounters": ("charges", _orphans("charges", "encounter_id", "encounters", "encounter_id")),
}
STANDARD_CHECKS = list(DQ)[:25]


def _check(name: str) -> str:
    table, sql = DQ[name]
    return f"SELECT '{name}' AS \"check\", '{table}' AS \"table\", n AS failures, n = 0 AS passed FROM ({sql})"


ISSUES = f"""SELECT 'error' AS level, "check" AS "table" FROM ({_union([_check(n) for n in STANDARD_CHECKS])})
    WHERE NOT passed"""


# ------------------------------------------------------------------ load log

def loaded_at(table: str) -> str:
    """When a table was loaded last."""
    return [when for when, tables in LOADS if tables is None or table in tables][-1]


# Rows that come through the load: lines without a key are left out.
LOADED = {"charges": "charges WHERE post_date = service_date OR units <> 50"}
LOG = _union([
    f"SELECT '{t}' AS domain, COUNT(*) AS row_count, '{t}.csv' AS source_file, "
    f"TIMESTAMP '{loaded_at(t)}' AS loaded_at FROM {LOADED.get(t, t)}"
    for t in TABLE_NAMES
])
FRESH_REL = {
    "log_rows": LOG,
    "fresh": f"""SELECT *, CASE WHEN age_hours > 3 * cadence_hours THEN 'critical'
        WHEN age_hours > cadence_hours THEN 'stale' ELSE 'fresh' END AS status FROM (
        SELECT domain, row_count, source_file, epoch(TIMESTAMP '{AS_OF_TIME}' - loaded_at) / 3600 AS age_hours,
        CAST(loaded_at AS VARCHAR) AS last_loaded_at,
        CASE domain WHEN 'claims' THEN 4 WHEN 'payments' THEN 6 WHEN 'encounters' THEN 4 WHEN 'charges' THEN 4
          WHEN 'denials' THEN 12 WHEN 'adjustments' THEN 8 WHEN 'operating_costs' THEN 720 ELSE 24 END AS cadence_hours,
        CASE domain WHEN 'claims' THEN 'Claims' WHEN 'payments' THEN 'Payments / ERA'
          WHEN 'encounters' THEN 'Encounters / ADT' WHEN 'charges' THEN 'Charges / CDM' WHEN 'denials' THEN 'Denials'
          WHEN 'adjustments' THEN 'Adjustments' WHEN 'payers' THEN 'Payer Master'
          WHEN 'patients' THEN 'Patient Demographics' WHEN 'providers' THEN 'Provider Roster'
          WHEN 'operating_costs' THEN 'Operating Costs' END AS label
        FROM log_rows)""",
}


# ------------------------------------------------------------------ report views

def _in_range(p: FilterParams) -> str:
    return f"TRY_CAST(date_of_service AS DATE) BETWEEN DATE '{p.start_date}' AND DATE '{p.end_date}'"


def view_rel(p: FilterParams) -> dict[str, str]:
    in_range = _in_range(p)
    return {
        "f_claims": f"SELECT * FROM claims WHERE {in_range}",
        "f_encounters": f"SELECT * FROM encounters WHERE {in_range}",
        "f_payments": "SELECT * FROM payments WHERE claim_id IN (SELECT claim_id FROM f_claims)",
        "f_denials": "SELECT * FROM denials WHERE claim_id IN (SELECT claim_id FROM f_claims)",
        "f_adjustments": "SELECT * FROM adjustments WHERE claim_id IN (SELECT claim_id FROM f_claims)",
        "f_charges": "SELECT * FROM charges WHERE encounter_id IN (SELECT encounter_id FROM f_encounters)",
        "core": CORE,
        "money": """SELECT (SELECT SUM(total_charge_amount) FROM f_claims) AS c, (SELECT SUM(payment_amount) FROM f_payments) AS p,
            (SELECT SUM(adjustment_amount) FROM f_adjustments) AS a,
            (SELECT SUM(denied_amount) - SUM(recovered_amount) FROM f_denials) AS lost""",
        "under60": """SELECT SUM(CASE WHEN aging_bucket IN ('0-30', '31-60') THEN pct_of_total ELSE 0 END) AS ar_under_60_pct
            FROM aging""",
        "prov_sum": """SELECT AVG(collection_rate) AS avg_collection_rate, AVG(denial_rate) AS avg_denial_rate,
            AVG(clean_claim_rate) AS avg_clean_claim_rate, COUNT(CASE WHEN denial_rate > 15 THEN 1 END)
            AS high_denial_providers FROM prov""",
        "under_sum": f"""SELECT SUM(total_underpaid) AS recovery_opportunity,
            {pct('SUM(total_underpaid)', 'SUM(total_allowed)')} AS underpayment_rate, SUM(underpaid_count) AS underpaid_claims,
            {per('SUM(total_underpaid)', 'SUM(underpaid_count)')} AS avg_underpayment FROM under""",
        "resp_sum": f"""SELECT SUM(total_patient_resp) AS total_patient_resp,
            {pct('SUM(total_patient_resp)', 'SUM(total_allowed)')} AS patient_resp_rate,
            AVG(avg_patient_resp) AS avg_patient_resp,
            COALESCE(SUM(CASE WHEN lower(payer_type) LIKE '%self%' THEN total_patient_resp END), 0) AS self_pay_exposure
            FROM resp_payer""",
        "drill_payer": f"SELECT * FROM f_claims WHERE payer_id = '{PAYER}'",
        "drill_dept_enc": f"SELECT * FROM f_encounters WHERE department = '{DEPARTMENT}'",
        "drill_dept": "SELECT * FROM f_claims WHERE encounter_id IN (SELECT encounter_id FROM drill_dept_enc)",
        "drill_prov": f"""SELECT * FROM f_claims WHERE encounter_id IN
            (SELECT encounter_id FROM encounters WHERE provider_id = '{PROVIDER}')""",
    }



def _graded(rows: list[tuple], source: str) -> str:
    """kpi, value, status rows."""
    parts = []
    for kpi, column, better, good, warn in rows:
        parts.append(
            f"SELECT '{kpi}' AS kpi, CAST({column} AS DOUBLE) AS value, CASE WHEN {column} {better} {good} THEN 'good' "
            f"WHEN {column} {better} {warn} THEN 'warn' ELSE 'bad' END AS status FROM {source[column] if isinstance(source, dict) else source}"
        )
    return _union(parts)


CUTS = [
    ("Days in A/R", "days_in_ar", "<", 35, 50), ("Net Collection Rate", "net_collection_rate", ">", 95, 90),
    ("Clean Claim Rate", "clean_claim_rate", ">", 90, 80), ("Denial Rate", "denial_rate", "<", 10, 15),
    ("Gross Collection Rate", "gross_collection_rate", ">", 70, 55), ("First-Pass Rate", "first_pass_rate", ">", 85, 75),
    ("Payment Accuracy", "payment_accuracy", ">", 95, 90), ("Bad Debt Rate", "bad_debt_rate", "<", 3, 5),
]
PAGE_CUTS = [
    ("A/R in 0-60 Days", "ar_under_60_pct", ">", 70, 50), ("Cost to Collect", "cost_to_collect", "<", 8, 12),
    ("Appeal Success Rate", "appeal_success_rate", ">", 50, 30), ("Avg Collection Rate", "avg_collection_rate", ">", 95, 85),
    ("Avg Denial Rate", "avg_denial_rate", "<", 10, 15), ("Avg Clean Claim Rate", "avg_clean_claim_rate", ">", 90, 80),
    ("Underpayment Rate", "underpayment_rate", "<", 1, 3),
    ("Patient Responsibility Rate", "patient_resp_rate", "<", 20, 35),
]
PAGE_SOURCE = {
    "ar_under_60_pct": "under60", "cost_to_collect": "ctc_value", "appeal_success_rate": "appeals",
    "avg_collection_rate": "prov_sum", "avg_denial_rate": "prov_sum", "avg_clean_claim_rate": "prov_sum",
    "underpayment_rate": "under_sum", "patient_resp_rate": "resp_sum",
}
ALERTS = [
    ("Days in A/R", "days_in_ar", ">", 35.0), ("Net Collection Rate", "net_collection_rate", "<", 95.0),
    ("Clean Claim Rate", "clean_claim_rate", "<", 90.0), ("Denial Rate", "denial_rate", ">", 10.0),
    ("First-Pass Rate", "first_pass_rate", "<", 85.0), ("Payment Accuracy", "payment_accuracy", "<", 95.0),
    ("Bad Debt Rate", "bad_debt_rate", ">", 3.0),
]


def _counts(table: str, column: str) -> tuple[str, str]:
    return f"{column} count:i", f'SELECT {column}, COUNT(*) AS "count" FROM {table} WHERE {column} IS NOT NULL GROUP BY 1'


def _totals(claims: str, extra: str = "") -> str:
    return f"""SELECT {extra} COUNT(*) AS claims, COALESCE(SUM(total_charge_amount), 0) AS total_charges,
        COUNT(CASE WHEN {DENIED} THEN 1 END) AS denied_claims, (SELECT COALESCE(SUM(payment_amount), 0) FROM payments
        WHERE claim_id IN (SELECT claim_id FROM {claims})) AS total_payments FROM {claims}"""


PAID = "(SELECT claim_id, SUM(payment_amount) AS payment_amount FROM f_payments GROUP BY 1)"


def _ranking(by: str, direction: str) -> tuple[str, str]:
    return (
        f"provider_id provider_name {by}:d",
        f"SELECT provider_id, provider_name, {by} FROM prov ORDER BY {by} {direction}, provider_id LIMIT 15",
    )


def _money_text(column: str) -> str:
    return f"'$' || format('{{:,.2f}}', {half_up(column)})"


VIEW_SQL = {
    "kpi_alerts": (
        "kpi value:d direction threshold:d",
        _union([
            f"SELECT '{k}' AS kpi, {c} AS value, '{s}' AS direction, {t} AS threshold FROM core WHERE {c} {s} {t}"
            for k, c, s, t in ALERTS
        ]),
    ),
    "kpi_scorecard": ("kpi value:d status", _graded(CUTS, "core")),
    "page_scorecards": ("kpi value:d status", _graded(PAGE_CUTS, PAGE_SOURCE)),
    "freshness_rollup": (
        "fresh_count:i stale_count:i critical_count:i worst_status",
        """SELECT COUNT(CASE WHEN status = 'fresh' THEN 1 END) AS fresh_count,
        COUNT(CASE WHEN status = 'stale' THEN 1 END) AS stale_count,
        COUNT(CASE WHEN status = 'critical' THEN 1 END) AS critical_count,
        CASE WHEN COUNT(CASE WHEN status = 'critical' THEN 1 END) > 0 THEN 'critical'
        WHEN COUNT(CASE WHEN status = 'stale' THEN 1 END) > 0 THEN 'stale' ELSE 'fresh' END AS worst_status FROM fresh""",
    ),
    "monthly_volume": (
        "period encounters:i claims:i",
        f"""SELECT COALESCE(e.period, c.period) AS period, COALESCE(e.n, 0) AS encounters, COALESCE(c.n, 0) AS claims FROM
        (SELECT {month('date_of_service')} AS period, COUNT(encounter_id) AS n FROM f_encounters GROUP BY 1) e FULL OUTER JOIN
        (SELECT {month('date_of_service')} AS period, COUNT(claim_id) AS n FROM f_claims GROUP BY 1) c
        ON e.period = c.period""",
    ),
    "revenue_waterfall": (
        "step label measure amount:d",
        """SELECT 1 AS step, 'Total Charges' AS label, 'absolute' AS measure, c AS amount FROM money
        UNION ALL SELECT 2, 'Adjustments', 'relative', -a FROM money
        UNION ALL SELECT 3, 'Denials (Lost)', 'relative', -lost FROM money
        UNION ALL SELECT 4, 'Collections', 'relative', p - c + a + lost FROM money
        UNION ALL SELECT 5, 'Net Revenue', 'total', 0 FROM money""",
    ),
    "gcr_ncr_trend": (
        "period gcr:d ncr:d",
        "SELECT g.period, g.gcr, COALESCE(n.ncr, 0) AS ncr FROM gcr g LEFT JOIN ncr n ON g.period = n.period",
    ),
    "financial_summary": (
        "metric amount:d",
        """SELECT 'Total Charges' AS metric, c AS amount FROM money UNION ALL SELECT 'Total Payments', p FROM money
        UNION ALL SELECT 'Total Adjustments', a FROM money UNION ALL SELECT 'Bad Debt Write-offs', bad_debt FROM debt
        UNION ALL SELECT 'Net Revenue', p FROM money""",
    ),
    "claim_status_distribution": _counts("f_claims", "claim_status"),
    "top_denial_reasons": (
        "denial_reason_code denial_reason_description count:i total_denied_amount:d total_recovered:d recovery_rate:d",
        'SELECT * FROM reasons ORDER BY "count" DESC, denial_reason_code LIMIT 10',
    ),
    "scrub_summary": (
        "dirty_claims:i charges_at_risk:d top_reason",
        """SELECT SUM("count") AS dirty_claims, SUM(total_charges) AS charges_at_risk,
        (SELECT label FROM scrub ORDER BY "count" DESC, fail_reason LIMIT 1) AS top_reason FROM scrub""",
    ),
    "ar_under_60_share": ("ar_under_60_pct:d", "SELECT * FROM under60"),
    "cash_flow": (
        "period charges:d payments:d net_cash_flow:d",
        f"""SELECT c.period, charges, COALESCE(payments, 0) AS payments, COALESCE(payments, 0) - charges AS net_cash_flow FROM
        (SELECT {month('date_of_service')} AS period, SUM(total_charge_amount) AS charges FROM f_claims GROUP BY 1) c
        LEFT JOIN (SELECT {month('c.date_of_service')} AS period, SUM(p.payment_amount) AS payments FROM f_payments p
        JOIN f_claims c ON p.claim_id = c.claim_id GROUP BY 1) p ON c.period = p.period""",
    ),
    "charge_lag_histogram": (
        "lag_days count:i",
        'SELECT CAST(lag_days AS INT) AS lag_days, COUNT(*) AS "count" FROM lags WHERE lag_days <= 30 GROUP BY 1',
    ),
    "caption_counts": (
        "claims:i encounters:i",
        "SELECT (SELECT COUNT(*) FROM f_claims) AS claims, (SELECT COUNT(*) FROM f_encounters) AS encounters",
    ),
    "payer_comparison": (
        "payer_name payer_type claim_count:i total_charges:d total_payments:d collection_rate:d denial_rate:d",
        f"""SELECT m.payer_name, m.payer_type, m.claim_count, {half_up('m.total_charges')} AS total_charges,
        {half_up('m.total_payments')} AS total_payments, {half_up('m.collection_rate')} AS collection_rate,
        {half_up('d.denial_rate')} AS denial_rate FROM mix m LEFT JOIN payer_denials d ON m.payer_id = d.payer_id""",
    ),
    "payer_type_summary": (
        "payer_type claims:i charges:d payments:d collection_rate:d",
        """SELECT payer_type, SUM(claim_count) AS claims, SUM(total_charges) AS charges, SUM(total_payments) AS payments,
        ROUND(SUM(total_payments) / SUM(total_charges) * 100, 2) AS collection_rate FROM mix GROUP BY 1""",
    ),
    "payer_drilldown_totals": ("claims:i total_charges:d denied_claims:i total_payments:d", _totals("drill_payer")),
    "payer_drilldown_status": _counts("drill_payer", "claim_status"),
    "payer_drilldown_reasons": _counts(
        "(SELECT * FROM denials WHERE claim_id IN (SELECT claim_id FROM drill_payer))", "denial_reason_description"),
    "payer_drilldown_detail": (
        "claim_id date_of_service submission_date total_charge_amount:d claim_status is_clean_claim payment_amount:d",
        f"""SELECT c.claim_id, date_of_service, submission_date, total_charge_amount, claim_status, is_clean_claim,
        COALESCE(p.payment_amount, 0) AS payment_amount FROM drill_payer c LEFT JOIN {PAID} p ON c.claim_id = p.claim_id""",
    ),
    "encounter_type_by_department": (
        "department encounter_type count:i",
        'SELECT department, encounter_type, COUNT(*) AS "count" FROM f_encounters WHERE department IS NOT NULL GROUP BY 1, 2',
    ),
    "department_drilldown_totals": (
        "encounters:i claims:i total_charges:d total_payments:d",
        _totals("drill_dept", "(SELECT COUNT(*) FROM drill_dept_enc) AS encounters,"),
    ),
    "department_drilldown_types": _counts("drill_dept_enc", "encounter_type"),
    "department_drilldown_status": _counts("drill_dept", "claim_status"),
    "department_drilldown_detail": (
        "encounter_id date_of_service encounter_type patient_id provider_id claim_id total_charge_amount:d claim_status "
        "payment_amount:d",
        f"""SELECT e.encounter_id, e.date_of_service, e.encounter_type, e.patient_id, e.provider_id, c.claim_id,
        c.total_charge_amount, c.claim_status, COALESCE(p.payment_amount, 0) AS payment_amount
        FROM drill_dept_enc e LEFT JOIN drill_dept c ON e.encounter_id = c.encounter_id
        LEFT JOIN {PAID} p ON c.claim_id = p.claim_id""",
    ),
    "provider_summary": (
        "avg_collection_rate:d avg_denial_rate:d avg_clean_claim_rate:d high_denial_providers:i", "SELECT * FROM prov_sum",
    ),
    "provider_top_payments": _ranking("total_payments", "DESC"),
    "provider_top_denial": _ranking("denial_rate", "DESC"),
    "provider_low_clean": _ranking("clean_claim_rate", "ASC"),
    "provider_top_per_encounter": _ranking("avg_payment_per_encounter", "DESC"),
    "provider_scorecard": (
        "provider_name specialty department encounter_count:i claim_count:i total_charges:d total_payments:d "
        "collection_rate:d denial_rate:d clean_claim_rate:d",
        f"""SELECT provider_name, specialty, department, encounter_count, claim_count, {half_up('total_charges')} AS total_charges,
        {half_up('total_payments')} AS total_payments, {half_up('collection_rate')} AS collection_rate,
        {half_up('denial_rate')} AS denial_rate, {half_up('clean_claim_rate')} AS clean_claim_rate FROM prov""",
    ),
    "provider_drilldown_totals": (
        "encounter_count:i claim_count:i collection_rate:d collection_delta:d denial_rate:d denial_delta:d",
        f"""SELECT encounter_count, claim_count, collection_rate,
        ROUND(collection_rate - (SELECT avg_collection_rate FROM prov_sum), 1) AS collection_delta, denial_rate,
        ROUND(denial_rate - (SELECT avg_denial_rate FROM prov_sum), 1) AS denial_delta
        FROM prov WHERE provider_id = '{PROVIDER}'""",
    ),
    "provider_drilldown_status": _counts("drill_prov", "claim_status"),
    "provider_drilldown_reasons": _counts(
        "(SELECT * FROM denials WHERE claim_id IN (SELECT claim_id FROM drill_prov))", "denial_reason_description"),
    "cpt_summary": (
        "codes:i total_charges:d high_denial_codes:i top10_pct:d",
        f"""SELECT COUNT(*) AS codes, SUM(total_charges) AS total_charges,
        COUNT(CASE WHEN denial_rate > 15 THEN 1 END) AS high_denial_codes,
        {pct('(SELECT SUM(total_charges) FROM (SELECT total_charges FROM cpt ORDER BY total_charges DESC LIMIT 10))',
             'SUM(total_charges)')} AS top10_pct FROM cpt""",
    ),
    "cpt_top_revenue": (
        "label total_charges:d",
        "SELECT cpt_code || ' — ' || substr(cpt_description, 1, 30) AS label, total_charges FROM cpt "
        "ORDER BY total_charges DESC, cpt_code LIMIT 15",
    ),
    "cpt_top_denial": (
        "label denial_rate:d",
        "SELECT cpt_code || ' — ' || substr(cpt_description, 1, 25) AS label, denial_rate FROM cpt "
        "WHERE charge_count >= 10 ORDER BY denial_rate DESC, cpt_code LIMIT 15",
    ),
    "cpt_top_share": (
        "cpt_code total_charges:d",
        "SELECT cpt_code, total_charges FROM cpt ORDER BY total_charges DESC, cpt_code LIMIT 12",
    ),
    "cpt_top_unit_charge": (
        "cpt_code avg_charge_per_unit:d",
        "SELECT cpt_code, avg_charge_per_unit FROM cpt ORDER BY avg_charge_per_unit DESC, cpt_code LIMIT 15",
    ),
    "underpayment_summary": (
        "recovery_opportunity:d underpayment_rate:d underpaid_claims:i avg_underpayment:d", "SELECT * FROM under_sum",
    ),
    **{
        f"underpayment_by_{by}": (
            f"payer_id payer_name {by}:d",
            f"SELECT payer_id, payer_name, {by} FROM under ORDER BY {by} DESC, payer_id",
        )
        for by in ("total_underpaid", "underpayment_rate", "total_allowed")
    },
    "patient_resp_summary": (
        "total_patient_resp:d patient_resp_rate:d avg_patient_resp:d self_pay_exposure:d", "SELECT * FROM resp_sum",
    ),
    "patient_resp_by_payer_type": (
        "payer_type total_patient_resp:d total_allowed:d pr_rate:d pr_label",
        """SELECT payer_type, SUM(total_patient_resp) AS total_patient_resp, SUM(total_allowed) AS total_allowed,
        ROUND(SUM(total_patient_resp) / SUM(total_allowed) * 100, 1) AS pr_rate,
        format('{:.1f}%', ROUND(SUM(total_patient_resp) / SUM(total_allowed) * 100, 1)) AS pr_label
        FROM resp_payer GROUP BY 1""",
    ),
    **{
        f"patient_resp_by_{by}": (
            f"{by} total_patient_resp:d",
            f"SELECT {by}, SUM(total_patient_resp) AS total_patient_resp FROM resp_dept WHERE {by} IS NOT NULL GROUP BY 1",
        )
        for by in ("department", "encounter_type")
    },
    "detail_denial_reasons": (
        "denial_reason_code denial_reason_description count:i total_denied_amount:d total_recovered:d recovery_rate:d",
        f"""SELECT denial_reason_code, denial_reason_description, "count", {half_up('total_denied_amount')} AS total_denied_amount,
        {half_up('total_recovered')} AS total_recovered, {half_up('recovery_rate')} AS recovery_rate FROM reasons""",
    ),
    "detail_scrubbing": (
        "label count:i total_charges:d pct_of_dirty:d guidance",
        f"""SELECT label, "count", {half_up('total_charges')} AS total_charges, {half_up('pct_of_dirty')} AS pct_of_dirty, guidance
        FROM scrub""",
    ),
    "detail_department": (
        "department encounter_count:i total_charges total_payments collection_rate avg_payment_per_encounter",
        f"""SELECT department, encounter_count, {_money_text('total_charges')} AS total_charges,
        {_money_text('total_payments')} AS total_payments, format('{{:.1f}}%', collection_rate) AS collection_rate,
        {_money_text('avg_payment_per_encounter')} AS avg_payment_per_encounter FROM dept""",
    ),
    "aging_detail": (
        "aging_bucket claim_count:i total_ar pct_of_total",
        f"""SELECT aging_bucket, claim_count, {_money_text('total_ar')} AS total_ar,
        format('{{:.1f}}%', pct_of_total) AS pct_of_total FROM ({KPI_SQL['ar_aging'][1]})""",
    ),
    "detail_cpt": (
        "cpt_code cpt_description charge_count:i total_units:i total_charges:d avg_charge_per_unit:d claim_count:i "
        "denied_claims:i denial_rate:d",
        f"""SELECT cpt_code, cpt_description, charge_count, total_units, {half_up('total_charges')} AS total_charges,
        {half_up('avg_charge_per_unit')} AS avg_charge_per_unit, claim_count, denied_claims,
        {half_up('denial_rate')} AS denial_rate FROM cpt""",
    ),
    "detail_underpayment": (
        "payer_name payer_type payment_count:i total_allowed:d total_paid:d total_underpaid:d underpaid_count:i "
        "underpayment_rate:d",
        f"""SELECT payer_name, payer_type, payment_count, {half_up('total_allowed')} AS total_allowed,
        {half_up('total_paid')} AS total_paid, {half_up('total_underpaid')} AS total_underpaid, underpaid_count,
        {half_up('underpayment_rate')} AS underpayment_rate FROM under""",
    ),
    "detail_patient_resp": (
        "payer_name payer_type payment_count:i total_patient_resp:d avg_patient_resp:d pct_of_allowed:d",
        f"""SELECT payer_name, payer_type, payment_count, {half_up('total_patient_resp')} AS total_patient_resp,
        {half_up('avg_patient_resp')} AS avg_patient_resp, {half_up('pct_of_allowed')} AS pct_of_allowed FROM resp_payer""",
    ),
    "filter_date_bounds": (
        "min_date max_date",
        """SELECT CAST(MIN(TRY_CAST(date_of_service AS DATE)) AS VARCHAR) AS min_date,
        CAST(MAX(TRY_CAST(date_of_service AS DATE)) AS VARCHAR) AS max_date FROM claims""",
    ),
    "filter_payer_names": ("payer_name", "SELECT payer_name FROM payers"),
    "filter_departments": ("department", "SELECT DISTINCT department FROM encounters"),
    "filter_encounter_types": ("encounter_type", "SELECT DISTINCT encounter_type FROM encounters"),
    "filter_payer_id": ("payer_id", f"SELECT payer_id FROM payers WHERE payer_name = '{PAYER_NAME}' LIMIT 1"),
    "search_providers": (
        "provider_id provider_name npi department specialty",
        """SELECT * FROM providers WHERE department = 'DEPT_3' AND contains(lower(concat_ws('|', provider_id, provider_name,
        npi, department, specialty)), '00000001')""",
    ),
}
for _t, _columns in {
    "claims": "claim_id encounter_id payer_id total_charge_amount:d claim_status",
    "encounters": "encounter_id date_of_service department",
    "payments": "payment_id claim_id payment_amount:d",
    "denials": "denial_id claim_id denied_amount:d",
    "adjustments": "adjustment_id claim_id adjustment_amount:d",
    "charges": "charge_id encounter_id charge_amount:d",
}.items():
    VIEW_SQL[f"cascade_{_t}"] = (_columns, f"SELECT * FROM f_{_t}")

# The cascade with every filter set: encounters by their own date, payer on claims only.
def cascade_rel(p: FilterParams) -> dict[str, str]:
    in_range = _in_range(p)
    return {
        "n_encounters": f"""SELECT * FROM encounters WHERE {in_range} AND department = '{DEPARTMENT}'
            AND encounter_type = '1-URGENT'""",
        "n_claims": f"""SELECT * FROM claims WHERE {in_range} AND payer_id = '{PAYER}'
            AND encounter_id IN (SELECT encounter_id FROM n_encounters)""",
        "n_sizes": _union([
            "SELECT 'claims' AS \"table\", COUNT(*) AS n FROM n_claims",
            "SELECT 'encounters', COUNT(*) FROM n_encounters",
            "SELECT 'payments', COUNT(*) FROM payments WHERE claim_id IN (SELECT claim_id FROM n_claims)",
            "SELECT 'denials', COUNT(*) FROM denials WHERE claim_id IN (SELECT claim_id FROM n_claims)",
            "SELECT 'adjustments', COUNT(*) FROM adjustments WHERE claim_id IN (SELECT claim_id FROM n_claims)",
            "SELECT 'charges', COUNT(*) FROM charges WHERE encounter_id IN (SELECT encounter_id FROM n_encounters)",
        ]),
    }

# Export sheets that hold rows of a table.
ROW_SHEETS = {
    ("collections_revenue", "Filtered Claims"): ("claims", "f_claims"),
    ("collections_revenue", "Filtered Payments"): ("payments", "f_payments"),
    ("collections_revenue", "Filtered Adjustments"): ("adjustments", "f_adjustments"),
    ("claims_denials", "Filtered Denials"): ("denials", "f_denials"),
    (f"payer_drilldown_{PAYER}", "Denials"): (
        "denials", "(SELECT * FROM denials WHERE claim_id IN (SELECT claim_id FROM drill_payer))",
    ),
    (f"dept_drilldown_{DEPARTMENT}", "Denials"): (
        "denials", "(SELECT * FROM denials WHERE claim_id IN (SELECT claim_id FROM drill_dept))",
    ),
}


def typed_statement(table: str) -> str:
    """A table as it is."""
    return statement(" ".join(f"{c}:d" if t == "double" else c for c, t in TABLES[table]), f"SELECT * FROM {table} x", {})


def search_statement(text: str) -> str:
    """Providers with a text in lower case in any column."""
    columns = [c for c, _ in TABLES["providers"]]
    return statement(" ".join(columns), f"SELECT * FROM providers x WHERE contains(lower(concat_ws('|', {', '.join(columns)})), '{text}')", {})


def row_sheet_statements() -> dict[tuple[str, str], str]:
    rel = {**relations(EVERYTHING), **view_rel(EVERYTHING)}
    out = {}
    for key, (table, rows) in ROW_SHEETS.items():
        shown = " ".join(f"{c}:d" if t == "double" else c for c, t in TABLES[table])
        out[key] = statement(shown, f"SELECT * FROM {rows} x", rel)
    return out


VIEW_SQL["cascade_sizes"] = ('"table" n:i', "SELECT * FROM n_sizes")


def _loader_column(table: str, name: str) -> str:
    if name in DATE_COLUMNS.get(table, []):
        return f"CAST(TRY_CAST({name} AS DATE) AS VARCHAR) AS {name}"
    if name in FLAG_COLUMNS.get(table, []):
        return f"COALESCE({name} <> 0, TRUE) AS {name}"
    if (table, name) == ("operating_costs", "period"):
        return "period || '-01' AS period"
    return name


def loader_statements(more_digits: dict[str, int]) -> dict[str, str]:
    out = {}
    for table in ("encounters", "claims", "payments", "denials", "operating_costs"):
        shown = " ".join(f"{c}:d" if t == "double" else c for c, t in TABLES[table])
        body = "SELECT " + ", ".join(_loader_column(table, c) for c, _ in TABLES[table]) + f" FROM {table}"
        out[f"loader_{table}"] = statement(shown, body, {}, more_digits.get(f"etl_{table}", 4))
    return out


def _displayed(name: str, body: str) -> str:
    end = DISPLAY_SUFFIXES.get(name, "")
    return f"""SELECT '{name}' AS name, CASE WHEN v IS NULL THEN '—'
        WHEN ABS(v) >= 1e6 THEN '$' || format('{{:,.1f}}', v / 1e6) || 'M{end}'
        WHEN v = FLOOR(v) AND ABS(v) < 100000 THEN format('{{:,.0f}}', v) || '{end}'
        ELSE format('{{:,.1f}}', v) || '{end}' END AS text FROM (SELECT CAST(v AS DOUBLE) AS v FROM ({body}) x) y"""


def view_statements() -> dict[str, str]:
    out = {}
    for suffix, p in VIEW_VARIANTS.items():
        rel = {**relations(p), **view_rel(p), **FRESH_REL, **cascade_rel(p)}
        out |= {
            f"view_{name}{suffix}": statement(columns, body, rel)
            for name, (columns, body) in VIEW_SQL.items() if not suffix or name not in UNFILTERED_VIEWS
        }
    out |= {f"gold_{name}": statement(c, b, GOLD_REL) for name, (c, b) in GOLD_SQL.items()}
    for name, body in PROCESS.items():
        kind = "i" if name in _COUNTS else "d"
        out[f"proc_{name}"] = statement(f"{name}:{kind}", f"SELECT v AS {name} FROM ({body})", {})
    wide = ", ".join(f"(SELECT v FROM ({body})) AS {name}" for name, body in PROCESS.items())
    columns = " ".join(f"{n}:{'i' if n in _COUNTS else 'd'}" for n in PROCESS)
    out["proc_all"] = statement(columns, f"SELECT {wide}", {})
    out |= {f"diag_{name}": statement(c, b, GOLD_REL) for name, (c, b) in DIAG_SQL.items()}
    dq_columns = '"check" "table" failures:i passed'
    out |= {f"dq_{name}": statement(dq_columns, _check(name), {}) for name in DQ}
    out["dq_all"] = statement(dq_columns, _union([_check(n) for n in DQ]), {})
    out["dq_issues"] = statement('level "table"', ISSUES, {})
    out["dq_issue_rollup"] = statement("level count:i", f'SELECT level, COUNT(*) AS "count" FROM ({ISSUES}) GROUP BY 1', {})
    out["dq_issues_of_error"] = out["dq_issues"]
    for level, table in (("error", "claims_have_valid_payers"), ("warning", None)):
        which = f"\"table\" = '{table}'" if table else f"level = '{level}'"
        out[f"dq_issues_of_{table or level}"] = statement('level "table"', f"SELECT * FROM ({ISSUES}) x WHERE {which}", {})
    out["proc_display"] = statement("name text", _union([_displayed(n, body) for n, body in PROCESS.items()]), {})
    ranks = {"bronze_counts": 1, "silver_counts": 2, "gold_counts": 3}
    out["diag_layer_counts"] = statement(
        "layer table_name row_count:i layer_rank",
        _union([f"SELECT *, {rank} AS layer_rank FROM ({DIAG_SQL[n][1]}) x" for n, rank in ranks.items()]), GOLD_REL,
    )
    lacking = {t: ", ".join(c for c in REQUIRED[t] if c in LEFT_OUT.get(t, ())) for t in TABLE_NAMES}
    out["diag_column_report"] = statement(
        '"table" row_count:i missing',
        _union([f"SELECT '{t}' AS \"table\", COUNT(*) AS row_count, '{lacking[t]}' AS missing FROM {t}" for t in TABLE_NAMES]), {},
    )
    out["etl_load_stamps"] = statement(
        '"table" row_count:i stamped:i one_load',
        _union([
            f"SELECT '{t}' AS \"table\", COUNT(*) AS row_count, COUNT(*) AS stamped, TRUE AS one_load FROM {t}" for t in TABLE_NAMES
        ]), {},
    )
    out["kpi_data_freshness"] = statement(
        "domain label last_loaded_at row_count:i source_file cadence_hours age_hours:d status", "SELECT * FROM fresh",
        FRESH_REL,
    )
    return out
