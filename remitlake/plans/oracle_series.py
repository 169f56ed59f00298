"""Expected results of series analytics, scenarios, semantic metrics and typing as plain SQL."""

from __future__ import annotations

from remitlake.plans.oracle_kpis import CORE, DENIED, month, relations, statement
from remitlake.plans.oracle_views import TABLE_NAMES, _union
from remitlake.plans.params import AS_OF_TIME, EVERYTHING

SERIES = ("collections", "days_in_ar", "denial_rate")
SERIES_REL = {
    "points": """SELECT 'collections' AS series, period, payments AS value FROM dar
        UNION ALL SELECT 'days_in_ar', period, days_in_ar FROM dar
        UNION ALL SELECT 'denial_rate', period, denial_rate FROM dr""",
    "bounds": """SELECT series, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, COUNT(value) AS n
        FROM points GROUP BY 1""",
    "flagged": """SELECT p.*, CASE WHEN n >= 4 THEN q1 - 1.5 * (q3 - q1) END AS lower_bound,
        CASE WHEN n >= 4 THEN q3 + 1.5 * (q3 - q1) END AS upper_bound,
        n >= 4 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS is_anomaly
        FROM points p JOIN bounds b ON p.series = b.series""",
    "placed": """SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY series ORDER BY period) - 1 AS DOUBLE) AS x,
        COUNT(*) OVER (PARTITION BY series) AS length FROM flagged""",
    "line": """SELECT series, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept FROM placed
        WHERE NOT is_anomaly GROUP BY 1 HAVING COUNT(*) >= 4""",
    "fit": """SELECT p.series, period, value, intercept + slope * x AS fitted, is_anomaly, x, length, slope, intercept
        FROM placed p JOIN line l ON p.series = l.series""",
    "band": """SELECT series, stddev_pop(value - fitted) AS resid_std FROM fit WHERE NOT is_anomaly GROUP BY 1""",
    "ends": """SELECT f.series, period AS last_period, value AS last_value, length, slope, intercept, resid_std
        FROM fit f JOIN band b ON f.series = b.series WHERE x = length - 1""",
    "ahead": """SELECT series, CAST(s.step AS INT) AS step,
        strftime(CAST(last_period || '-01' AS DATE) + to_months(CAST(s.step AS INT)), '%Y-%m') AS period,
        intercept + slope * (length + s.step - 1) AS projected, resid_std, last_value
        FROM ends CROSS JOIN (SELECT UNNEST([1, 2, 3]) AS step) s""",
    "month_means": """SELECT series, CAST(split_part(period, '-', 2) AS INT) AS month, AVG(value) AS mean_value
        FROM points GROUP BY 1, 2""",
    "season": """SELECT m.series, LEAST(var_pop(mean_value) / ANY_VALUE(v), 1.0) AS strength FROM month_means m
        JOIN (SELECT series, var_pop(value) AS v FROM points GROUP BY 1) t ON m.series = t.series GROUP BY 1""",
    "kept": """SELECT series, value, CAST(ROW_NUMBER() OVER (PARTITION BY series ORDER BY period) - 1 AS DOUBLE) AS x,
        COUNT(*) OVER (PARTITION BY series) AS n FROM flagged WHERE NOT is_anomaly""",
    "halves": "SELECT *, x < GREATEST(FLOOR(n * 0.75), 4) AS train FROM kept WHERE n >= 6",
    "train_line": """SELECT series, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept FROM halves
        WHERE train GROUP BY 1""",
    "errors": """SELECT h.*, value - (intercept + slope * x) AS error,
        value - AVG(value) OVER (PARTITION BY h.series, train) AS centred FROM halves h
        JOIN train_line l ON h.series = l.series""",
    "quality": """SELECT series,
        COUNT(*) FILTER (train) AS train_points,
        1 - SUM(error * error) FILTER (train) / SUM(centred * centred) FILTER (train) AS r2_train,
        AVG(ABS(error)) FILTER (train) AS mae_train,
        AVG(ABS(error / value)) FILTER (train AND value <> 0) * 100 AS mape_train,
        COUNT(*) FILTER (NOT train) AS test_points,
        1 - SUM(error * error) FILTER (NOT train) / SUM(centred * centred) FILTER (NOT train) AS r2_test,
        AVG(ABS(error)) FILTER (NOT train) AS mae_test,
        AVG(ABS(error / value)) FILTER (NOT train AND value <> 0) * 100 AS mape_test FROM errors GROUP BY 1""",
    "core": CORE,
    "base": """SELECT days_in_ar, denial_rate, clean_claim_rate, claims / months AS claims_per_month,
        charges / (months * 30) AS daily_charges, payments / GREATEST(claims - denied, 1) AS payment_per_claim
        FROM core, (SELECT SUM(payments) AS payments, SUM(charges) AS charges FROM m),
        (SELECT CAST(SUM(total_claims) AS DOUBLE) AS claims, CAST(SUM(denied_claims) AS DOUBLE) AS denied,
        CAST(GREATEST(COUNT(*), 1) AS DOUBLE) AS months FROM dr)""",
}
_SCENARIO = """SELECT dp AS denial_points, dd AS dar_days, cp AS clean_points,
    claims_per_month * dp / 100 AS recovered_claims_month,
    claims_per_month * dp / 100 * payment_per_claim AS recovery_month,
    claims_per_month * dp / 100 * payment_per_claim * 12 AS recovery_year,
    dd * daily_charges AS cash_unlocked, GREATEST(days_in_ar - dd, 0) AS projected_dar,
    GREATEST(GREATEST(days_in_ar - 35, 0) - dd, 0) AS remaining_gap,
    claims_per_month * cp / 100 * 25 AS rework_saved_month, claims_per_month * cp / 100 * 25 * 12 AS rework_saved_year,
    cp * 0.4 AS implied_denial_drop,
    claims_per_month * dp / 100 * payment_per_claim * 12 + dd * daily_charges + claims_per_month * cp / 100 * 25 * 12
    AS total_opportunity FROM """
_SCENARIO_COLUMNS = (
    "denial_points:d dar_days:d clean_points:d recovered_claims_month:d recovery_month:d recovery_year:d cash_unlocked:d "
    "projected_dar:d remaining_gap:d rework_saved_month:d rework_saved_year:d implied_denial_drop:d total_opportunity:d"
)


def _of(series: str, table: str) -> str:
    return f"SELECT * FROM {table} WHERE series = '{series}'"


SERIES_SQL = {
    **{f"anomalies_{s}": ("series period value:d lower_bound:d upper_bound:d is_anomaly", _of(s, "flagged")) for s in SERIES},
    **{f"fit_{s}": ("series period value:d fitted:d is_anomaly", _of(s, "fit")) for s in SERIES},
    **{
        f"forecast_{s}": (
            "series step period projected:d lower:d upper:d",
            f"SELECT series, step, period, projected, projected - resid_std AS lower, projected + resid_std AS upper "
            f"FROM ahead WHERE series = '{s}'",
        )
        for s in SERIES
    },
    "anomaly_list": ("series period value:d", "SELECT * FROM flagged WHERE is_anomaly"),
    "seasonality": (
        "series strength:d level",
        """SELECT series, strength, CASE WHEN strength >= 0.5 THEN 'strong' WHEN strength >= 0.3 THEN 'moderate'
        ELSE 'none' END AS level FROM season""",
    ),
    "seasonal_pattern": ("series month mean_value:d", "SELECT * FROM month_means"),
    "forecast_summary": (
        "series projected_total:d last_projected:d last_period last_actual:d direction benchmark:d against_benchmark",
        """SELECT t.*, CASE WHEN last_projected > last_actual THEN 'upward' ELSE 'downward' END AS direction,
        b.benchmark, CASE WHEN last_projected > b.benchmark THEN 'above' WHEN b.benchmark IS NOT NULL THEN 'within' END
        AS against_benchmark FROM (SELECT series, SUM(projected) AS projected_total, arg_max(projected, step) AS last_projected,
        arg_max(period, step) AS last_period, MAX(last_value) AS last_actual FROM ahead GROUP BY 1) t
        LEFT JOIN (SELECT 'days_in_ar' AS series, 35.0 AS benchmark UNION ALL SELECT 'denial_rate', 10.0) b
        ON t.series = b.series""",
    ),
    "model_stats": (
        "series train_points:i r2_train:d mae_train:d mape_train:d test_points:i r2_test:d mae_test:d mape_test:d fit",
        """SELECT *, CASE WHEN r2_test >= 0.8 THEN 'strong' WHEN r2_test >= 0.5 THEN 'moderate' ELSE 'weak' END AS fit
        FROM quality""",
    ),
    "what_if": (
        _SCENARIO_COLUMNS,
        _SCENARIO + """(SELECT *, LEAST(2.0, denial_rate) AS dp, 5.0 AS dd,
        LEAST(3.0, GREATEST(100.0 - clean_claim_rate, 0)) AS cp FROM base)""",
    ),
    "what_if_grid": (
        _SCENARIO_COLUMNS,
        _SCENARIO + """(SELECT * FROM base, (SELECT UNNEST([1.0, 2.0]) AS dp), (SELECT UNNEST([5.0, 10.0]) AS dd),
        (SELECT UNNEST([3.0]) AS cp))""",
    ),
}

# ------------------------------------------------------------------ semantic metrics

CLAIM_METRICS = f"""COUNT(DISTINCT c.claim_id) AS total_claims, SUM(c.total_charge_amount) AS total_charges,
    SUM(CASE WHEN c.{DENIED} THEN 1 ELSE 0 END) AS denied_count, SUM(c.is_clean_claim) AS clean_count,
    SUM(CASE WHEN c.{DENIED} THEN 1 ELSE 0 END) * 100.0 / NULLIF(COUNT(c.claim_id), 0) AS denial_rate,
    SUM(c.is_clean_claim) * 100.0 / NULLIF(COUNT(c.claim_id), 0) AS clean_claim_rate,
    AVG(datediff('day', TRY_CAST(c.date_of_service AS DATE), TRY_CAST(c.submission_date AS DATE))) AS avg_charge_lag"""
CLAIM_COLUMNS = (
    "total_claims:i total_charges:d denied_count:i clean_count:i denial_rate:d clean_claim_rate:d avg_charge_lag:d"
)
PAYMENT_METRICS = """SUM(p.payment_amount) AS total_payments, SUM(p.allowed_amount) AS total_allowed,
    SUM(p.is_accurate_payment) * 100.0 / NULLIF(COUNT(*), 0) AS payment_accuracy_rate,
    SUM(CASE WHEN p.payment_amount < p.allowed_amount THEN p.allowed_amount - p.payment_amount ELSE 0 END) AS total_underpaid,
    SUM(CASE WHEN p.payment_amount < p.allowed_amount THEN 1 ELSE 0 END) * 100.0 / NULLIF(COUNT(*), 0) AS underpayment_rate"""
PAYMENT_COLUMNS = "total_payments:d total_allowed:d payment_accuracy_rate:d total_underpaid:d underpayment_rate:d"
DENIAL_METRICS = """COUNT(*) AS total_denials, SUM(d.denied_amount) AS total_denied, SUM(d.recovered_amount) AS total_recovered,
    SUM(CASE WHEN d.appeal_status = 'Won' THEN 1 ELSE 0 END) * 100.0
    / NULLIF(SUM(CASE WHEN d.appeal_status != 'Not Appealed' THEN 1 ELSE 0 END), 0) AS appeal_success_rate"""
DENIAL_COLUMNS = "total_denials:i total_denied:d total_recovered:d appeal_success_rate:d"
CHARGE_METRICS = "SUM(h.charge_amount) AS total_charge_amount, SUM(h.units) AS total_units, COUNT(*) AS charge_line_count"
CHARGE_COLUMNS = "total_charge_amount:d total_units:i charge_line_count:i"
ADJ_METRICS = """SUM(a.adjustment_amount) AS total_adjustments,
    SUM(CASE WHEN a.adjustment_type_code = 'WRITEOFF' THEN a.adjustment_amount ELSE 0 END) AS bad_debt_total,
    SUM(CASE WHEN a.adjustment_type_code = 'CONTRACTUAL' THEN a.adjustment_amount ELSE 0 END) AS contractual_total"""
ADJ_COLUMNS = "total_adjustments:d bad_debt_total:d contractual_total:d"

FACT_COLUMNS = {
    "claims": "total_charge_amount:d is_clean_claim:i",
    "payments": "payment_amount:d allowed_amount:d is_accurate_payment:i",
    "denials": "denied_amount:d recovered_amount:d",
    "charges": "units:i charge_amount:d",
    "adjustments": "adjustment_amount:d",
    "operating_costs": "billing_staff_cost:d software_cost:d outsourcing_cost:d supplies_overhead:d total_rcm_cost:d",
}


def _facts(table: str) -> tuple[str, str]:
    names = [c.partition(":")[0] for c in FACT_COLUMNS[table].split()]
    return FACT_COLUMNS[table], f"SELECT {', '.join(f'SUM({n}) AS {n}' for n in names)} FROM {table}"


METRIC_SQL = {
    "claims": (CLAIM_COLUMNS, f"SELECT {CLAIM_METRICS} FROM claims c"),
    "payments": (PAYMENT_COLUMNS, f"SELECT {PAYMENT_METRICS} FROM payments p"),
    "denials": (DENIAL_COLUMNS, f"SELECT {DENIAL_METRICS} FROM denials d"),
    "charges": (CHARGE_COLUMNS, f"SELECT {CHARGE_METRICS} FROM charges h"),
    "adjustments": (ADJ_COLUMNS, f"SELECT {ADJ_METRICS} FROM adjustments a"),
    "operating_costs": ("total_rcm_cost:d", "SELECT SUM(total_rcm_cost) AS total_rcm_cost FROM operating_costs"),
    "encounters": ("total_encounters:i", "SELECT COUNT(DISTINCT encounter_id) AS total_encounters FROM encounters"),
    **{f"facts_{t}": _facts(t) for t in FACT_COLUMNS},
    "claims_to_encounters": (
        f"department {CLAIM_COLUMNS}",
        f"SELECT e.department, {CLAIM_METRICS} FROM claims c LEFT JOIN encounters e ON c.encounter_id = e.encounter_id GROUP BY 1",
    ),
    "claims_to_payers": (
        f"payer_type {CLAIM_COLUMNS}",
        f"SELECT y.payer_type, {CLAIM_METRICS} FROM claims c LEFT JOIN payers y ON c.payer_id = y.payer_id GROUP BY 1",
    ),
    "claims_to_patients": (
        f"gender {CLAIM_COLUMNS}",
        f"SELECT t.gender, {CLAIM_METRICS} FROM claims c LEFT JOIN patients t ON c.patient_id = t.patient_id GROUP BY 1",
    ),
    "payments_to_claims": (
        f"claim_status {PAYMENT_COLUMNS}",
        f"SELECT c.claim_status, {PAYMENT_METRICS} FROM payments p LEFT JOIN claims c ON p.claim_id = c.claim_id GROUP BY 1",
    ),
    "payments_to_payers": (
        f"payer_name {PAYMENT_COLUMNS}",
        f"SELECT y.payer_name, {PAYMENT_METRICS} FROM payments p LEFT JOIN payers y ON p.payer_id = y.payer_id GROUP BY 1",
    ),
    "payments_to_claim_payers": (
        f"payer_name {PAYMENT_COLUMNS}",
        f"""SELECT y.payer_name, {PAYMENT_METRICS} FROM payments p LEFT JOIN claims c ON p.claim_id = c.claim_id
        LEFT JOIN payers y ON c.payer_id = y.payer_id GROUP BY 1""",
    ),
    "denials_to_claims": (
        f"year {DENIAL_COLUMNS}",
        f"""SELECT strftime(TRY_CAST(c.date_of_service AS DATE), '%Y') AS year, {DENIAL_METRICS}
        FROM denials d LEFT JOIN claims c ON d.claim_id = c.claim_id GROUP BY 1""",
    ),
    "adjustments_to_claims": (
        f"claim_status {ADJ_COLUMNS}",
        f"SELECT c.claim_status, {ADJ_METRICS} FROM adjustments a LEFT JOIN claims c ON a.claim_id = c.claim_id GROUP BY 1",
    ),
    "charges_to_encounters": (
        f"encounter_type {CHARGE_COLUMNS}",
        f"""SELECT e.encounter_type, {CHARGE_METRICS} FROM charges h LEFT JOIN encounters e
        ON h.encounter_id = e.encounter_id GROUP BY 1""",
    ),
    "encounters_to_patients": (
        "gender total_encounters:i",
        """SELECT t.gender, COUNT(DISTINCT e.encounter_id) AS total_encounters FROM encounters e
        LEFT JOIN patients t ON e.patient_id = t.patient_id GROUP BY 1""",
    ),
    "encounters_to_providers": (
        "specialty total_encounters:i",
        """SELECT r.specialty, COUNT(DISTINCT e.encounter_id) AS total_encounters FROM encounters e
        LEFT JOIN providers r ON e.provider_id = r.provider_id GROUP BY 1""",
    ),
    "patients_to_payers": (
        "payer_type total_encounters:i",
        """SELECT y.payer_type, COUNT(DISTINCT e.encounter_id) AS total_encounters FROM encounters e
        LEFT JOIN patients t ON e.patient_id = t.patient_id LEFT JOIN payers y ON t.primary_payer_id = y.payer_id
        GROUP BY 1""",
    ),
    "filtered": (
        f"department submission_month {CLAIM_COLUMNS}",
        f"""SELECT e.department, {month('c.submission_date')} AS submission_month, {CLAIM_METRICS} FROM claims c
        LEFT JOIN encounters e ON c.encounter_id = e.encounter_id LEFT JOIN payers y ON c.payer_id = y.payer_id
        WHERE y.payer_type = 'Government' AND TRY_CAST(c.date_of_service AS DATE) >= DATE '1998-01-01'
        AND c.claim_status IN ('Paid', 'Denied') GROUP BY 1, 2""",
    ),
    "q_denial_rate_by_payer": (
        "payer_name denial_rate:d denied_count:i total_claims:i",
        f"""SELECT y.payer_name, {CLAIM_METRICS} FROM claims c LEFT JOIN payers y ON c.payer_id = y.payer_id GROUP BY 1""",
    ),
    "q_top_denial_reasons": (
        "denial_reason_code total_denied:d total_denials:i",
        f"""SELECT d.denial_reason_code, {DENIAL_METRICS} FROM denials d GROUP BY 1
        ORDER BY total_denied DESC, denial_reason_code LIMIT 5""",
    ),
    "q_denial_trend": (
        "period denial_rate:d",
        f"SELECT {month('c.submission_date')} AS period, {CLAIM_METRICS} FROM claims c GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
    ),
    "q_revenue_per_encounter": (
        "department total_payments:d total_encounters:i revenue_per_encounter:d",
        """SELECT e.department, total_payments, total_encounters, total_payments / total_encounters AS revenue_per_encounter
        FROM (SELECT department, COUNT(DISTINCT encounter_id) AS total_encounters FROM encounters GROUP BY 1) e
        LEFT JOIN (SELECT e.department, SUM(p.payment_amount) AS total_payments FROM payments p
        LEFT JOIN claims c ON p.claim_id = c.claim_id LEFT JOIN encounters e ON c.encounter_id = e.encounter_id GROUP BY 1) t
        ON e.department IS NOT DISTINCT FROM t.department""",
    ),
    "q_days_in_ar_by_payer": (
        "payer_name open_ar:d days_in_ar:d",
        """SELECT y.payer_name, open_ar, open_ar / (charges / days) AS days_in_ar FROM (
        SELECT payer_id, SUM(GREATEST(total_charge_amount - paid, 0)) AS open_ar, SUM(total_charge_amount) AS charges,
        GREATEST(datediff('day', MIN(CAST(date_of_service AS DATE)), MAX(CAST(date_of_service AS DATE))) + 1, 1) AS days
        FROM (SELECT c.payer_id, c.total_charge_amount, c.date_of_service, COALESCE(SUM(p.payment_amount), 0) AS paid
        FROM claims c LEFT JOIN payments p ON c.claim_id = p.claim_id GROUP BY c.claim_id, 1, 2, 3) GROUP BY 1) t
        JOIN payers y ON t.payer_id = y.payer_id""",
    ),
    "q_charges_and_payments_by_month": (
        "period total_charges:d total_payments:d",
        f"""SELECT COALESCE(c.period, p.period) AS period, total_charges, total_payments FROM
        (SELECT {month('date_of_service')} AS period, SUM(total_charge_amount) AS total_charges FROM claims GROUP BY 1) c
        FULL OUTER JOIN
        (SELECT {month('payment_date')} AS period, SUM(payment_amount) AS total_payments FROM payments GROUP BY 1) p
        ON c.period = p.period ORDER BY 1 DESC LIMIT 12""",
    ),
}

# ------------------------------------------------------------------ typing of raw text

ETL_SQL = {
    "payers": (
        "payer_id payer_name payer_type avg_reimbursement_pct:d contract_id",
        """SELECT payer_id, payer_name, payer_type, contract_id,
        CASE WHEN payer_id = '7' THEN NULL ELSE avg_reimbursement_pct END AS avg_reimbursement_pct FROM payers""",
    ),
    "patients": (
        "patient_id first_name last_name date_of_birth gender primary_payer_id member_id zip_code", "SELECT * FROM patients",
    ),
    "providers": ("provider_id provider_name npi department specialty", "SELECT * FROM providers"),
    "encounters": (
        "encounter_id patient_id provider_id date_of_service discharge_date encounter_type department",
        "SELECT * FROM encounters",
    ),
    "charges": (
        "charge_id encounter_id cpt_code cpt_description units charge_amount:d service_date post_date icd10_code",
        """SELECT charge_id, encounter_id, cpt_code, cpt_description, CASE WHEN units <> 13 THEN units END AS units,
        charge_amount, service_date, post_date, icd10_code FROM charges WHERE post_date = service_date OR units <> 50""",
    ),
    "claims": (
        "claim_id encounter_id patient_id payer_id date_of_service submission_date total_charge_amount:d claim_status "
        "is_clean_claim submission_method fail_reason",
        "SELECT * FROM claims",
    ),
    "payments": (
        "payment_id claim_id payer_id payment_amount:d allowed_amount:d payment_date payment_method is_accurate_payment",
        "SELECT * FROM payments",
    ),
    "denials": (
        "denial_id claim_id denial_reason_code denial_reason_description denial_date denied_amount:d appeal_status "
        "appeal_date recovered_amount:d",
        """SELECT denial_id, claim_id, denial_reason_code, denial_reason_description, denial_date, denied_amount,
        appeal_status, appeal_date, CASE WHEN recovered_amount = 0 THEN 0
        WHEN denial_reason_code = 'DUP' THEN NULL ELSE recovered_amount END AS recovered_amount FROM denials""",
    ),
    "adjustments": (
        "adjustment_id claim_id adjustment_type_code adjustment_type_description adjustment_amount:d adjustment_date",
        "SELECT * FROM adjustments",
    ),
    "operating_costs": (
        "period billing_staff_cost:d software_cost:d outsourcing_cost:d supplies_overhead:d total_rcm_cost:d",
        "SELECT * FROM operating_costs",
    ),
    "load_log": (
        "domain last_loaded_at row_count:i source_file",
        _union([
            f"SELECT '{t}' AS domain, '{AS_OF_TIME}' AS last_loaded_at, COUNT(*) AS row_count, '{t}.csv' AS source_file FROM {t}"
            for t in TABLE_NAMES
        ]),
    ),
}

ETL_SQL |= {f"files_{t}": ETL_SQL[t] for t in TABLE_NAMES}


def series_statements(more_digits: dict[str, int]) -> dict[str, str]:
    rel = {**relations(EVERYTHING), **SERIES_REL}
    out = {f"ts_{name}": statement(c, b, rel, 3) for name, (c, b) in SERIES_SQL.items()}
    for prefix, group in (("metric_", METRIC_SQL), ("etl_", ETL_SQL)):
        for name, (columns, body) in group.items():
            key = prefix + name
            out[key] = statement(columns, body, {}, more_digits.get(key.replace("files_", ""), 4))
    return out
