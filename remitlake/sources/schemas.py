"""The ten tables: columns, types, keys, references, required columns and sensitivity."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the raw files; the type is that of the typed layer.
TABLES: dict[str, list[tuple[str, str]]] = {
    "payers": [
        ("payer_id", "string"), ("payer_name", "string"), ("payer_type", "string"),
        ("avg_reimbursement_pct", "double"), ("contract_id", "string"),
    ],
    "patients": [
        ("patient_id", "string"), ("first_name", "string"), ("last_name", "string"), ("date_of_birth", "string"),
        ("gender", "string"), ("primary_payer_id", "string"), ("member_id", "string"), ("zip_code", "string"),
    ],
    "providers": [
        ("provider_id", "string"), ("provider_name", "string"), ("npi", "string"),
        ("department", "string"), ("specialty", "string"),
    ],
    "encounters": [
        ("encounter_id", "string"), ("patient_id", "string"), ("provider_id", "string"),
        ("date_of_service", "string"), ("discharge_date", "string"), ("encounter_type", "string"),
        ("department", "string"),
    ],
    "charges": [
        ("charge_id", "string"), ("encounter_id", "string"), ("cpt_code", "string"), ("cpt_description", "string"),
        ("units", "int"), ("charge_amount", "double"), ("service_date", "string"), ("post_date", "string"),
        ("icd10_code", "string"),
    ],
    "claims": [
        ("claim_id", "string"), ("encounter_id", "string"), ("patient_id", "string"), ("payer_id", "string"),
        ("date_of_service", "string"), ("submission_date", "string"), ("total_charge_amount", "double"),
        ("claim_status", "string"), ("is_clean_claim", "int"), ("submission_method", "string"),
        ("fail_reason", "string"),
    ],
    "payments": [
        ("payment_id", "string"), ("claim_id", "string"), ("payer_id", "string"), ("payment_amount", "double"),
        ("allowed_amount", "double"), ("payment_date", "string"), ("payment_method", "string"),
        ("is_accurate_payment", "int"),
    ],
    "denials": [
        ("denial_id", "string"), ("claim_id", "string"), ("denial_reason_code", "string"),
        ("denial_reason_description", "string"), ("denial_date", "string"), ("denied_amount", "double"),
        ("appeal_status", "string"), ("appeal_date", "string"), ("recovered_amount", "double"),
    ],
    "adjustments": [
        ("adjustment_id", "string"), ("claim_id", "string"), ("adjustment_type_code", "string"),
        ("adjustment_type_description", "string"), ("adjustment_amount", "double"), ("adjustment_date", "string"),
    ],
    "operating_costs": [
        ("period", "string"), ("billing_staff_cost", "double"), ("software_cost", "double"),
        ("outsourcing_cost", "double"), ("supplies_overhead", "double"), ("total_rcm_cost", "double"),
    ],
}

KEYS = {name: columns[0][0] for name, columns in TABLES.items()}

# Columns without which a table cannot be used.
REQUIRED = {
    "payers": ["payer_id", "payer_name", "payer_type"],
    "patients": ["patient_id", "primary_payer_id"],
    "providers": ["provider_id", "department"],
    "encounters": ["encounter_id", "patient_id", "provider_id", "date_of_service", "department", "encounter_type"],
    "charges": ["charge_id", "encounter_id", "charge_amount", "service_date", "post_date"],
    "claims": [
        "claim_id", "encounter_id", "patient_id", "payer_id", "date_of_service", "submission_date",
        "total_charge_amount", "claim_status", "is_clean_claim",
    ],
    "payments": ["payment_id", "claim_id", "payer_id", "payment_amount", "is_accurate_payment"],
    "denials": [
        "denial_id", "claim_id", "denial_reason_code", "denial_reason_description", "denied_amount",
        "appeal_status", "recovered_amount",
    ],
    "adjustments": ["adjustment_id", "claim_id", "adjustment_type_code", "adjustment_amount"],
    "operating_costs": ["period", "total_rcm_cost"],
}

# Date and flag columns the loader turns into dates and booleans.
DATE_COLUMNS = {
    "patients": ["date_of_birth"],
    "encounters": ["date_of_service", "discharge_date"],
    "charges": ["service_date", "post_date"],
    "claims": ["date_of_service", "submission_date"],
    "payments": ["payment_date"],
    "denials": ["denial_date", "appeal_date"],
    "adjustments": ["adjustment_date"],
}
FLAG_COLUMNS = {"claims": ["is_clean_claim"], "payments": ["is_accurate_payment"]}

# Tagged columns (the same in the raw and the typed layer, npi in the typed one only).
SENSITIVITY = {
    "patients": {
        "first_name": "PII", "last_name": "PII", "date_of_birth": "PII", "zip_code": "PII", "member_id": "PII",
    },
    "providers": {"npi": "public"},
}


def raw_schema(table: str) -> T.StructType:
    """All-text schema of a raw file."""
    return T.StructType([T.StructField(name, T.StringType()) for name, _ in TABLES[table]])


def typed_schema(table: str) -> T.StructType:
    """Schema of the typed layer."""
    of = {"string": T.StringType, "double": T.DoubleType, "int": T.IntegerType}
    return T.StructType([T.StructField(name, of[t]()) for name, t in TABLES[table]])


def missing_columns(table: str, present: list[str]) -> list[str]:
    have = {c.lower() for c in present}
    return [c for c in REQUIRED.get(table, []) if c not in have]
