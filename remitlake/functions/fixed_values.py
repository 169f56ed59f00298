"""Texts, codes and limits that results must carry exactly."""

# Scrubbing fail reasons, their labels and the guidance shown with them.
FAIL_REASON_LABELS = {
    "MISSING_AUTH": "Missing Prior Authorization",
    "ELIGIBILITY_FAIL": "Patient Eligibility Not Verified",
    "CODING_ERROR": "Invalid CPT/ICD-10 Combination",
    "DUPLICATE_SUBMISSION": "Duplicate Claim Submission",
    "TIMELY_FILING": "Outside Timely Filing Window",
    "MISSING_INFO": "Missing Required Information",
}
FAIL_REASON_GUIDANCE = {
    "MISSING_AUTH": "Automate auth check at scheduling; obtain PA before service date.",
    "ELIGIBILITY_FAIL": "Verify eligibility 24-48h before appointment via real-time check.",
    "CODING_ERROR": "Add CPT/ICD-10 edit rules to charge capture; schedule coder training.",
    "DUPLICATE_SUBMISSION": "Enable duplicate detection in clearinghouse scrubber settings.",
    "TIMELY_FILING": "Set automated alerts when claims approach payer filing deadlines.",
    "MISSING_INFO": "Implement front-desk registration checklists with required-field validation.",
}

# Expected hours between loads, and display labels, per data domain.
CADENCE_HOURS = {
    "claims": 4,
    "payments": 6,
    "encounters": 4,
    "charges": 4,
    "denials": 12,
    "adjustments": 8,
    "payers": 24,
    "patients": 24,
    "providers": 24,
    "operating_costs": 720,
}
DEFAULT_CADENCE_HOURS = 24
DOMAIN_LABELS = {
    "claims": "Claims",
    "payments": "Payments / ERA",
    "encounters": "Encounters / ADT",
    "charges": "Charges / CDM",
    "denials": "Denials",
    "adjustments": "Adjustments",
    "payers": "Payer Master",
    "patients": "Patient Demographics",
    "providers": "Provider Roster",
    "operating_costs": "Operating Costs",
}

# Alert limits (strict comparison) as (KPI, column, direction, limit).
ALERT_LIMITS = [
    ("Days in A/R", "days_in_ar", ">", 35.0),
    ("Net Collection Rate", "net_collection_rate", "<", 95.0),
    ("Clean Claim Rate", "clean_claim_rate", "<", 90.0),
    ("Denial Rate", "denial_rate", ">", 10.0),
    ("First-Pass Rate", "first_pass_rate", "<", 85.0),
    ("Payment Accuracy", "payment_accuracy", "<", 95.0),
    ("Bad Debt Rate", "bad_debt_rate", ">", 3.0),
]

# Scorecard cut points as (KPI, column, better side, good beyond, warn beyond).
SCORECARD_CUTS = [
    ("Days in A/R", "days_in_ar", "<", 35.0, 50.0),
    ("Net Collection Rate", "net_collection_rate", ">", 95.0, 90.0),
    ("Clean Claim Rate", "clean_claim_rate", ">", 90.0, 80.0),
    ("Denial Rate", "denial_rate", "<", 10.0, 15.0),
    ("Gross Collection Rate", "gross_collection_rate", ">", 70.0, 55.0),
    ("First-Pass Rate", "first_pass_rate", ">", 85.0, 75.0),
    ("Payment Accuracy", "payment_accuracy", ">", 95.0, 90.0),
    ("Bad Debt Rate", "bad_debt_rate", "<", 3.0, 5.0),
]

# The further cut points of single pages, same layout.
EXTRA_CUTS = [
    ("A/R in 0-60 Days", "ar_under_60_pct", ">", 70.0, 50.0),
    ("Cost to Collect", "cost_to_collect", "<", 8.0, 12.0),
    ("Appeal Success Rate", "appeal_success_rate", ">", 50.0, 30.0),
    ("Avg Collection Rate", "avg_collection_rate", ">", 95.0, 85.0),
    ("Avg Denial Rate", "avg_denial_rate", "<", 10.0, 15.0),
    ("Avg Clean Claim Rate", "avg_clean_claim_rate", ">", 90.0, 80.0),
    ("Underpayment Rate", "underpayment_rate", "<", 1.0, 3.0),
    ("Patient Responsibility Rate", "patient_resp_rate", "<", 20.0, 35.0),
]

# Benchmarks a projection is compared with.
PROJECTION_BENCHMARKS = {"days_in_ar": 35.0, "denial_rate": 10.0}

# Scenario constants (cost of one reworked claim, share of dirty claims denied).
REWORK_COST = 25.0
DENIALS_PER_DIRTY_CLAIM = 0.4
DAR_BENCHMARK = 35.0

# Allowed claim states.
CLAIM_STATUSES = ("Paid", "Partially Paid", "Denied", "Pending", "Appealed")

# Steps of the revenue waterfall (label, kind).
WATERFALL_STEPS = [
    ("Total Charges", "absolute"),
    ("Adjustments", "relative"),
    ("Denials (Lost)", "relative"),
    ("Collections", "relative"),
    ("Net Revenue", "total"),
]

# Export sets and their sheets.
EXPORT_SHEETS = {
    "collections_revenue": ("Financial Summary", "Filtered Claims", "Filtered Payments", "Filtered Adjustments"),
    "claims_denials": ("Denial Reasons", "Filtered Claims", "Filtered Denials"),
    "claim_scrubbing_breakdown": ("Scrubbing Breakdown",),
    "ar_aging_cashflow": ("AR Aging Summary", "Cash Flow"),
    "payer_analysis": ("Payer Comparison", "Payer Mix", "Denial by Payer"),
    "department_performance": ("Department Summary", "Encounter Type Mix"),
    "provider_performance": ("Provider Scorecard",),
    "cpt_code_analysis": ("CPT Code Analysis",),
    "underpayment_analysis": ("Underpayment by Payer",),
    "patient_responsibility": ("Patient Responsibility",),
    "payer_drilldown": ("Claims", "Denials"),
    "dept_drilldown": ("Encounters & Claims", "Denials"),
}
