"""Filter sets and fixed dates that the registered queries run with."""

from remitlake.operators.filters import FilterParams

EVERYTHING = FilterParams("1995-01-01", "2001-12-31")
NARROW = FilterParams("1997-01-01", "1998-12-31", payer_id="3", encounter_type="1-URGENT")
ONE_DEPARTMENT = FilterParams("1995-01-01", "2001-12-31", department="DEPT_3")
TWO_YEARS = FilterParams("1997-01-01", "1998-12-31")

VARIANTS = {"": EVERYTHING, "_filtered": NARROW, "_dept": ONE_DEPARTMENT}

AS_OF = "2001-12-31"
AS_OF_TIME = "2001-12-31 00:00:00"
# When the raw files are loaded: all of them once, some again later.
LOADS = (
    ("2001-12-22 00:00:00", None),
    ("2001-12-30 18:00:00", ("claims", "payments", "denials", "adjustments")),
    ("2001-12-30 22:00:00", ("encounters", "payers")),
)
PAYER, DEPARTMENT, PROVIDER = "3", "DEPT_3", "3"
PAYER_NAME = "NATION_3"

# Report views: the whole range, and two years of it.
VIEW_VARIANTS = {"": EVERYTHING, "_filtered": TWO_YEARS}
# Views that take no date range.
UNFILTERED_VIEWS = (
    "freshness_rollup", "filter_date_bounds", "filter_payer_names", "filter_departments", "filter_encounter_types",
    "filter_payer_id", "search_providers",
)

# Endings of displayed measures, and required columns left out of tables for the column report.
DISPLAY_SUFFIXES = {"clean_claim_rate": "%", "first_pass_rate": "%", "gcr": "%", "denial_rate": "%", "charge_lag_days": " days"}
LEFT_OUT = {"payers": ("payer_type",), "claims": ("is_clean_claim", "payer_id"), "operating_costs": ("total_rcm_cost",)}
