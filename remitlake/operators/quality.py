"""Data-quality checks, described as data and compiled to one pass per table.

Row rules (emptiness, ranges, allowed values, NULL keys) of a table are aggregates of the
same scan. References are checked together: every table is read once and names the keys it
owns and the keys it refers to, and one grouping by key counts the references to keys that
nobody owns. The counts combine map-side, so a key that a third of the rows share is a few
rows by then.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlake.functions.columns import count_when, total
from remitlake.functions.fixed_values import CLAIM_STATUSES
from remitlake.sources.schemas import KEYS
from remitlake.sources.silver import Silver

RESULT = ["check", "table", "failures", "passed", "message"]


@dataclass(frozen=True)
class RowRule:
    """Failing rows of one table; ``not_empty`` fails as a whole."""

    name: str
    table: str
    kind: str
    column: str = ""
    values: tuple = ()
    message: str = ""

    def failures(self) -> Column:
        if self.kind == "not_empty":
            return F.when(F.count(F.lit(1)) > 0, F.lit(0)).otherwise(F.lit(1)).cast("long")
        c = F.col(self.column)
        bad = {
            "not_negative": lambda: c < 0,
            "in_values": lambda: ~c.isin(*self.values),
            "not_null": lambda: c.isNull(),
        }[self.kind]()
        return count_when(bad)


@dataclass(frozen=True)
class Reference:
    """Every value of ``table.column`` exists as key of ``parent`` (NULL does not)."""

    name: str
    table: str
    column: str
    parent: str
    message: str = ""
    exempt: tuple = ()

    def counted(self) -> Column:
        """Whether a row is checked: not if it holds an exempt value."""
        c = F.col(self.column)
        return c.isNull() | ~c.isin(*self.exempt) if self.exempt else F.lit(True)


# Check names (also shown as the failing "table") and the messages of failed checks.
_NOT_EMPTY_TEXT = {
    "payers": "payers", "patients": "patients", "providers": "providers", "encounters": "encounters",
    "charges": "charges", "claims": "claims", "payments": "payments", "denials": "denials",
    "adjustments": "adjustments", "operating_costs": "operating costs",
}
ROW_RULES = [
    RowRule(f"{t}_not_empty", t, "not_empty", message=f"Silver {text} table must have at least one row.")
    for t, text in _NOT_EMPTY_TEXT.items()
] + [
    RowRule("no_negative_charges", "charges", "not_negative", "charge_amount",
            message="Charge amounts must be non-negative."),
    RowRule("no_negative_payments", "payments", "not_negative", "payment_amount",
            message="Payment amounts must be non-negative."),
    RowRule("no_negative_denied_amounts", "denials", "not_negative", "denied_amount",
            message="Denied amounts must be non-negative."),
    RowRule("claim_status_values", "claims", "in_values", "claim_status", CLAIM_STATUSES,
            message="Claim status must be one of the allowed values."),
    RowRule("clean_claim_boolean", "claims", "in_values", "is_clean_claim", (0, 1),
            message="is_clean_claim must be 0 or 1."),
    RowRule("payment_accuracy_boolean", "payments", "in_values", "is_accurate_payment", (0, 1),
            message="is_accurate_payment must be 0 or 1."),
]
REFERENCES = [
    Reference("claims_have_valid_payers", "claims", "payer_id", "payers", "Every claim must reference a valid payer."),
    Reference("claims_have_valid_encounters", "claims", "encounter_id", "encounters",
              "Every claim must reference a valid encounter."),
    Reference("claims_have_valid_patients", "claims", "patient_id", "patients",
              "Every claim must reference a valid patient."),
    Reference("payments_have_valid_claims", "payments", "claim_id", "claims",
              "Every payment must reference a valid claim."),
    Reference("denials_have_valid_claims", "denials", "claim_id", "claims",
              "Every denial must reference a valid claim."),
    Reference("adjustments_have_valid_claims", "adjustments", "claim_id", "claims",
              "Every adjustment must reference a valid claim."),
    Reference("encounters_have_valid_patients", "encounters", "patient_id", "patients",
              "Every encounter must reference a valid patient."),
    Reference("encounters_have_valid_providers", "encounters", "provider_id", "providers",
              "Every encounter must reference a valid provider."),
]
KEY_TABLES = ("payers", "patients", "providers", "encounters", "claims", "charges", "payments", "denials", "adjustments")
KEY_RULES = [RowRule(f"key:{t}", t, "not_null", KEYS[t]) for t in KEY_TABLES]
KEY_CHECK = ("no_null_primary_keys", "Primary key columns must not be NULL.")

# Declared references that the standard checks leave out; a patient may pay for themselves.
EXTRA_REFERENCES = [
    Reference("patients_have_valid_payers", "patients", "primary_payer_id", "payers",
              "Every patient must reference a valid payer."),
    Reference("payments_have_valid_payers", "payments", "payer_id", "payers",
              "Every payment must reference a valid payer.", exempt=("PATIENT",)),
    Reference("charges_have_valid_encounters", "charges", "encounter_id", "encounters",
              "Every charge must reference a valid encounter."),
]

CHECKS = [r.name for r in ROW_RULES[:10]] + [r.name for r in REFERENCES] + [r.name for r in ROW_RULES[10:]] + [KEY_CHECK[0]]


def _finish(counts: DataFrame) -> DataFrame:
    return counts.withColumn("passed", F.col("failures") == 0).select(*RESULT)


def _row_results(silver: Silver, table: str, rules: list[RowRule]) -> DataFrame:
    """All rules of one table from one scan, one row each."""
    return _as_rows(getattr(silver, table).agg(*[r.failures().alias(f"f{i}") for i, r in enumerate(rules)]), rules)


def _as_rows(wide: DataFrame, rules: list[RowRule] | list[Reference]) -> DataFrame:
    """The columns ``f0``, ``f1``, ... as one row per rule."""
    rows = F.array(*[
        F.struct(
            F.lit(r.name).alias("check"), F.lit(r.table).alias("table"), F.col(f"f{i}").alias("failures"),
            F.lit(r.message).alias("message"),
        )
        for i, r in enumerate(rules)
    ])
    return wide.select(F.inline(rows))


def _orphans(silver: Silver, references: list[Reference]) -> DataFrame:
    """One row whose columns ``f0``, ``f1``, ... count the rows that refer to no key of the parent."""
    parents = list(dict.fromkeys(r.parent for r in references))
    slots = {r: [x for x in references if x.parent == r.parent].index(r) for r in references}
    roles: dict[str, list[Column]] = {}

    def entry(condition: Column, column: str, parent: str, slot: int) -> Column:
        role = F.struct(F.lit(parents.index(parent)).alias("parent"), F.col(column).alias("key"), F.lit(slot).alias("slot"))
        return F.when(condition, role)

    for parent in parents:
        roles.setdefault(parent, []).append(entry(F.col(KEYS[parent]).isNotNull(), KEYS[parent], parent, -1))
    for r in references:
        roles.setdefault(r.table, []).append(entry(r.counted(), r.column, r.parent, slots[r]))
    rows = reduce(DataFrame.unionByName, [
        getattr(silver, table).select(F.inline(F.array_compact(F.array(*entries)))) for table, entries in roles.items()
    ])
    width = max(slots.values()) + 1
    keys = rows.groupBy("parent", "key").agg(
        F.bool_or(F.col("slot") == -1).alias("owned"), *[count_when(F.col("slot") == i).alias(f"n{i}") for i in range(width)]
    )
    return keys.filter(~F.col("owned")).agg(*[
        total(F.when(F.col("parent") == parents.index(r.parent), F.col(f"n{slots[r]}"))).cast("long").alias(f"f{i}")
        for i, r in enumerate(references)
    ])


def _reference_results(silver: Silver, references: list[Reference]) -> DataFrame:
    return _as_rows(_orphans(silver, references), references)


def _key_results(rows: DataFrame) -> DataFrame:
    """Fold the per-table key rules into the one check they belong to."""
    is_key = F.startswith(F.col("check"), F.lit("key:"))
    name = F.when(is_key, F.lit(KEY_CHECK[0])).otherwise(F.col("check"))
    table = F.when(is_key, F.lit("all")).otherwise(F.col("table"))
    text = F.when(is_key, F.lit(KEY_CHECK[1])).otherwise(F.col("message"))
    return rows.groupBy(name.alias("check"), table.alias("table"), text.alias("message")).agg(
        F.sum("failures").alias("failures")
    )


def run_check(silver: Silver, name: str) -> DataFrame:
    """One check: check, table, failures, passed, message."""
    if name == KEY_CHECK[0]:
        rows = [_row_results(silver, r.table, [r]) for r in KEY_RULES]
        return _finish(_key_results(reduce(DataFrame.unionByName, rows)))
    for r in REFERENCES + EXTRA_REFERENCES:
        if r.name == name:
            return _finish(_reference_results(silver, [r]))
    rule = next(r for r in ROW_RULES if r.name == name)
    return _finish(_row_results(silver, rule.table, [rule]))


def run_all(silver: Silver, extra: bool = False) -> DataFrame:
    """All 25 checks (and the further references if asked for), one scan per table for the row rules, one for the references."""
    by_table: dict[str, list[RowRule]] = {}
    for r in ROW_RULES + KEY_RULES:
        by_table.setdefault(r.table, []).append(r)
    rows = reduce(DataFrame.unionByName, [_row_results(silver, t, rules) for t, rules in by_table.items()])
    references = REFERENCES + (EXTRA_REFERENCES if extra else [])
    return _finish(_key_results(rows).unionByName(_reference_results(silver, references)))


def issues(silver: Silver) -> DataFrame:
    """Failed checks as (level, table, message).

    A check that cannot be planned (say, a column is missing) is reported as a warning
    and does not stop the others.
    """
    try:
        failed = run_all(silver).filter(~F.col("passed"))
        return failed.select(F.lit("error").alias("level"), F.col("check").alias("table"), "message")
    except AnalysisException:
        return reduce(DataFrame.unionByName, [_issue(silver, name) for name in CHECKS])


def _issue(silver: Silver, name: str) -> DataFrame:
    try:
        failed = run_check(silver, name).filter(~F.col("passed"))
        return failed.select(F.lit("error").alias("level"), F.col("check").alias("table"), "message")
    except AnalysisException as e:
        text = f"Check error: {e.getCondition() or e}"
        return silver.claims.sparkSession.range(1).select(
            F.lit("warning").alias("level"), F.lit(f"validate_{name}").alias("table"), F.lit(text).alias("message")
        )


def issue_rollup(found: DataFrame) -> DataFrame:
    """Issues per level."""
    return found.groupBy("level").agg(F.count(F.lit(1)).alias("count"))


def issue_filter(found: DataFrame, level: str | None = None, table: str | None = None) -> DataFrame:
    if level:
        found = found.filter(F.col("level") == level)
    return found.filter(F.col("table") == table) if table else found
