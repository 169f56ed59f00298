"""Per-claim totals: the one sub-plan behind most measures.

Payments, denials and adjustments are summed per claim before they meet the claims. The
sum combines map-side, so a claim that owns a large share of all payments shuffles as a
few rows, and the join is one-to-one. Both sides of it are then partitioned by claim_id,
which later per-claim steps reuse.

Some measures are defined over the joined rows (a claim with n payments counts n times).
``weight`` = max(n_payments, 1) reproduces them: the sum of a claim column over the joined
rows is the sum of column x weight over the claims, and their row count is the sum of the
weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlake.functions.columns import count_when, sum_when, total
from remitlake.operators.filters import FilterParams, filtered_claims
from remitlake.sources.silver import Silver

# Balances are summed as decimals: a claim paid in full by several payments has none left.
EXACT = "decimal(28,10)"


def is_open():
    """The claim has a balance left."""
    return F.col("balance") > 0


def shortfall():
    """What was allowed but not paid, never negative."""
    allowed, paid = F.col("allowed_amount"), F.col("payment_amount")
    return F.when(allowed > paid, allowed - paid).otherwise(F.lit(0.0))


def underpaid():
    return F.col("allowed_amount") > F.col("payment_amount")


def payment_totals(payments: DataFrame) -> DataFrame:
    """Payments of a claim."""
    return payments.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_payments"),
        total("payment_amount").alias("paid"),
        F.sum(F.col("payment_amount").cast(EXACT)).alias("paid_exactly"),
        F.sum("is_accurate_payment").alias("n_accurate"),
    )


def allowed_totals(payments: DataFrame) -> DataFrame:
    """Payments of a claim that carry an allowed amount."""
    return payments.filter(F.col("allowed_amount") > 0).groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("allowed_rows"),
        F.count("payment_id").alias("payment_count"),
        F.sum("allowed_amount").alias("allowed"),
        F.sum("payment_amount").alias("allowed_paid"),
        F.sum(shortfall()).alias("short"),
        count_when(underpaid()).alias("underpaid_count"),
    )


def adjustment_totals(adjustments: DataFrame) -> DataFrame:
    """Adjustments of a claim by the two types that measures ask for."""
    code = F.col("adjustment_type_code")
    return adjustments.groupBy("claim_id").agg(
        sum_when(code == "CONTRACTUAL", F.coalesce("adjustment_amount", F.lit(0.0))).alias("contractual"),
        sum_when(code == "WRITEOFF", F.coalesce("adjustment_amount", F.lit(0.0))).alias("writeoff"),
    )


def with_payments(claims: DataFrame, payments: DataFrame) -> DataFrame:
    """Claims with n_payments, paid, balance and weight."""
    joined = claims.join(payment_totals(payments), "claim_id", "left")
    return joined.withColumns({
        "n_payments": F.coalesce("n_payments", F.lit(0)),
        "paid": F.coalesce("paid", F.lit(0.0)),
        "n_accurate": F.coalesce("n_accurate", F.lit(0)),
    }).withColumns({
        "weight": F.greatest("n_payments", F.lit(1)),
        "balance": (
            F.col("total_charge_amount").cast(EXACT) - F.coalesce("paid_exactly", F.lit(0).cast(EXACT))
        ).cast("double"),
    }).drop("paid_exactly")


def with_adjustments(claims: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Claims with contractual and writeoff totals."""
    joined = claims.join(adjustment_totals(adjustments), "claim_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("contractual", "writeoff")})


def claim_balances(silver: Silver, p: FilterParams) -> DataFrame:
    """Claims in scope with their payments."""
    return with_payments(filtered_claims(silver, p), silver.payments)
