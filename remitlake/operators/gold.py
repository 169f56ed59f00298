"""The five aggregate views of the typed layer.

They are defined over fanned-out joins (claim x payments, charge x claim x payments) and
report fractions, not percentages; a denial here is status 'Denied' only. The joins are
never multiplied out: per-claim and per-encounter totals with weights give the same sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlake.functions.columns import aging_bucket, count_when, iso_date, period, ratio, total
from remitlake.operators.ledger import with_payments
from remitlake.sources.silver import Silver


def _weighted(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("weight")).otherwise(0))


def monthly_kpis(silver: Silver) -> DataFrame:
    """Claims, charges, payments and rates per service month."""
    claims = with_payments(silver.claims, silver.payments)
    months = claims.groupBy(period("date_of_service").alias("period")).agg(
        F.countDistinct("claim_id").alias("total_claims"),
        F.sum(F.col("total_charge_amount") * F.col("weight")).alias("total_charges"),
        F.sum("paid").alias("total_payments"),
        ratio(_weighted(F.col("is_clean_claim") == 1), F.sum("weight")).alias("clean_claim_rate"),
        ratio(_weighted(F.col("claim_status") == "Denied"), F.sum("weight")).alias("denial_rate"),
    )
    gcr = ratio(F.col("total_payments"), F.col("total_charges"))
    return months.withColumn("gross_collection_rate", gcr).orderBy(F.col("period").asc_nulls_last())


def payer_performance(silver: Silver) -> DataFrame:
    """Every payer; those without claims have no rates."""
    claims = with_payments(silver.claims, silver.payments)
    sums = claims.groupBy("payer_id").agg(
        F.countDistinct("claim_id").alias("total_claims"),
        F.sum(F.col("total_charge_amount") * F.col("weight")).alias("total_charges"),
        F.sum("paid").alias("total_payments"),
        ratio(_weighted(F.col("claim_status") == "Denied"), F.sum("weight")).alias("denial_rate"),
    )
    payers = silver.payers.select("payer_id", "payer_name", "payer_type").join(sums, "payer_id", "left")
    return payers.withColumns({
        "total_claims": F.coalesce("total_claims", F.lit(0)),
        "total_payments": F.coalesce("total_payments", F.lit(0.0)),
        "gross_collection_rate": ratio(F.coalesce("total_payments", F.lit(0.0)), F.col("total_charges")),
    }).orderBy(F.col("total_payments").desc())


def department_performance(silver: Silver) -> DataFrame:
    """Encounters, line charges and payments per encounter department.

    In the joined rows of an encounter every line stands once per claim payment (once per
    claim without payments, once if there is no claim) and every payment once per line.
    """
    claims = with_payments(silver.claims, silver.payments).groupBy("encounter_id").agg(
        F.sum("weight").alias("copies"), F.sum("paid").alias("paid")
    )
    lines = silver.charges.groupBy("encounter_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("charge_amount").alias("charges")
    )
    encounters = silver.encounters.select("encounter_id", "department").join(claims, "encounter_id", "left").join(
        lines, "encounter_id", "left"
    )
    sums = encounters.groupBy("department").agg(
        F.countDistinct("encounter_id").alias("total_encounters"),
        total(F.col("charges") * F.coalesce("copies", F.lit(1))).alias("total_charges"),
        total(F.col("paid") * F.coalesce("lines", F.lit(1))).alias("total_payments"),
    )
    per_encounter = ratio(F.col("total_payments"), F.col("total_encounters"))
    return sums.withColumn("revenue_per_encounter", per_encounter).orderBy(F.col("total_payments").desc())


def ar_aging(silver: Silver, as_of: str | None = None) -> DataFrame:
    """Claims that are not paid, by age of the service at ``as_of`` (today if left out)."""
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    unpaid = silver.claims.filter(F.col("claim_status") != "Paid")
    age = F.datediff(today, iso_date("date_of_service"))
    return (
        with_payments(unpaid, silver.payments)
        .groupBy(aging_bucket(age, " days").alias("aging_bucket"))
        .agg(
            F.sum("weight").alias("claim_count"),
            F.sum(F.col("total_charge_amount") * F.col("weight")).alias("total_billed"),
            F.sum("paid").alias("total_collected"),
        )
        .withColumn("outstanding_balance", F.col("total_billed") - F.col("total_collected"))
    )


def denial_analysis(silver: Silver) -> DataFrame:
    """Denials by reason; appeal success is won over all denials."""
    won = count_when(F.col("appeal_status") == "Won")
    return silver.denials.groupBy("denial_reason_code", "denial_reason_description").agg(
        F.count("denial_id").alias("denial_count"),
        F.sum("denied_amount").alias("total_denied"),
        total("recovered_amount").alias("total_recovered"),
        ratio(won, F.count("denial_id")).alias("appeal_success_rate"),
    ).orderBy(F.col("denial_count").desc())


VIEWS = {
    "monthly_kpis": monthly_kpis,
    "payer_performance": payer_performance,
    "department_performance": department_performance,
    "ar_aging": ar_aging,
    "denial_analysis": denial_analysis,
}


def load_gold(silver: Silver, as_of: str | None = None) -> dict[str, DataFrame]:
    """All five views by name, lazily."""
    return {name: view(silver, as_of) if view is ar_aging else view(silver) for name, view in VIEWS.items()}
