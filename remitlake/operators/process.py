"""Unfiltered process measures (one per step of the revenue cycle) and diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlake.functions.columns import (
    count_when,
    days_between,
    denied_or_appealed,
    iso_date,
    period,
    ratio,
    side_by_side,
    steady_round,
    total,
)
from remitlake.operators.gold import load_gold
from remitlake.operators.ledger import payment_totals, shortfall, underpaid, with_payments
from remitlake.sources.catalog import layer_rank
from remitlake.sources.schemas import missing_columns
from remitlake.sources.silver import Silver


def _share(part: Column, whole: Column) -> Column:
    return F.round(ratio(part * 100, whole), 1)


def _rows() -> Column:
    return F.count(F.lit(1))


def _of_encounters(silver: Silver) -> DataFrame:
    return silver.encounters.agg(
        _rows().alias("encounter_count"), F.countDistinct("patient_id").alias("patient_count")
    )


def _of_claims(silver: Silver) -> DataFrame:
    return silver.claims.agg(
        _rows().alias("total_claims"),
        _share(count_when(F.col("is_clean_claim") == 1), _rows()).alias("clean_claim_rate"),
        _share(count_when(F.col("claim_status") == "Paid"), _rows()).alias("first_pass_rate"),
        _share(count_when(denied_or_appealed()), _rows()).alias("denial_rate"),
    )


def _of_payments(silver: Silver) -> DataFrame:
    allowed = F.col("allowed_amount") > 0
    short = F.sum(F.when(allowed, shortfall()).otherwise(0.0))
    return silver.payments.agg(
        _share(count_when(F.col("is_accurate_payment") == 1), _rows()).alias("payment_accuracy"),
        _share(short, F.sum(F.when(allowed, F.col("allowed_amount")))).alias("patient_resp_rate"),
        _share(count_when(allowed & underpaid()), count_when(allowed)).alias("underpayment_rate"),
        F.sum("payment_amount").alias("sum_payments"),
    )


def _of_charges(silver: Silver) -> DataFrame:
    posted = F.col("service_date").isNotNull() & F.col("post_date").isNotNull()
    day = iso_date("service_date")
    return silver.charges.agg(
        F.round(F.avg(F.when(posted, days_between("service_date", "post_date"))), 1).alias("charge_lag_days"),
        F.sum("charge_amount").alias("sum_charges"),
        (F.datediff(F.max(day), F.min(day)) + 1).alias("span_days"),
    )


def _of_denials(silver: Silver) -> DataFrame:
    status = F.col("appeal_status")
    appealed = (F.trim(status) != "") & (status != "Not Appealed")
    return silver.denials.agg(
        _share(count_when(status == "Won"), count_when(appealed)).alias("appeal_success_rate")
    )


def _of_adjustments(silver: Silver) -> DataFrame:
    return silver.adjustments.agg(total("adjustment_amount").alias("sum_adjustments"))


def _gcr(silver: Silver) -> DataFrame:
    """Payments over line charges, not claim totals."""
    both = side_by_side(_of_payments(silver), _of_charges(silver))
    return both.select(_share(F.col("sum_payments"), F.col("sum_charges")).alias("gcr"))


def _days_in_ar(silver: Silver) -> DataFrame:
    """Line charges less payments and all adjustments, over mean daily line charges."""
    sums = side_by_side(_of_payments(silver), _of_charges(silver), _of_adjustments(silver))
    charges = F.col("sum_charges")
    rest = charges - F.coalesce("sum_payments", F.lit(0.0)) - F.col("sum_adjustments")
    # Without any parseable date there is no span, and no number.
    span = F.when(F.col("span_days").isNotNull(), F.greatest("span_days", F.lit(1)))
    return sums.select(F.round(ratio(rest, ratio(charges, span)), 0).alias("days_in_ar"))


# Measure -> (function that yields its one-row frame).
_SOURCE = {
    "encounter_count": _of_encounters,
    "patient_count": _of_encounters,
    "charge_lag_days": _of_charges,
    "clean_claim_rate": _of_claims,
    "total_claims": _of_claims,
    "first_pass_rate": _of_claims,
    "gcr": _gcr,
    "payment_accuracy": _of_payments,
    "denial_rate": _of_claims,
    "appeal_success_rate": _of_denials,
    "days_in_ar": _days_in_ar,
    "patient_resp_rate": _of_payments,
    "underpayment_rate": _of_payments,
}
PROCESS_KPIS = tuple(_SOURCE)


def process_kpi(silver: Silver, name: str) -> DataFrame:
    """One measure; unused aggregates and columns of its table are pruned away."""
    return _SOURCE[name](silver).select(name)


def process_kpis(silver: Silver) -> DataFrame:
    """All thirteen in one row, reading every table once."""
    wide = side_by_side(
        _of_encounters(silver), _of_claims(silver), _of_payments(silver), _of_charges(silver),
        _of_denials(silver), _of_adjustments(silver),
    )
    charges = F.col("sum_charges")
    rest = charges - F.coalesce("sum_payments", F.lit(0.0)) - F.col("sum_adjustments")
    span = F.when(F.col("span_days").isNotNull(), F.greatest("span_days", F.lit(1)))
    return wide.withColumns({
        "gcr": _share(F.col("sum_payments"), charges),
        "days_in_ar": F.round(ratio(rest, ratio(charges, span)), 0),
    }).select(*PROCESS_KPIS)


def display_text(value: Column, suffix: str = "") -> Column:
    """Number as short text: dash for none, millions with one decimal, whole numbers without."""
    end = F.lit(suffix)
    millions = F.concat(F.lit("$"), F.format_number(value / 1e6, 1), F.lit("M"), end)
    whole = F.concat(F.format_number(value, 0), end)
    return (
        F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("—"))
        .when(F.abs(value) >= 1e6, millions)
        .when((value == F.floor(value)) & (F.abs(value) < 100000), whole)
        .otherwise(F.concat(F.format_number(value, 1), end))
    )


def display_values(one_row: DataFrame, suffixes: dict[str, str] | None = None) -> DataFrame:
    """Every number of a one-row frame as short text, one row each."""
    texts = [
        F.struct(F.lit(c).alias("name"), display_text(F.col(c).cast("double"), (suffixes or {}).get(c, "")).alias("text"))
        for c in one_row.columns
    ]
    return one_row.select(F.inline(F.array(*texts)))


# ------------------------------------------------------------------ diagnostics

def row_counts(layer: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table of a layer, as one job."""
    counts = [
        f.agg(_rows().alias("row_count")).select(
            F.lit(layer).alias("layer"), F.lit(name.upper()).alias("table_name"), "row_count"
        )
        for name, f in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("layer", "table_name")


def column_report(frames: dict[str, DataFrame]) -> DataFrame:
    """Per table its rows and the required columns that it lacks, comma-separated; empty if it can be used."""
    found = [
        f.agg(_rows().alias("row_count")).select(
            F.lit(t).alias("table"), "row_count", F.lit(", ".join(missing_columns(t, f.columns))).alias("missing")
        )
        for t, f in frames.items()
    ]
    return reduce(DataFrame.unionByName, found).orderBy("table")


def load_stamps(raw: dict[str, DataFrame]) -> DataFrame:
    """Per raw table its rows, those with a load time, and whether they all have the same."""
    found = [
        f.agg(
            _rows().alias("row_count"), F.count("_loaded_at").alias("stamped"),
            (F.min("_loaded_at") == F.max("_loaded_at")).alias("one_load"),
        ).select(F.lit(t).alias("table"), "row_count", "stamped", "one_load")
        for t, f in raw.items()
    ]
    return reduce(DataFrame.unionByName, found).orderBy("table")


def layer_counts(layers: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Rows of every table of every layer, the layers in the order in which data passes them."""
    counts = reduce(DataFrame.unionByName, [row_counts(layer, frames) for layer, frames in layers.items()])
    ranked = counts.withColumn("layer_rank", layer_rank("layer"))
    return ranked.orderBy("layer_rank", "table_name")


def gold_row_counts(silver: Silver, as_of: str | None = None) -> DataFrame:
    return row_counts("GOLD", load_gold(silver, as_of))


def payment_profile(silver: Silver) -> DataFrame:
    amount = "payment_amount"
    return silver.payments.agg(
        _rows().alias("total_payments"),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        F.round(F.avg(amount), 2).alias("avg_amount"),
        steady_round(F.sum(amount), 2).alias("total_amount"),
    )


def claims_with_payments(silver: Silver) -> DataFrame:
    """Distinct claims, and those with and without a payment."""
    claims = silver.claims.select("claim_id").distinct()
    paid = payment_totals(silver.payments).select("claim_id", F.lit(1).alias("paid"))
    counts = claims.join(paid, "claim_id", "left").agg(
        F.count("claim_id").alias("total_claims"), F.count("paid").alias("claims_with_payments")
    )
    return counts.withColumn("claims_without_payments", F.col("total_claims") - F.col("claims_with_payments"))


def orphan_payments(silver: Silver) -> DataFrame:
    counts = silver.payments.groupBy("claim_id").agg(_rows().alias("n"))
    orphans = counts.join(silver.claims.select("claim_id"), "claim_id", "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_payments"))


def gcr_spot_check(silver: Silver, months: int = 6) -> DataFrame:
    """Collection rate over the joined rows, first months."""
    claims = with_payments(silver.claims, silver.payments)
    sums = claims.groupBy(period("date_of_service").alias("period")).agg(
        F.sum(F.col("total_charge_amount") * F.col("weight")).alias("c"), F.sum("paid").alias("p")
    )
    first = sums.orderBy(F.col("period").asc_nulls_last()).limit(months)
    return first.select(
        "period",
        steady_round(F.col("c"), 2).alias("charges"),
        steady_round(F.col("p"), 2).alias("payments"),
        F.round(ratio(F.col("p") * 100, F.col("c")), 1).alias("gcr_pct"),
    )


def _parsed_dates(silver: Silver) -> DataFrame:
    raw = F.col("date_of_service")
    return silver.claims.select(
        "claim_id", raw.alias("raw_value"), iso_date(raw).alias("parsed_date"), period(raw).alias("period")
    )


def date_parse_sample(silver: Silver, n: int = 5) -> DataFrame:
    """A few service dates with what they parse to (lowest claim ids, so that runs agree)."""
    return _parsed_dates(silver).orderBy("claim_id").limit(n).drop("claim_id")


def unparseable_dates(silver: Silver) -> DataFrame:
    bad = F.col("raw_value").isNotNull() & F.col("parsed_date").isNull()
    return _parsed_dates(silver).agg(_rows().alias("claims"), count_when(bad).alias("unparseable"))


def status_distribution(silver: Silver) -> DataFrame:
    """Claims per status with their share in percent."""
    counts = silver.claims.groupBy("claim_status").agg(_rows().alias("cnt"))
    share = ratio(F.col("cnt") * 100, F.sum("cnt").over(Window.partitionBy()))
    return counts.withColumn("pct", F.round(share, 1)).orderBy(F.col("cnt").desc())
