"""The 26 revenue-cycle measures.

Each takes the typed tables and a filter set and returns a lazy DataFrame. Measures with a
headline number have a ``*_value`` (one row) computed from the months of their ``*_trend``,
so the large tables are read once. Windows without partition run over months or codes only,
that is after the aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlake.functions.columns import (
    AGING_LABELS,
    aging_bucket,
    count_when,
    days_between,
    denied_or_appealed,
    iso_date,
    lookup,
    pct,
    per,
    period,
    side_by_side,
    total,
)
from remitlake.functions.fixed_values import (
    CADENCE_HOURS,
    DEFAULT_CADENCE_HOURS,
    DOMAIN_LABELS,
    FAIL_REASON_GUIDANCE,
    FAIL_REASON_LABELS,
)
from remitlake.operators.filters import FilterParams, filtered_claims
from remitlake.operators.ledger import (
    allowed_totals,
    claim_balances,
    is_open,
    payment_totals,
    shortfall,
    with_adjustments,
    with_payments,
)
from remitlake.sources.silver import Silver


def _trailing():
    """This month's row and the two before it; the unknown month sorts last."""
    return Window.orderBy(F.col("period").asc_nulls_last()).rowsBetween(-2, 0)


def _months_back() -> Column:
    return F.row_number().over(Window.orderBy(F.col("period").desc_nulls_first()))


def _by_month(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("period").asc_nulls_last())


def _headline(part: str, whole: str, name: str, digits: int = 2) -> Column:
    return F.round(pct(F.sum(part), F.sum(whole)), digits).alias(name)


# ------------------------------------------------------------------ collections and A/R

def monthly_ledger(silver: Silver, p: FilterParams) -> DataFrame:
    """Charges, payments and positive balances per service month."""
    return claim_balances(silver, p).groupBy(period("date_of_service").alias("period")).agg(
        F.sum("total_charge_amount").alias("charges"),
        _known_sum("paid").alias("payments"),
        total(F.when(is_open(), F.col("balance"))).alias("outstanding"),
    )


def _known_sum(c: str) -> Column:
    """Month total that is 0 in the group without a month."""
    return F.coalesce(F.sum(F.when(iso_date("date_of_service").isNotNull(), F.col(c))), F.lit(0.0))


def days_in_ar_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """Rolling net A/R of three rows over their mean daily charges."""
    net = F.sum(F.col("charges") - F.col("payments")).over(_trailing())
    daily = F.sum("charges").over(_trailing()) / 90
    months = monthly_ledger(silver, p).select("period", "charges", "payments").withColumns({
        "ar_balance": F.greatest(net, F.lit(0.0)), "daily": daily,
    })
    return _by_month(months.withColumn("days_in_ar", per(F.col("ar_balance"), F.col("daily"))).drop("daily"))


def _days_in_ar(open_amount: Column, recent_charges: Column) -> Column:
    return F.round(per(F.coalesce(open_amount, F.lit(0.0)), recent_charges / 90), 1)


def days_in_ar_value(silver: Silver, p: FilterParams) -> DataFrame:
    """Sum of positive claim balances over the mean daily charges of the last three months."""
    months = monthly_ledger(silver, p).withColumn("back", _months_back())
    recent = F.sum(F.when(F.col("back") <= 3, F.col("charges")))
    return months.agg(_days_in_ar(F.sum("outstanding"), recent).alias("days_in_ar"))


def net_collection_rate_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """Payments over charges less contractual adjustments, per service month."""
    claims = with_adjustments(claim_balances(silver, p), silver.adjustments)
    months = claims.groupBy(period("date_of_service").alias("period")).agg(
        F.sum("total_charge_amount").alias("charges"),
        _known_sum("paid").alias("payments"),
        _known_sum("contractual").alias("contractual_adj"),
    )
    collectible = F.col("charges") - F.col("contractual_adj")
    return _by_month(months.withColumn("ncr", pct(F.col("payments"), collectible)))


def net_collection_rate_value(silver: Silver, p: FilterParams) -> DataFrame:
    collectible = F.sum("charges") - F.sum("contractual_adj")
    return net_collection_rate_trend(silver, p).agg(
        F.round(pct(F.sum("payments"), collectible), 2).alias("net_collection_rate")
    )


def gross_collection_rate_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """Payments over charges per service month."""
    months = monthly_ledger(silver, p).select("period", "charges", "payments")
    return _by_month(months.withColumn("gcr", pct(F.col("payments"), F.col("charges"))))


def gross_collection_rate_value(silver: Silver, p: FilterParams) -> DataFrame:
    return gross_collection_rate_trend(silver, p).agg(_headline("payments", "charges", "gross_collection_rate"))


def _claim_share_trend(silver: Silver, p: FilterParams, count: Column, names: tuple[str, str, str]) -> DataFrame:
    whole, part, rate = names
    months = filtered_claims(silver, p).groupBy(period("submission_date").alias("period")).agg(
        F.count(F.lit(1)).alias(whole), count.alias(part)
    )
    return _by_month(months.withColumn(rate, pct(F.col(part), F.col(whole))))


def clean_claim_rate_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """Share of clean claims per submission month."""
    return _claim_share_trend(silver, p, F.sum("is_clean_claim"), ("total_claims", "clean_claims", "ccr"))


def clean_claim_rate_value(silver: Silver, p: FilterParams) -> DataFrame:
    return clean_claim_rate_trend(silver, p).agg(_headline("clean_claims", "total_claims", "clean_claim_rate"))


def denial_rate_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """Share of denied or appealed claims per submission month."""
    names = ("total_claims", "denied_claims", "denial_rate")
    return _claim_share_trend(silver, p, count_when(denied_or_appealed()), names)


def denial_rate_value(silver: Silver, p: FilterParams) -> DataFrame:
    return denial_rate_trend(silver, p).agg(_headline("denied_claims", "total_claims", "denial_rate"))


def first_pass_rate_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """Share of paid claims per submission month."""
    return _claim_share_trend(silver, p, count_when(F.col("claim_status") == "Paid"), ("total", "paid", "fpr"))


def first_pass_rate_value(silver: Silver, p: FilterParams) -> DataFrame:
    return first_pass_rate_trend(silver, p).agg(_headline("paid", "total", "first_pass_rate"))


def denial_reasons(silver: Silver, p: FilterParams) -> DataFrame:
    """Denials of claims in scope by reason."""
    claims = filtered_claims(silver, p).select("claim_id")
    reasons = silver.denials.join(claims, "claim_id").groupBy(
        "denial_reason_code", "denial_reason_description"
    ).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("denied_amount").alias("total_denied_amount"),
        total("recovered_amount").alias("total_recovered"),
    )
    rate = pct(F.col("total_recovered"), F.col("total_denied_amount"))
    return reasons.withColumn("recovery_rate", rate).orderBy(F.col("count").desc())


# ------------------------------------------------------------------ charge lag

def charge_lags(silver: Silver, p: FilterParams) -> DataFrame:
    """Posting lag of every charge whose encounter has a claim in scope."""
    encounters = filtered_claims(silver, p).select("encounter_id")
    return (
        silver.charges.filter(F.col("post_date").isNotNull() & F.col("service_date").isNotNull())
        .join(encounters, "encounter_id", "left_semi")
        .select(period("service_date").alias("period"), days_between("service_date", "post_date").alias("lag_days"))
    )


def charge_lag_value(silver: Silver, p: FilterParams) -> DataFrame:
    mean = F.coalesce(F.avg("lag_days"), F.lit(0.0))
    return charge_lags(silver, p).agg(F.round(mean, 1).alias("charge_lag_days"))


def charge_lag_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """Mean lag per service month; charges without a month are in the value only."""
    lags = charge_lags(silver, p).filter(F.col("period").isNotNull())
    return _by_month(lags.groupBy("period").agg(F.avg("lag_days").alias("lag_days")))


def charge_lag_dist(silver: Silver, p: FilterParams) -> DataFrame:
    """Number of charges per lag."""
    lags = charge_lags(silver, p).filter(F.col("lag_days").isNotNull())
    return lags.groupBy("lag_days").agg(F.count(F.lit(1)).alias("count")).orderBy("lag_days")


# ------------------------------------------------------------------ cost, aging, accuracy

def _collections(silver: Silver, p: FilterParams) -> DataFrame:
    return claim_balances(silver, p).groupBy(period("date_of_service").alias("period")).agg(
        F.sum("paid").alias("collections")
    )


def cost_to_collect_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """Operating cost of a month over its collections."""
    costs = silver.operating_costs.select("period", F.col("total_rcm_cost").alias("rcm_cost"))
    months = _collections(silver, p).join(costs, "period", "left").select(
        "period", "collections", F.coalesce("rcm_cost", F.lit(0.0)).alias("rcm_cost")
    )
    return _by_month(months.withColumn("cost_to_collect_pct", pct(F.col("rcm_cost"), F.col("collections"))))


def cost_to_collect_value(silver: Silver, p: FilterParams) -> DataFrame:
    """All operating costs, whatever the date range, over the collections in scope."""
    both = side_by_side(
        _collections(silver, p).agg(total("collections").alias("collected"), F.count(F.lit(1)).alias("months")),
        silver.operating_costs.agg(total("total_rcm_cost").alias("cost")),
    )
    return both.select(F.round(pct(F.col("cost"), F.col("collected")), 2).alias("cost_to_collect"))


def ar_aging(silver: Silver, p: FilterParams) -> DataFrame:
    """Positive claim balances by age at the end of the date range, always five rows."""
    sent = F.coalesce("submission_date", "date_of_service")
    age = F.datediff(F.lit(p.end_date).try_cast("date"), iso_date(sent))
    open_claims = claim_balances(silver, p).filter(is_open()).withColumn("bucket", aging_bucket(age))
    wide = open_claims.agg(*[
        agg
        for i, label in enumerate(AGING_LABELS)
        for agg in (
            count_when(F.col("bucket") == label).alias(f"n{i}"),
            total(F.when(F.col("bucket") == label, F.col("balance"))).alias(f"a{i}"),
        )
    ])
    rows = wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(label).alias("aging_bucket"), F.col(f"n{i}").alias("claim_count"), F.col(f"a{i}").alias("total_ar")
        )
        for i, label in enumerate(AGING_LABELS)
    ])))
    everything = F.sum("total_ar").over(Window.partitionBy())
    return rows.withColumn("pct_of_total", pct(F.col("total_ar"), everything))


def ar_aging_total(silver: Silver, p: FilterParams) -> DataFrame:
    return ar_aging(silver, p).agg(F.sum("total_ar").alias("total_ar"))


def payment_accuracy(silver: Silver, p: FilterParams) -> DataFrame:
    """Share of accurate payments."""
    paid = filtered_claims(silver, p).select("claim_id").join(payment_totals(silver.payments), "claim_id")
    rate = pct(F.coalesce(F.sum("n_accurate"), F.lit(0)), F.sum("n_payments"))
    return paid.agg(F.round(rate, 2).alias("payment_accuracy"))


def bad_debt_rate(silver: Silver, p: FilterParams) -> DataFrame:
    """Write-offs over charges."""
    claims = with_adjustments(filtered_claims(silver, p), silver.adjustments)
    sums = claims.agg(total("writeoff").alias("bad_debt"), total("total_charge_amount").alias("total_charges"))
    rate = F.round(pct(F.col("bad_debt"), F.col("total_charges")), 2)
    return sums.select(rate.alias("bad_debt_rate"), "bad_debt", "total_charges")


def appeal_success_rate(silver: Silver, p: FilterParams) -> DataFrame:
    """Won appeals over those won, lost or in progress."""
    appeals = silver.denials.filter(F.col("appeal_status").isin("Won", "Lost", "In Progress"))
    per_claim = appeals.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("appealed"), count_when(F.col("appeal_status") == "Won").alias("won")
    )
    sums = filtered_claims(silver, p).select("claim_id").join(per_claim, "claim_id").agg(
        F.coalesce(F.sum("appealed"), F.lit(0)).alias("total_appealed"), F.coalesce(F.sum("won"), F.lit(0)).alias("won")
    )
    rate = F.round(pct(F.col("won"), F.col("total_appealed")), 2)
    return sums.select(rate.alias("appeal_success_rate"), "total_appealed", "won")


def avg_reimbursement_value(silver: Silver, p: FilterParams) -> DataFrame:
    """Mean payment total of a claim."""
    mean = F.coalesce(F.avg("paid"), F.lit(0.0))
    return claim_balances(silver, p).agg(F.round(mean, 2).alias("avg_reimbursement"))


def avg_reimbursement_trend(silver: Silver, p: FilterParams) -> DataFrame:
    months = claim_balances(silver, p).groupBy(period("date_of_service").alias("period"))
    return _by_month(months.agg(F.avg("paid").alias("payment_amount")).filter(F.col("period").isNotNull()))


# ------------------------------------------------------------------ payer, department, provider, procedure

def payer_mix(silver: Silver, p: FilterParams) -> DataFrame:
    """Claims, charges (once per payment) and payments by payer.

    Claims are summed per payer before the payer names are looked up, so that a dominant
    payer is a handful of partial sums and not a hot join key.
    """
    sums = claim_balances(silver, p).groupBy("payer_id").agg(
        F.countDistinct("claim_id").alias("claim_count"),
        F.sum(F.col("total_charge_amount") * F.col("weight")).alias("total_charges"),
        F.sum("paid").alias("total_payments"),
    )
    named = sums.join(silver.payers.select("payer_id", "payer_name", "payer_type"), "payer_id").select(
        "payer_id", "payer_name", "payer_type", "claim_count", "total_charges", "total_payments"
    )
    rate = pct(F.col("total_payments"), F.col("total_charges"))
    return named.withColumn("collection_rate", rate).orderBy(F.col("total_payments").desc())


def denial_rate_by_payer(silver: Silver, p: FilterParams) -> DataFrame:
    sums = filtered_claims(silver, p).groupBy("payer_id").agg(
        F.count(F.lit(1)).alias("total_claims"), count_when(denied_or_appealed()).alias("denied")
    )
    named = sums.join(silver.payers.select("payer_id", "payer_name"), "payer_id").select(
        "payer_id", "payer_name", "total_claims", "denied"
    )
    rate = pct(F.col("denied"), F.col("total_claims"))
    return named.withColumn("denial_rate", rate).orderBy(F.col("denial_rate").desc())


def department_performance(silver: Silver, p: FilterParams) -> DataFrame:
    """Encounters with claims, charges (once per payment) and payments by encounter department.

    Claims are summed per encounter before the encounters are joined. The sums combine
    map-side, so an encounter with very many claims is no hot key of that join.
    """
    per_encounter = claim_balances(silver, p).groupBy("encounter_id").agg(
        F.sum(F.col("total_charge_amount") * F.col("weight")).alias("charges"), F.sum("paid").alias("paid")
    )
    joined = silver.encounters.select("encounter_id", "department").join(per_encounter, "encounter_id")
    sums = joined.groupBy("department").agg(
        F.countDistinct("encounter_id").alias("encounter_count"),
        total("charges").alias("total_charges"),
        F.sum("paid").alias("total_payments"),
    )
    return sums.withColumns({
        "collection_rate": pct(F.col("total_payments"), F.col("total_charges")),
        "avg_payment_per_encounter": per(F.col("total_payments"), F.col("encounter_count")),
    }).orderBy(F.col("total_payments").desc())


def provider_performance(silver: Silver, p: FilterParams) -> DataFrame:
    """Volumes, amounts and rates per provider; charges are not multiplied by payments here.

    Two distinct counts in one aggregation would copy every row. The distinct claims are
    counted per encounter instead (the rows are partitioned by claim already, so that takes
    no extra shuffle) and add up, since a claim belongs to one encounter.
    """
    per_encounter = claim_balances(silver, p).groupBy("encounter_id").agg(
        F.countDistinct("claim_id").alias("claims"),
        F.sum("total_charge_amount").alias("charges"),
        F.sum("paid").alias("paid"),
        F.sum("is_clean_claim").alias("clean"),
        count_when(denied_or_appealed()).alias("denied"),
    )
    sums = silver.encounters.select("encounter_id", "provider_id").join(per_encounter, "encounter_id").groupBy(
        "provider_id"
    ).agg(
        F.countDistinct("encounter_id").alias("encounter_count"),
        F.sum("claims").alias("claim_count"),
        F.sum("charges").alias("total_charges"),
        F.sum("paid").alias("total_payments"),
        F.sum("clean").alias("clean_claims"),
        F.sum("denied").alias("denied_claims"),
    )
    named = silver.providers.select("provider_id", "provider_name", "specialty", "department").join(sums, "provider_id")
    return named.withColumns({
        "collection_rate": pct(F.col("total_payments"), F.col("total_charges")),
        "denial_rate": pct(F.col("denied_claims"), F.col("claim_count")),
        "clean_claim_rate": pct(F.col("clean_claims"), F.col("claim_count")),
        "avg_payment_per_encounter": per(F.col("total_payments"), F.col("encounter_count")),
    }).orderBy(F.col("total_payments").desc())


def cpt_analysis(silver: Silver, p: FilterParams) -> DataFrame:
    """Charge lines, units and amounts per procedure, and the claims of the encounters using it.

    Claims are counted per encounter and lines are summed per encounter and procedure before
    the two meet, so an encounter with many lines and many claims never multiplies out. A
    claim belongs to one encounter, so the per-encounter counts add up.
    """
    status = F.col("claim_status")
    per_encounter = (
        filtered_claims(silver, p)
        .groupBy("encounter_id", "claim_id")
        .agg((_any(status == "Denied") + _any(status == "Appealed")).alias("denied"))
        .groupBy("encounter_id")
        .agg(F.count("claim_id").alias("claims"), F.sum("denied").alias("denied"))
    )
    lines = silver.charges.groupBy("encounter_id", "cpt_code", "cpt_description").agg(
        F.count("charge_id").alias("lines"), F.sum("units").alias("units"), F.sum("charge_amount").alias("amount")
    )
    # A code listed with two descriptions in one encounter still counts its claims once.
    of_code = Window.partitionBy("encounter_id", "cpt_code").orderBy("cpt_description")
    used = lines.join(per_encounter, "encounter_id").withColumn("once", F.row_number().over(of_code) == 1)
    by_description = used.groupBy("cpt_code", "cpt_description").agg(
        F.sum("lines").alias("charge_count"),
        F.sum("units").alias("total_units"),
        F.sum("amount").alias("total_charges"),
        F.sum(F.when(F.col("once"), F.col("claims")).otherwise(0)).alias("claims"),
        F.sum(F.when(F.col("once"), F.col("denied")).otherwise(0)).alias("denied"),
    )
    same_code = Window.partitionBy("cpt_code")
    known = F.col("cpt_code").isNotNull()
    return by_description.select(
        "cpt_code", "cpt_description", "charge_count", "total_units", "total_charges",
        F.when(known, F.sum("claims").over(same_code)).otherwise(0).alias("claim_count"),
        F.when(known, F.sum("denied").over(same_code)).otherwise(0).alias("denied_claims"),
    ).withColumns({
        "avg_charge_per_unit": per(F.col("total_charges"), F.col("total_units")),
        "denial_rate": pct(F.col("denied_claims"), F.col("claim_count")),
    }).orderBy(F.col("total_charges").desc())


def _any(condition: Column) -> Column:
    """1 if any row of the group matches, else 0."""
    return F.max(F.when(condition, 1).otherwise(0))


# ------------------------------------------------------------------ underpayment

def underpayment_analysis(silver: Silver, p: FilterParams) -> DataFrame:
    """Allowed, paid and short amounts per payer; the rate is in dollars."""
    claims = filtered_claims(silver, p).select("claim_id", "payer_id").join(allowed_totals(silver.payments), "claim_id")
    sums = claims.groupBy("payer_id").agg(
        F.sum("payment_count").alias("payment_count"),
        F.sum("allowed").alias("total_allowed"),
        F.sum("allowed_paid").alias("total_paid"),
        F.sum("short").alias("total_underpaid"),
        F.sum("underpaid_count").alias("underpaid_count"),
    )
    named = silver.payers.select("payer_id", "payer_name", "payer_type").join(sums, "payer_id")
    rate = pct(F.col("total_underpaid"), F.col("total_allowed"))
    return named.withColumn("underpayment_rate", rate).orderBy(F.col("total_underpaid").desc())


def underpayment_total(silver: Silver, p: FilterParams) -> DataFrame:
    return underpayment_analysis(silver, p).agg(total("total_underpaid").alias("total_underpaid"))


def underpayment_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """As the analysis, per payment month."""
    claims = filtered_claims(silver, p).select("claim_id")
    paid = silver.payments.filter(F.col("allowed_amount") > 0).join(claims, "claim_id")
    months = paid.groupBy(period("payment_date").alias("period")).agg(
        F.sum("allowed_amount").alias("total_allowed"),
        F.sum("payment_amount").alias("total_paid"),
        F.sum(shortfall()).alias("total_underpaid"),
    )
    return _by_month(months.withColumn("underpayment_rate", pct(F.col("total_underpaid"), F.col("total_allowed"))))


# ------------------------------------------------------------------ scrubbing

def clean_claim_breakdown(silver: Silver, p: FilterParams) -> DataFrame:
    """Dirty claims by reason, with label and guidance."""
    dirty = filtered_claims(silver, p).filter((F.col("is_clean_claim") == 0) & F.col("fail_reason").isNotNull())
    sums = dirty.groupBy("fail_reason").agg(
        F.count(F.lit(1)).alias("count"), F.sum("total_charge_amount").alias("total_charges")
    )
    reason = F.col("fail_reason")
    return sums.select(
        "fail_reason",
        lookup(reason, FAIL_REASON_LABELS, reason).alias("label"),
        "count",
        "total_charges",
        pct(F.col("count"), F.sum("count").over(Window.partitionBy())).alias("pct_of_dirty"),
        lookup(reason, FAIL_REASON_GUIDANCE, F.lit("")).alias("guidance"),
    ).orderBy(F.col("count").desc())


# ------------------------------------------------------------------ patient responsibility

def patient_resp_by_payer(silver: Silver, p: FilterParams) -> DataFrame:
    """What patients owe per payer name and type; the mean is per payment."""
    claims = filtered_claims(silver, p).select("claim_id", "payer_id").join(allowed_totals(silver.payments), "claim_id")
    measures = ["payment_count", "short", "allowed", "allowed_rows"]
    per_payer = claims.groupBy("payer_id").agg(*[F.sum(c).alias(c) for c in measures])
    sums = silver.payers.select("payer_id", "payer_name", "payer_type").join(per_payer, "payer_id").groupBy(
        "payer_name", "payer_type"
    ).agg(*[F.sum(c).alias(c) for c in measures])
    return sums.select(
        "payer_name",
        "payer_type",
        "payment_count",
        F.col("short").alias("total_patient_resp"),
        (F.col("short") / F.col("allowed_rows")).alias("avg_patient_resp"),
        F.col("allowed").alias("total_allowed"),
        pct(F.col("short"), F.col("allowed")).alias("pct_of_allowed"),
    ).orderBy(F.col("total_patient_resp").desc())


def patient_resp_by_dept(silver: Silver, p: FilterParams) -> DataFrame:
    """The same per encounter department and type.

    The payments join comes last, so that the rows are partitioned by claim when the
    distinct claims are counted.
    """
    claims = filtered_claims(silver, p).select("claim_id", "encounter_id").join(
        silver.encounters.select("encounter_id", "department", "encounter_type"), "encounter_id"
    )
    joined = claims.join(allowed_totals(silver.payments), "claim_id")
    return joined.groupBy("department", "encounter_type").agg(
        F.countDistinct("claim_id").alias("claim_count"),
        F.sum("short").alias("total_patient_resp"),
        (F.sum("short") / F.sum("allowed_rows")).alias("avg_patient_resp"),
    ).orderBy(F.col("total_patient_resp").desc())


def patient_resp_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """The same per service month."""
    claims = filtered_claims(silver, p).select("claim_id", "date_of_service")
    months = claims.join(allowed_totals(silver.payments), "claim_id").groupBy(
        period("date_of_service").alias("period")
    ).agg(
        F.sum("short").alias("total_patient_resp"),
        F.sum("allowed").alias("total_allowed"),
        F.countDistinct("claim_id").alias("claim_count"),
    )
    rate = pct(F.col("total_patient_resp"), F.col("total_allowed"))
    return _by_month(months.withColumn("patient_resp_rate", rate))


# ------------------------------------------------------------------ freshness

def data_freshness(load_log: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Age of every domain's last load against its cadence; an unknown age is fresh."""
    now = (as_of if as_of is not None else F.current_timestamp()).cast("timestamp_ntz")
    loaded = F.col("last_loaded_at").try_cast("timestamp_ntz")
    domain = F.col("domain")
    rows = load_log.withColumns({
        "label": lookup(domain, DOMAIN_LABELS, domain),
        "cadence_hours": lookup(domain, CADENCE_HOURS, F.lit(DEFAULT_CADENCE_HOURS)),
        "age_hours": F.timestamp_diff("MICROSECOND", loaded, now) / 3.6e9,
    })
    age, cadence = F.col("age_hours"), F.col("cadence_hours")
    status = F.when(age > cadence * 3, "critical").when(age > cadence, "stale").otherwise("fresh")
    return rows.select(
        "domain", "label", "last_loaded_at", "row_count", "source_file", "cadence_hours", "age_hours",
        status.alias("status"),
    ).orderBy("domain")


# ------------------------------------------------------------------ headline numbers together

def core_kpis(silver: Silver, p: FilterParams) -> DataFrame:
    """The eight headline numbers of claims in one row, from one pass over the claims.

    Claims meet their payment and adjustment totals once; the monthly sums of that pass
    hold everything the single measures need.
    """
    claims = with_adjustments(with_payments(filtered_claims(silver, p), silver.payments), silver.adjustments)
    months = claims.groupBy(period("date_of_service").alias("period")).agg(
        F.sum("total_charge_amount").alias("charges"),
        _known_sum("paid").alias("payments"),
        total(F.when(is_open(), F.col("balance"))).alias("outstanding"),
        _known_sum("contractual").alias("contractual"),
        F.sum("writeoff").alias("writeoff"),
        F.sum("n_payments").alias("n_payments"),
        F.sum("n_accurate").alias("n_accurate"),
        F.count(F.lit(1)).alias("claims"),
        F.sum("is_clean_claim").alias("clean"),
        count_when(denied_or_appealed()).alias("denied"),
        count_when(F.col("claim_status") == "Paid").alias("paid_claims"),
    ).withColumn("back", _months_back())

    def rate(part: str, whole: Column) -> Column:
        return F.round(pct(F.sum(part), whole), 2)

    recent = F.sum(F.when(F.col("back") <= 3, F.col("charges")))
    n = F.sum("claims")
    return months.agg(
        _days_in_ar(F.sum("outstanding"), recent).alias("days_in_ar"),
        rate("payments", F.sum("charges") - F.sum("contractual")).alias("net_collection_rate"),
        rate("payments", F.sum("charges")).alias("gross_collection_rate"),
        rate("clean", n).alias("clean_claim_rate"),
        rate("denied", n).alias("denial_rate"),
        rate("paid_claims", n).alias("first_pass_rate"),
        rate("n_accurate", F.sum("n_payments")).alias("payment_accuracy"),
        rate("writeoff", F.sum("charges")).alias("bad_debt_rate"),
        F.coalesce(F.sum("writeoff"), F.lit(0.0)).alias("bad_debt"),
    )
