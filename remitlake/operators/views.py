"""Report views composed from the measures: alerts, scorecards, summaries, top lists, drill-downs.

``k`` stands for the measures; frames that start from filtered rows use :func:`cascade`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlake.functions.columns import (
    count_when,
    denied_or_appealed,
    grade,
    iso_date,
    pct,
    per,
    period,
    ratio,
    rounded,
    side_by_side,
    steady_round,
    to_rows,
    total,
)
from remitlake.functions.fixed_values import ALERT_LIMITS, EXPORT_SHEETS, EXTRA_CUTS, SCORECARD_CUTS, WATERFALL_STEPS
from remitlake.operators import kpis as k
from remitlake.operators.filters import FilterParams, cascade, filtered_claims
from remitlake.operators.ledger import EXACT, shortfall, with_payments
from remitlake.sources.silver import Silver

HIGH_DENIAL = 15


def _rows() -> Column:
    return F.count(F.lit(1))


def _known(df: DataFrame, *columns: str) -> DataFrame:
    """Grouping as the report does it: rows without a group value are left out."""
    return df.dropna(subset=list(columns))


# ------------------------------------------------------------------ alerts and scorecards

def alerts_from(values: DataFrame) -> DataFrame:
    """Breached limits among the columns of a one-row frame."""
    rows = [
        F.struct(
            F.lit(kpi).alias("kpi"), F.col(column).cast("double").alias("value"),
            F.lit(side).alias("direction"), F.lit(limit).alias("threshold"),
        )
        for kpi, column, side, limit in ALERT_LIMITS
        if column in values.columns
    ]
    table = values.select(F.inline(F.array(*rows)))
    above = (F.col("direction") == ">") & (F.col("value") > F.col("threshold"))
    below = (F.col("direction") == "<") & (F.col("value") < F.col("threshold"))
    return table.filter(above | below)


def kpi_alerts(silver: Silver, p: FilterParams) -> DataFrame:
    return alerts_from(k.core_kpis(silver, p))


def scorecard_from(values: DataFrame, cuts: list[tuple] | None = None) -> DataFrame:
    """good / warn / bad for every known column of a one-row frame."""
    rows = []
    for kpi, column, better, good, warn in cuts or SCORECARD_CUTS + EXTRA_CUTS:
        if column not in values.columns:
            continue
        v = F.col(column).cast("double")
        status = grade(v, v < good, v < warn) if better == "<" else grade(v, v > good, v > warn)
        rows.append(F.struct(F.lit(kpi).alias("kpi"), v.alias("value"), status.alias("status")))
    return values.select(F.inline(F.array(*rows)))


def kpi_scorecard(silver: Silver, p: FilterParams) -> DataFrame:
    return scorecard_from(k.core_kpis(silver, p), SCORECARD_CUTS)


def page_scorecards(silver: Silver, p: FilterParams) -> DataFrame:
    """The graded numbers of the single pages, from one pass: payments and denials are summed per claim together, claims
    per encounter and payer, those per provider, and the providers' sums hold what every number needs."""
    return scorecard_from(_page_numbers(silver, p), EXTRA_CUTS)


def _claim_events(silver: Silver) -> DataFrame:
    """Payment and appeal sums per claim, from one grouping."""
    paid = silver.payments.select("claim_id", "payment_amount", "allowed_amount")
    appeals = silver.denials.select("claim_id", "appeal_status")
    allowed = F.col("allowed_amount") > 0
    return paid.unionByName(appeals, allowMissingColumns=True).groupBy("claim_id").agg(
        total("payment_amount").alias("paid"),
        F.sum(F.col("payment_amount").cast(EXACT)).alias("paid_exactly"),
        total(F.when(allowed, F.col("allowed_amount"))).alias("allowed"),
        total(F.when(allowed, shortfall())).alias("short"),
        count_when(F.col("appeal_status").isin("Won", "Lost", "In Progress")).alias("appealed"),
        count_when(F.col("appeal_status") == "Won").alias("won"),
    )


def _page_numbers(silver: Silver, p: FilterParams) -> DataFrame:
    claims = filtered_claims(silver, p).join(_claim_events(silver), "claim_id", "left")
    owed = F.col("total_charge_amount").cast(EXACT) - F.coalesce("paid_exactly", F.lit(0).cast(EXACT))
    age = F.datediff(F.lit(p.end_date).try_cast("date"), iso_date(F.coalesce("submission_date", "date_of_service")))
    claims = claims.withColumn("open", F.when(owed > 0, owed.cast("double")).otherwise(0.0))
    per_encounter = claims.groupBy("encounter_id", "payer_id").agg(
        F.count("claim_id").alias("claims"), F.sum("total_charge_amount").alias("charges"), total("paid").alias("paid"),
        F.sum("is_clean_claim").alias("clean"), count_when(denied_or_appealed()).alias("denied"),
        total("allowed").alias("allowed"), total("short").alias("short"), F.sum("appealed").alias("appealed"),
        F.sum("won").alias("won"), F.sum("open").alias("open"), F.sum(F.when(age <= 60, F.col("open")).otherwise(0.0)).alias("young"),
    )
    payers = silver.payers.select("payer_id", F.lit(True).alias("known_payer"))
    encounters = silver.encounters.select("encounter_id", "provider_id")
    sums = [F.sum(c).alias(c) for c in ("claims", "charges", "paid", "clean", "denied", "appealed", "won", "open", "young")]
    sums += [F.sum(F.when(F.col("known_payer"), F.col(c))).alias(c) for c in ("allowed", "short")]
    per_provider = per_encounter.join(encounters, "encounter_id", "left").join(payers, "payer_id", "left").groupBy("provider_id").agg(*sums)
    providers = silver.providers.select("provider_id", F.lit(True).alias("known"))
    rows = per_provider.join(providers, "provider_id", "left")

    def mean_rate(part: str, whole: str) -> Column:
        return F.avg(F.when(F.col("known"), pct(F.col(part), F.col(whole))))

    short_rate = pct(total("short"), total("allowed"))
    wide = rows.agg(
        pct(total("young"), total("open")).alias("ar_under_60_pct"),
        total("paid").alias("collected"),
        F.round(pct(F.sum("won"), F.sum("appealed")), 2).alias("appeal_success_rate"),
        mean_rate("paid", "charges").alias("avg_collection_rate"),
        mean_rate("denied", "claims").alias("avg_denial_rate"),
        mean_rate("clean", "claims").alias("avg_clean_claim_rate"),
        short_rate.alias("underpayment_rate"),
        short_rate.alias("patient_resp_rate"),
    )
    both = side_by_side(wide, silver.operating_costs.agg(total("total_rcm_cost").alias("cost")))
    return both.withColumn("cost_to_collect", F.round(pct(F.col("cost"), F.col("collected")), 2))


def high_denial_grade(outliers: Column) -> Column:
    """Status of the number of providers above the denial limit."""
    return grade(outliers, outliers == 0, outliers <= 3)


def freshness_rollup(freshness: DataFrame) -> DataFrame:
    """Domains per status, and the worst status present."""
    counts = freshness.agg(*[
        count_when(F.col("status") == s).alias(f"{s}_count") for s in ("fresh", "stale", "critical")
    ])
    worst = F.when(F.col("critical_count") > 0, "critical").when(F.col("stale_count") > 0, "stale").otherwise("fresh")
    return counts.withColumn("worst_status", worst)


# ------------------------------------------------------------------ summary page

def _merge_months(*parts: DataFrame) -> DataFrame:
    """Full outer merge of monthly frames with 0 for the missing side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    measures = [c for c in stacked.columns if c != "period"]
    return stacked.groupBy("period").agg(*[total(c).alias(c) for c in measures])


def _monthly(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Per service month; rows in scope always have a date."""
    return df.groupBy(period("date_of_service").alias("period")).agg(*aggregates)


def monthly_volume(silver: Silver, p: FilterParams) -> DataFrame:
    scope = cascade(silver, p)
    merged = _merge_months(
        _monthly(scope.encounters, F.count("encounter_id").cast("double").alias("encounters")),
        _monthly(scope.claims, F.count("claim_id").cast("double").alias("claims")),
    )
    counts = [F.col(c).cast("bigint").alias(c) for c in ("encounters", "claims")]
    return merged.select("period", *counts).orderBy("period")


def _money(silver: Silver, p: FilterParams) -> DataFrame:
    """Charges, payments, adjustments and lost denials in scope, one row.

    Every table is summed per claim and joined to the claims once; all joins share their key.
    """
    adjusted = silver.adjustments.groupBy("claim_id").agg(F.sum("adjustment_amount").alias("adjusted"))
    lost = silver.denials.groupBy("claim_id").agg((total("denied_amount") - total("recovered_amount")).alias("lost"))
    claims = with_payments(cascade(silver, p).claims, silver.payments)
    return claims.join(adjusted, "claim_id", "left").join(lost, "claim_id", "left").agg(
        total("total_charge_amount").alias("charges"),
        total("paid").alias("payments"),
        total("adjusted").alias("adjustments"),
        total("lost").alias("lost"),
    )


def revenue_waterfall(silver: Silver, p: FilterParams) -> DataFrame:
    """Steps from charges to net revenue; the collections step balances the others."""
    sums = _money(silver, p)
    charges, lost = F.col("charges"), F.col("lost")
    amounts = (charges, -F.col("adjustments"), -lost, F.col("payments") - charges + F.col("adjustments") + lost, F.lit(0.0))
    steps = [(name, kind, v) for (name, kind), v in zip(WATERFALL_STEPS, amounts, strict=True)]
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("label"), F.lit(kind).alias("measure"), v.alias("amount"))
        for i, (name, kind, v) in enumerate(steps, 1)
    ])))


def gcr_ncr_trend(silver: Silver, p: FilterParams) -> DataFrame:
    """Both collection rates on the months of the gross one.

    The two share their monthly sums, so one pass serves both and the months always agree.
    """
    months = k.net_collection_rate_trend(silver, p)
    return months.select("period", pct(F.col("payments"), F.col("charges")).alias("gcr"), "ncr").orderBy(
        F.col("period").asc_nulls_last()
    )


def financial_summary(silver: Silver, p: FilterParams) -> DataFrame:
    sums = side_by_side(_money(silver, p).drop("lost"), k.bad_debt_rate(silver, p).select("bad_debt"))
    return to_rows(sums, "metric", "amount", [
        ("Total Charges", "charges"),
        ("Total Payments", "payments"),
        ("Total Adjustments", "adjustments"),
        ("Bad Debt Write-offs", "bad_debt"),
        ("Net Revenue", "payments"),
    ])


# ------------------------------------------------------------------ claims and A/R pages

def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per value, most frequent first; NULL is not counted."""
    counts = _known(df, column).groupBy(column).agg(_rows().alias(name))
    return counts.orderBy(F.col(name).desc())


def claim_status_distribution(silver: Silver, p: FilterParams) -> DataFrame:
    return value_counts(cascade(silver, p).claims, "claim_status")


def top_denial_reasons(silver: Silver, p: FilterParams, n: int = 10) -> DataFrame:
    return k.denial_reasons(silver, p).orderBy(F.col("count").desc(), "denial_reason_code").limit(n)


def scrub_summary(silver: Silver, p: FilterParams) -> DataFrame:
    """Dirty claims, charges at risk and the most frequent reason (first code on a tie)."""
    reasons = k.clean_claim_breakdown(silver, p)
    first = F.min_by("label", F.struct((-F.col("count")).alias("n"), "fail_reason"))
    return reasons.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("dirty_claims"),
        total("total_charges").alias("charges_at_risk"),
        first.alias("top_reason"),
    )


def ar_under_60_share(silver: Silver, p: FilterParams) -> DataFrame:
    young = F.col("aging_bucket").isin("0-30", "31-60")
    share = F.sum(F.when(young, F.col("pct_of_total")).otherwise(0.0))
    return k.ar_aging(silver, p).agg(share.alias("ar_under_60_pct"))


def cash_flow(silver: Silver, p: FilterParams) -> DataFrame:
    """Charges and payments by the claim's service month, and their difference."""
    months = _monthly(
        with_payments(cascade(silver, p).claims, silver.payments),
        total("total_charge_amount").alias("charges"),
        total("paid").alias("payments"),
    )
    return months.withColumn("net_cash_flow", F.col("payments") - F.col("charges")).orderBy("period")


def charge_lag_histogram(silver: Silver, p: FilterParams, longest: int = 30) -> DataFrame:
    return k.charge_lag_dist(silver, p).filter(F.col("lag_days") <= longest)


def caption_counts(silver: Silver, p: FilterParams) -> DataFrame:
    scope = cascade(silver, p)
    return side_by_side(scope.claims.agg(_rows().alias("claims")), scope.encounters.agg(_rows().alias("encounters")))


# ------------------------------------------------------------------ payer page

def payer_comparison(silver: Silver, p: FilterParams) -> DataFrame:
    denials = k.denial_rate_by_payer(silver, p).select("payer_id", "denial_rate")
    both = k.payer_mix(silver, p).join(denials, "payer_id", "left").select(
        "payer_name", "payer_type", "claim_count", "total_charges", "total_payments", "collection_rate", "denial_rate"
    )
    return rounded(both, 2)


def payer_type_summary(silver: Silver, p: FilterParams) -> DataFrame:
    sums = _known(k.payer_mix(silver, p), "payer_type").groupBy("payer_type").agg(
        F.sum("claim_count").alias("claims"),
        F.sum("total_charges").alias("charges"),
        F.sum("total_payments").alias("payments"),
    )
    # No guard against zero charges here: the rate is then undefined, not 0.
    rate = F.round(ratio(F.col("payments"), F.col("charges")) * 100, 2)
    return sums.withColumn("collection_rate", rate)


def _totals(claims: DataFrame, payments: DataFrame) -> DataFrame:
    return with_payments(claims, payments).agg(
        _rows().alias("claims"),
        total("total_charge_amount").alias("total_charges"),
        total("paid").alias("total_payments"),
        count_when(denied_or_appealed()).alias("denied_claims"),
    )


def _denials_of(silver: Silver, claims: DataFrame) -> DataFrame:
    return silver.denials.join(claims.select("claim_id"), "claim_id", "left_semi")


def _with_paid(rows: DataFrame, payments: DataFrame) -> DataFrame:
    """Claim rows with their payment total, 0 if there is none."""
    paid = payments.groupBy("claim_id").agg(F.sum("payment_amount").alias("payment_amount"))
    return rows.join(paid, "claim_id", "left").withColumn("payment_amount", F.coalesce("payment_amount", F.lit(0.0)))


def payer_drilldown(silver: Silver, p: FilterParams, payer_id: str) -> dict[str, DataFrame]:
    """Totals, status mix, denial reasons and claim detail of one payer."""
    claims = cascade(silver, p).claims.filter(F.col("payer_id") == payer_id)
    denials = _denials_of(silver, claims)
    detail = claims.select(
        "claim_id", "date_of_service", "submission_date", "total_charge_amount", "claim_status", "is_clean_claim"
    )
    return {
        "totals": _totals(claims, silver.payments),
        "status": value_counts(claims, "claim_status"),
        "reasons": value_counts(denials, "denial_reason_description"),
        "detail": _with_paid(detail, silver.payments),
        "denials": denials,
    }


# ------------------------------------------------------------------ department page

def encounter_type_by_department(silver: Silver, p: FilterParams) -> DataFrame:
    encounters = _known(cascade(silver, p).encounters, "department", "encounter_type")
    return encounters.groupBy("department", "encounter_type").agg(_rows().alias("count"))


def department_drilldown(silver: Silver, p: FilterParams, department: str) -> dict[str, DataFrame]:
    """Totals, type mix, status mix and encounter-claim detail, from the filtered encounters."""
    scope = cascade(silver, p)
    encounters = scope.encounters.filter(F.col("department") == department)
    claims = scope.claims.join(encounters.select("encounter_id"), "encounter_id", "left_semi")
    denials = _denials_of(silver, claims)
    detail = encounters.select("encounter_id", "date_of_service", "encounter_type", "patient_id", "provider_id").join(
        scope.claims.select("encounter_id", "claim_id", "total_charge_amount", "claim_status"), "encounter_id", "left"
    )
    return {
        "totals": side_by_side(
            encounters.agg(_rows().alias("encounters")), _totals(claims, silver.payments).drop("denied_claims")
        ),
        "types": value_counts(encounters, "encounter_type"),
        "status": value_counts(claims, "claim_status"),
        "detail": _with_paid(detail, silver.payments).select(
            "encounter_id", "date_of_service", "encounter_type", "patient_id", "provider_id", "claim_id",
            "total_charge_amount", "claim_status", "payment_amount",
        ),
        "denials": denials,
    }


# ------------------------------------------------------------------ provider page

def provider_summary(silver: Silver, p: FilterParams) -> DataFrame:
    """Plain means over providers, and the number above the denial limit."""
    return k.provider_performance(silver, p).agg(
        F.avg("collection_rate").alias("avg_collection_rate"),
        F.avg("denial_rate").alias("avg_denial_rate"),
        F.avg("clean_claim_rate").alias("avg_clean_claim_rate"),
        count_when(F.col("denial_rate") > HIGH_DENIAL).alias("high_denial_providers"),
    )


def provider_ranking(silver: Silver, p: FilterParams, by: str, ascending: bool = False, n: int = 15) -> DataFrame:
    """Top or bottom providers by one measure; ties go to the lower id."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    ranked = k.provider_performance(silver, p).orderBy(order, "provider_id").limit(n)
    return ranked.select("provider_id", "provider_name", by)


def provider_scorecard(silver: Silver, p: FilterParams) -> DataFrame:
    return rounded(k.provider_performance(silver, p).select(
        "provider_name", "specialty", "department", "encounter_count", "claim_count", "total_charges",
        "total_payments", "collection_rate", "denial_rate", "clean_claim_rate",
    ), 2)


def provider_drilldown(silver: Silver, p: FilterParams, provider_id: str) -> dict[str, DataFrame]:
    """One provider against the mean of all, status mix and denial reasons.

    The provider's encounters are taken whatever their date; the claims are those in scope.
    """
    everyone = k.provider_performance(silver, p)
    means = everyone.agg(
        F.avg("collection_rate").alias("mean_collection"), F.avg("denial_rate").alias("mean_denial"),
        *[
            F.max(F.when(F.col("provider_id") == provider_id, F.col(c))).alias(c)
            for c in ("encounter_count", "claim_count", "collection_rate", "denial_rate")
        ],
    )
    own = silver.encounters.filter(F.col("provider_id") == provider_id).select("encounter_id")
    claims = cascade(silver, p).claims.join(own, "encounter_id", "left_semi")
    return {
        "totals": means.select(
            "encounter_count", "claim_count", "collection_rate",
            F.round(F.col("collection_rate") - F.col("mean_collection"), 1).alias("collection_delta"),
            "denial_rate", F.round(F.col("denial_rate") - F.col("mean_denial"), 1).alias("denial_delta"),
        ),
        "status": value_counts(claims, "claim_status"),
        "reasons": value_counts(_denials_of(silver, claims), "denial_reason_description"),
    }


# ------------------------------------------------------------------ procedure page

def cpt_summary(silver: Silver, p: FilterParams) -> DataFrame:
    """Codes, charges, codes above the denial limit and the share of the ten largest."""
    codes = k.cpt_analysis(silver, p)
    top = codes.select("total_charges").orderBy(F.col("total_charges").desc_nulls_last()).limit(10)
    sums = codes.agg(
        _rows().alias("codes"),
        total("total_charges").alias("total_charges"),
        F.sum("total_charges").alias("charges"),
        count_when(F.col("denial_rate") > HIGH_DENIAL).alias("high_denial_codes"),
    )
    both = side_by_side(sums, top.agg(F.sum("total_charges").alias("top")))
    return both.select(
        "codes", "total_charges", "high_denial_codes", pct(F.col("top"), F.col("charges")).alias("top10_pct")
    )


def _cpt_label(width: int) -> Column:
    return F.concat("cpt_code", F.lit(" — "), F.substring("cpt_description", 1, width))


def cpt_top(silver: Silver, p: FilterParams, which: str) -> DataFrame:
    """The four top lists: ``revenue``, ``denial``, ``share``, ``unit_charge``."""
    codes = k.cpt_analysis(silver, p)
    if which == "revenue":
        top = codes.orderBy(F.col("total_charges").desc(), "cpt_code").limit(15)
        return top.select(_cpt_label(30).alias("label"), "total_charges")
    if which == "denial":
        top = codes.filter(F.col("charge_count") >= 10).orderBy(F.col("denial_rate").desc(), "cpt_code").limit(15)
        return top.select(_cpt_label(25).alias("label"), "denial_rate")
    if which == "share":
        return codes.orderBy(F.col("total_charges").desc(), "cpt_code").limit(12).select("cpt_code", "total_charges")
    top = codes.orderBy(F.col("avg_charge_per_unit").desc(), "cpt_code").limit(15)
    return top.select("cpt_code", "avg_charge_per_unit")


# ------------------------------------------------------------------ underpayment and patient pages

def underpayment_summary(silver: Silver, p: FilterParams) -> DataFrame:
    sums = k.underpayment_analysis(silver, p).agg(
        total("total_underpaid").alias("recovery_opportunity"),
        total("total_allowed").alias("allowed"),
        F.coalesce(F.sum("underpaid_count"), F.lit(0)).alias("underpaid_claims"),
    )
    short = F.col("recovery_opportunity")
    return sums.select(
        "recovery_opportunity",
        pct(short, F.col("allowed")).alias("underpayment_rate"),
        "underpaid_claims",
        per(short, F.col("underpaid_claims")).alias("avg_underpayment"),
    )


def underpayment_order(silver: Silver, p: FilterParams, by: str) -> DataFrame:
    """Payers by ``total_underpaid``, ``underpayment_rate`` or ``total_allowed``, largest first."""
    payers = k.underpayment_analysis(silver, p).select("payer_id", "payer_name", by)
    return payers.orderBy(F.col(by).desc(), "payer_id")


def patient_resp_summary(silver: Silver, p: FilterParams) -> DataFrame:
    """Total, rate, mean of the payers' means, and what self-pay patients owe."""
    self_pay = F.contains(F.lower("payer_type"), F.lit("self"))
    sums = k.patient_resp_by_payer(silver, p).agg(
        total("total_patient_resp").alias("total_patient_resp"),
        total("total_allowed").alias("allowed"),
        F.avg("avg_patient_resp").alias("avg_patient_resp"),
        total(F.when(self_pay, F.col("total_patient_resp"))).alias("self_pay_exposure"),
    )
    rate = pct(F.col("total_patient_resp"), F.col("allowed"))
    return sums.select("total_patient_resp", rate.alias("patient_resp_rate"), "avg_patient_resp", "self_pay_exposure")


def patient_resp_by_payer_type(silver: Silver, p: FilterParams) -> DataFrame:
    sums = _known(k.patient_resp_by_payer(silver, p), "payer_type").groupBy("payer_type").agg(
        F.sum("total_patient_resp").alias("total_patient_resp"), F.sum("total_allowed").alias("total_allowed")
    )
    rate = F.round(ratio(F.col("total_patient_resp"), F.col("total_allowed")) * 100, 1)
    return sums.withColumn("pr_rate", rate).withColumn("pr_label", F.format_string("%.1f%%", "pr_rate"))


def patient_resp_sums(silver: Silver, p: FilterParams, by: str) -> DataFrame:
    """Per ``department`` or per ``encounter_type``."""
    return _known(k.patient_resp_by_dept(silver, p), by).groupBy(by).agg(
        F.sum("total_patient_resp").alias("total_patient_resp")
    )


# ------------------------------------------------------------------ detail tables and exports

def detail_table(silver: Silver, p: FilterParams, which: str) -> DataFrame:
    """The rounded detail tables shown and exported by the pages."""
    if which == "denial_reasons":
        return rounded(k.denial_reasons(silver, p), 2)
    if which == "scrubbing":
        columns = ["label", "count", "total_charges", "pct_of_dirty", "guidance"]
        return rounded(k.clean_claim_breakdown(silver, p).select(*columns), 2)
    if which == "department":
        money = {c: F.concat(F.lit("$"), F.format_number(steady_round(F.col(c), 2), 2)) for c in
                 ("total_charges", "total_payments", "avg_payment_per_encounter")}
        return k.department_performance(silver, p).withColumns({
            **money, "collection_rate": F.format_string("%.1f%%", "collection_rate"),
        })
    if which == "cpt":
        return rounded(k.cpt_analysis(silver, p).select(
            "cpt_code", "cpt_description", "charge_count", "total_units", "total_charges", "avg_charge_per_unit",
            "claim_count", "denied_claims", "denial_rate",
        ), 2)
    if which == "underpayment":
        return rounded(k.underpayment_analysis(silver, p).drop("payer_id"), 2)
    if which == "patient_resp":
        return rounded(k.patient_resp_by_payer(silver, p).drop("total_allowed"), 2)
    raise ValueError(which)


def aging_detail(silver: Silver, p: FilterParams) -> DataFrame:
    """The aging table with its amounts as text."""
    return k.ar_aging(silver, p).select(
        "aging_bucket", "claim_count",
        F.concat(F.lit("$"), F.format_number(steady_round(F.col("total_ar"), 2), 2)).alias("total_ar"),
        F.format_string("%.1f%%", "pct_of_total").alias("pct_of_total"),
    )


def export_sets(silver: Silver, p: FilterParams, payer_id: str | None = None, department: str | None = None) -> dict:
    """Every named export: set -> sheet -> frame. The drill-down sets need their key."""
    scope = cascade(silver, p)

    def detail(which: str) -> DataFrame:
        return detail_table(silver, p, which)

    frames = {
        "collections_revenue": (financial_summary(silver, p), scope.claims, scope.payments, scope.adjustments),
        "claims_denials": (detail("denial_reasons"), scope.claims, scope.denials),
        "claim_scrubbing_breakdown": (detail("scrubbing"),),
        "ar_aging_cashflow": (k.ar_aging(silver, p), cash_flow(silver, p)),
        "payer_analysis": (payer_comparison(silver, p), k.payer_mix(silver, p), k.denial_rate_by_payer(silver, p)),
        "department_performance": (k.department_performance(silver, p), encounter_type_by_department(silver, p)),
        "provider_performance": (provider_scorecard(silver, p),),
        "cpt_code_analysis": (detail("cpt"),),
        "underpayment_analysis": (detail("underpayment"),),
        "patient_responsibility": (detail("patient_resp"),),
    }
    if payer_id:
        one = payer_drilldown(silver, p, payer_id)
        frames["payer_drilldown", payer_id] = (one["detail"], one["denials"])
    if department:
        one = department_drilldown(silver, p, department)
        frames["dept_drilldown", department] = (one["detail"], one["denials"])
    sets = {}
    for label, sheets in frames.items():
        name, of = label if isinstance(label, tuple) else (label, None)
        sets[f"{name}_{of}" if of else name] = dict(zip(EXPORT_SHEETS[name], sheets, strict=True))
    return sets
