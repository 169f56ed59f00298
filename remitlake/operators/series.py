"""Monthly series: outliers, seasonality, linear projection, hold-out quality, scenarios.

Input is a long frame (series, period, value) with one row per series and month, so it is
small whatever the size of the tables it came from. All series are handled in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlake.functions.columns import side_by_side, total
from remitlake.functions.fixed_values import (
    DAR_BENCHMARK,
    DENIALS_PER_DIRTY_CLAIM,
    PROJECTION_BENCHMARKS,
    REWORK_COST,
)
from remitlake.operators import kpis as k
from remitlake.operators.filters import FilterParams
from remitlake.sources.silver import Silver

MONTHS_AHEAD = 3


def kpi_series(silver: Silver, p: FilterParams) -> DataFrame:
    """Collections, days in A/R and denial rate by month; the first two share one pass."""
    ar = k.days_in_ar_trend(silver, p).select("period", F.inline(F.array(
        F.struct(F.lit("collections").alias("series"), F.col("payments").alias("value")),
        F.struct(F.lit("days_in_ar").alias("series"), F.col("days_in_ar").alias("value")),
    )))
    denial = k.denial_rate_trend(silver, p).select(
        "period", F.lit("denial_rate").alias("series"), F.col("denial_rate").alias("value")
    )
    return ar.unionByName(denial).select("series", "period", "value")


def _of_series() -> Window:
    return Window.partitionBy("series")


def _in_order() -> Window:
    return Window.partitionBy("series").orderBy(F.col("period").asc_nulls_last())


def detect_anomalies(series: DataFrame) -> DataFrame:
    """Every point with the 1.5 IQR bounds of its series (NULL below four points) and a flag.

    Quartiles come from a window over the series, so the input is evaluated once.
    """
    value = F.col("value")
    quarter = [F.percentile("value", F.lit(q)).over(_of_series()) for q in (0.25, 0.75)]
    enough = F.count("value").over(_of_series()) >= 4
    reach = (F.col("q3") - F.col("q1")) * 1.5
    bounded = series.withColumns({"q1": F.when(enough, quarter[0]), "q3": F.when(enough, quarter[1])}).withColumns({
        "lower_bound": F.col("q1") - reach, "upper_bound": F.col("q3") + reach,
    })
    outside = (value < F.col("lower_bound")) | (value > F.col("upper_bound"))
    return bounded.withColumn("is_anomaly", F.coalesce(outside, F.lit(False))).drop("q1", "q3")


def _month_of_year(c: str = "period") -> Column:
    return F.try_element_at(F.split(c, "-"), F.lit(2)).try_cast("int")


def _monthly_means(series: DataFrame) -> DataFrame:
    """Mean per series and calendar month, with the figures of the whole series beside it."""
    w = _of_series()
    known = series.filter(F.col("value").isNotNull()).withColumn("month", _month_of_year())
    whole = known.withColumns({
        "n": F.count("value").over(w), "n_month": F.count("month").over(w), "total_var": F.var_pop("value").over(w),
    })
    means = whole.groupBy("series", "month").agg(
        F.avg("value").alias("mean_value"), *[F.max(c).alias(c) for c in ("n", "n_month", "total_var")]
    )
    judged = (F.col("n") >= 12) & (F.col("n") == F.col("n_month")) & (F.col("total_var") > 0)
    return means.withColumn("judged", judged)


def seasonal_pattern(series: DataFrame) -> DataFrame:
    """Mean per calendar month, for series that :func:`detect_seasonality` can judge."""
    return _monthly_means(series).filter("judged").select("series", "month", "mean_value")


def detect_seasonality(series: DataFrame) -> DataFrame:
    """Variance between calendar-month means over total variance, with its level.

    Fewer than twelve points, a month that cannot be read or no variance give strength 0.
    """
    sums = _monthly_means(series).groupBy("series").agg(
        F.var_pop("mean_value").alias("between"), F.max("total_var").alias("whole"), F.max("judged").alias("judged")
    )
    strength = F.when(F.col("judged"), F.least(F.col("between") / F.col("whole"), F.lit(1.0))).otherwise(0.0)
    level = F.when(F.col("strength") >= 0.5, "strong").when(F.col("strength") >= 0.3, "moderate").otherwise("none")
    return sums.withColumn("strength", strength).select("series", "strength", level.alias("level"))


def _with_line(points: DataFrame, used: Column) -> DataFrame:
    """Least-squares line per series over the points used, evaluated at every point."""
    x, y, w = F.when(used, F.col("x")), F.when(used, F.col("value")), _of_series()
    lines = points.withColumns({
        "fitted_points": F.count(y).over(w),
        "slope": F.regr_slope(y, x).over(w),
        "intercept": F.regr_intercept(y, x).over(w),
    })
    return lines.withColumn("fitted", _line())


def _line() -> Column:
    return F.col("intercept") + F.col("slope") * F.col("x")


def fit_line(series: DataFrame) -> DataFrame:
    """Fitted value of every month; no rows for a series with fewer than four usable points.

    Known points are numbered from 0. Outliers are left out of the fit but keep their
    position.
    """
    known = detect_anomalies(series).filter(F.col("value").isNotNull())
    points = known.withColumn("x", (F.row_number().over(_in_order()) - 1).cast("double"))
    return _with_line(points, ~F.col("is_anomaly")).filter(F.col("fitted_points") >= 4)


def linear_forecast(series: DataFrame, months_ahead: int = MONTHS_AHEAD) -> DataFrame:
    """Projection of the line, with a band of one standard deviation of the fit's residuals."""
    residual = F.when(~F.col("is_anomaly"), F.col("value") - F.col("fitted"))
    lines = fit_line(series).groupBy("series").agg(
        F.count(F.lit(1)).alias("length"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.stddev_pop(residual).alias("resid_std"),
        F.max_by("period", "x").alias("last_period"),
        F.max_by("value", "x").alias("last_value"),
    )
    month = F.try_to_date(F.concat("last_period", F.lit("-01")), "yyyy-MM-dd")
    label = F.coalesce(
        F.date_format(F.add_months(month, F.col("step")), "yyyy-MM"),
        F.concat(F.lit("+"), F.col("step").cast("string"), F.lit("m")),
    )
    steps = lines.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(months_ahead))))
    projected = steps.withColumn("x", F.col("length") + F.col("step") - 1).withColumn("projected", _line())
    return projected.select(
        "series", "step", label.alias("period"), "projected",
        (F.col("projected") - F.col("resid_std")).alias("lower"),
        (F.col("projected") + F.col("resid_std")).alias("upper"),
        "resid_std", "last_value",
    )


def forecast_summary(series: DataFrame, months_ahead: int = MONTHS_AHEAD) -> DataFrame:
    """Projected total, direction against the last actual, and the benchmark verdict."""
    totals = linear_forecast(series, months_ahead).groupBy("series").agg(
        F.sum("projected").alias("projected_total"),
        F.max_by("projected", "step").alias("last_projected"),
        F.max_by("period", "step").alias("last_period"),
        F.max("last_value").alias("last_actual"),
    )
    direction = F.when(F.col("last_projected") > F.col("last_actual"), "upward").otherwise("downward")
    benchmark = None
    for name, limit in PROJECTION_BENCHMARKS.items():
        hit = F.col("series") == name
        benchmark = F.when(hit, limit) if benchmark is None else benchmark.when(hit, limit)
    above = F.when(F.col("last_projected") > F.col("benchmark"), "above").when(
        F.col("benchmark").isNotNull(), "within"
    )
    return totals.withColumn("direction", direction).withColumn("benchmark", benchmark).withColumn(
        "against_benchmark", above
    )


def anomaly_list(series: DataFrame) -> DataFrame:
    """The excluded points."""
    return detect_anomalies(series).filter("is_anomaly").select("series", "period", "value")


def model_stats(series: DataFrame, test_share: float = 0.25) -> DataFrame:
    """Train and test quality of the line; outliers are removed and the rest renumbered.

    The first three quarters (at least four points) train, the rest (at least two) test;
    a series with fewer than six points has no row.
    """
    kept = detect_anomalies(series).filter(F.col("value").isNotNull() & ~F.col("is_anomaly"))
    numbered = kept.select(
        "series", "period", "value",
        (F.row_number().over(_in_order()) - 1).cast("double").alias("x"),
        F.count(F.lit(1)).over(_of_series()).alias("n"),
    )
    split = F.greatest(F.floor(F.col("n") * (1 - test_share)), F.lit(4))
    points = numbered.filter(F.col("n") >= 6).withColumn("train", F.col("x") < split)
    points = points.filter(F.col("n") - split >= 2)
    means = F.avg("value").over(Window.partitionBy("series", "train"))
    scored = _with_line(points, F.col("train")).withColumns({"mean": means, "error": F.col("value") - F.col("fitted")})

    def side(part: Column, name: str) -> list[Column]:
        def of(c: Column) -> Column:
            return F.when(part, c)

        spread = F.sum(of((F.col("value") - F.col("mean")) ** 2))
        miss = F.sum(of(F.col("error") ** 2))
        mape = F.avg(of(F.when(F.col("value") != 0, F.abs(F.col("error") / F.col("value"))))) * 100
        return [
            F.count(of(F.col("x"))).alias(f"{name}_points"),
            F.when(spread > 0, 1 - miss / spread).otherwise(0.0).alias(f"r2_{name}"),
            F.avg(of(F.abs("error"))).alias(f"mae_{name}"),
            mape.alias(f"mape_{name}"),
        ]

    train = F.col("train")
    stats = scored.groupBy("series").agg(*side(train, "train"), *side(~train, "test"))
    fit = F.when(F.col("r2_test") >= 0.8, "strong").when(F.col("r2_test") >= 0.5, "moderate").otherwise("weak")
    return stats.withColumn("fit", fit)


# ------------------------------------------------------------------ scenarios

def scenario_baseline(silver: Silver, p: FilterParams) -> DataFrame:
    """What the scenarios start from: one row.

    The month count is that of the denial trend (submission months), also for the charges.
    """
    ledger = k.monthly_ledger(silver, p).agg(total("payments").alias("payments"), total("charges").alias("charges"))
    claims = k.denial_rate_trend(silver, p).agg(
        F.coalesce(F.sum("total_claims"), F.lit(0)).alias("claims"),
        F.coalesce(F.sum("denied_claims"), F.lit(0)).alias("denied"),
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("months"),
    )
    rates = k.core_kpis(silver, p).select("days_in_ar", "denial_rate", "clean_claim_rate")
    base = side_by_side(ledger, claims, rates)
    return base.select(
        "days_in_ar", "denial_rate", "clean_claim_rate",
        (F.col("claims") / F.col("months")).alias("claims_per_month"),
        (F.col("charges") / (F.col("months") * 30)).alias("daily_charges"),
        (F.col("payments") / F.greatest(F.col("claims") - F.col("denied"), F.lit(1))).alias("payment_per_claim"),
    )


def what_if(
    silver: Silver,
    p: FilterParams,
    denial_points: list[float] | None = None,
    dar_days: list[int] | None = None,
    clean_points: list[float] | None = None,
) -> DataFrame:
    """Effect of every combination of the three improvements.

    Without arguments: the smaller of 2 points and the denial rate, 5 days, and the
    smaller of 3 points and the missing clean rate.
    """
    base = scenario_baseline(silver, p)

    def choices(values: list | None, default: Column) -> Column:
        given = [F.lit(v).cast("double") for v in values] if values else [default.cast("double")]
        return F.explode(F.array(*given))

    missing_clean = F.greatest(F.lit(100.0) - F.col("clean_claim_rate"), F.lit(0.0))
    grid = (
        base.withColumn("denial_points", choices(denial_points, F.least(F.lit(2.0), F.col("denial_rate"))))
        .withColumn("dar_days", choices(dar_days, F.lit(5.0)))
        .withColumn("clean_points", choices(clean_points, F.least(F.lit(3.0), missing_clean)))
    )
    recovered = F.col("claims_per_month") * F.col("denial_points") / 100
    rework = F.col("claims_per_month") * F.col("clean_points") / 100 * REWORK_COST
    gap = F.greatest(F.col("days_in_ar") - DAR_BENCHMARK, F.lit(0.0))
    return grid.select(
        "denial_points", "dar_days", "clean_points",
        recovered.alias("recovered_claims_month"),
        (recovered * F.col("payment_per_claim")).alias("recovery_month"),
        (recovered * F.col("payment_per_claim") * 12).alias("recovery_year"),
        (F.col("dar_days") * F.col("daily_charges")).alias("cash_unlocked"),
        F.greatest(F.col("days_in_ar") - F.col("dar_days"), F.lit(0.0)).alias("projected_dar"),
        F.greatest(gap - F.col("dar_days"), F.lit(0.0)).alias("remaining_gap"),
        rework.alias("rework_saved_month"),
        (rework * 12).alias("rework_saved_year"),
        (F.col("clean_points") * DENIALS_PER_DIRTY_CLAIM).alias("implied_denial_drop"),
    ).withColumn("total_opportunity", F.col("recovery_year") + F.col("cash_unlocked") + F.col("rework_saved_year"))
