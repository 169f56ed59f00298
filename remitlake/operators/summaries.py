"""The aggregate views kept up to date: stored partial sums that take the retraction of what changed.

Three tables of sums hold what the five views need: claims by day of service, payer and status; encounters by department;
denials by reason. What a claim, an encounter or a denial adds to them depends on few rows, so a change is the negated
contributions of the touched keys before it and their contributions after it. Amounts are decimals, so that what is taken
back leaves nothing. A refresh appends its sums under its number; a refresh that runs again replaces them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.functions.columns import aging_bucket, count_when, iso_date, period, ratio
from remitlake.operators.ledger import EXACT
from remitlake.sources.changes import Changes
from remitlake.sources.records import drop_folder, work_folder
from remitlake.sources.schemas import KEYS
from remitlake.sources.silver import Silver

SUM = "decimal(38,10)"
GRAINS = {
    "claims": ("date_of_service", "payer_id", "claim_status"),
    "encounters": ("department",),
    "denials": ("denial_reason_code", "denial_reason_description"),
}
MEASURES = {
    "claims": ("claims", "weight", "clean", "charges", "paid"),
    "encounters": ("encounters", "charges", "paid"),
    "denials": ("rows", "denials", "won", "denied", "known_denied", "recovered"),
}
_COUNTS = ("claims", "weight", "clean", "encounters", "rows", "denials", "won", "known_denied")


def _exact(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast(EXACT), F.lit(0).cast(EXACT))


def _only(frame: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
    return frame if keys is None else frame.join(keys, key, "left_semi")


def _paid_claims(silver: Silver, claim_ids: DataFrame | None) -> DataFrame:
    """Claims with the number of joined rows and what was paid, exactly."""
    payments = _only(silver.payments, claim_ids, "claim_id").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_exact("payment_amount")).alias("paid")
    )
    claims = _only(silver.claims, claim_ids, "claim_id").join(payments, "claim_id", "left")
    return claims.withColumns({"weight": F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)), "paid": F.coalesce("paid", F.lit(0).cast(SUM))})


def _claim_sums(silver: Silver, claim_ids: DataFrame | None) -> DataFrame:
    claims = _paid_claims(silver, claim_ids)
    return claims.groupBy(*GRAINS["claims"]).agg(
        F.count("claim_id").alias("claims"), F.sum("weight").alias("weight"),
        F.sum(F.when(F.col("is_clean_claim") == 1, F.col("weight")).otherwise(0)).alias("clean"),
        F.sum((_exact("total_charge_amount") * F.col("weight")).cast(SUM)).alias("charges"), F.sum("paid").alias("paid"),
    )


def _encounter_sums(silver: Silver, encounter_ids: DataFrame | None) -> DataFrame:
    scope = silver.with_tables(claims=_only(silver.claims, encounter_ids, "encounter_id"))
    ids = None if encounter_ids is None else scope.claims.select("claim_id").distinct()
    claims = _paid_claims(scope, ids).groupBy("encounter_id").agg(F.sum("weight").alias("copies"), F.sum("paid").alias("paid"))
    lines = _only(silver.charges, encounter_ids, "encounter_id").groupBy("encounter_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(_exact("charge_amount")).alias("charges")
    )
    encounters = _only(silver.encounters, encounter_ids, "encounter_id").select("encounter_id", "department")
    joined = encounters.join(claims, "encounter_id", "left").join(lines, "encounter_id", "left")
    none = F.lit(0).cast(SUM)
    return joined.groupBy("department").agg(
        F.count("encounter_id").alias("encounters"),
        F.sum(F.coalesce((F.col("charges") * F.coalesce("copies", F.lit(1))).cast(SUM), none)).alias("charges"),
        F.sum(F.coalesce((F.col("paid") * F.coalesce("lines", F.lit(1))).cast(SUM), none)).alias("paid"),
    )


def _denial_sums(silver: Silver, denial_ids: DataFrame | None) -> DataFrame:
    return _only(silver.denials, denial_ids, "denial_id").groupBy(*GRAINS["denials"]).agg(
        F.count(F.lit(1)).alias("rows"), F.count("denial_id").alias("denials"),
        count_when(F.col("appeal_status") == "Won").alias("won"),
        F.sum(_exact("denied_amount")).alias("denied"), F.count("denied_amount").alias("known_denied"),
        F.sum(_exact("recovered_amount")).alias("recovered"),
    )


_SUMS = {"claims": _claim_sums, "encounters": _encounter_sums, "denials": _denial_sums}


def _typed(sums: DataFrame, part: str, sign: int = 1) -> DataFrame:
    measures = [(F.col(m) * sign).cast("long" if m in _COUNTS else SUM).alias(m) for m in MEASURES[part]]
    return sums.select(*GRAINS[part], *measures)


def _united(*frames: DataFrame | None) -> DataFrame | None:
    some = [f for f in frames if f is not None]
    return reduce(DataFrame.unionByName, some).distinct() if some else None


def _stored(frame: DataFrame, path: str) -> DataFrame:
    """Written and read back, so that what is built on it starts from a short plan."""
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def touched(old: Silver, changes: Changes, scratch: str) -> dict[str, DataFrame | None]:
    """Keys whose contribution may differ, per table of sums: claims with their payments; encounters with their claims,
    these claims' payments and their lines; denials. Stored below ``scratch``."""
    ids = {t: changes.keys(t) for t in ("claims", "payments", "encounters", "charges", "denials")}

    def kept(name: str, keys: DataFrame | None) -> DataFrame | None:
        return None if keys is None else _stored(keys, f"{scratch}/touched_{name}")

    def referring(table: str, key: str) -> DataFrame | None:
        if ids[table] is None:
            return None
        return _either(old, changes, table).join(ids[table], KEYS[table], "left_semi").select(key)

    claims = kept("claims", _united(ids["claims"], referring("payments", "claim_id")))
    of_claims = None if claims is None else _either(old, changes, "claims").join(claims, "claim_id", "left_semi").select("encounter_id")
    encounters = _united(ids["encounters"], referring("charges", "encounter_id"), of_claims)
    return {"claims": claims, "encounters": kept("encounters", encounters), "denials": kept("denials", ids["denials"])}


def _either(old: Silver, changes: Changes, table: str) -> DataFrame:
    """Rows of a table before the changes, and those that come with them."""
    frame, rows = getattr(old, table), changes.rows.get(table)
    return frame if rows is None else frame.unionByName(rows.select(*frame.columns))


#: The tables that the sums read, with the column by which the touched keys pick their rows.
SCOPE = {
    "claims": {"claims": "claim_id", "payments": "claim_id"},
    "encounters": {"claims": "encounter_id", "charges": "encounter_id", "encounters": "encounter_id", "payments": None},
    "denials": {"denials": "denial_id"},
}


def _scoped(part: str, table: str, silver: Silver, keys: DataFrame) -> DataFrame:
    """Rows that the sums of ``keys`` need; payments are picked by ``_scope`` where the keys are not theirs."""
    frame, key = getattr(silver, table), SCOPE[part][table]
    return _only(frame, keys, key) if key else frame


def _scope(part: str, old: Silver, changes: Changes, keys: DataFrame, scratch: str) -> Silver:
    """The tables with only those rows, stored, that the sums of ``keys`` need before and after the changes."""
    for table, key in SCOPE[part].items():
        if key:
            rows = _scoped(part, table, old, keys)
        else:  # payments of the claims that these encounters have before or after
            ids = _only(_either(old, changes, "claims"), keys, "encounter_id").select("claim_id").distinct()
            rows = _only(getattr(old, table), ids, "claim_id")
        old = old.with_tables(**{table: _stored(rows, f"{scratch}/{part}_{table}")})
    return old


class Summaries:
    """The stored sums below ``root``: one folder per table of sums and refresh."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def build(self, silver: Silver) -> None:
        """All sums anew, as refresh 0."""
        for part, of in _SUMS.items():
            _typed(of(silver, None), part).withColumn("refresh", F.lit(0)).write.mode("overwrite").partitionBy("refresh").parquet(f"{self.root}/{part}")

    def refresh(self, number: int, old: Silver, changes: Changes) -> Silver:
        """Take the changes into the sums under ``number`` (1, 2, ...); returns the tables after them.

        Only rows of touched keys are summed: for everything else the tables are at most scanned for them.
        """
        if number < 1:
            raise ValueError("refreshes count from 1")
        scratch = work_folder(self.root)
        try:
            self._take_in(number, old, changes, scratch)
        finally:
            drop_folder(self.spark, scratch)
        return changes.applied(old)

    def _take_in(self, number: int, old: Silver, changes: Changes, scratch: str) -> None:
        """The changes, the touched keys and the touched rows are stored one after the other: the plan of the sums over
        both states then reads few small tables, however the tables and the changes were put together."""
        small = Changes(*[
            {t: _stored(f, f"{scratch}/{kind}_{t}") for t, f in frames.items()}
            for kind, frames in (("rows", changes.rows), ("deleted", changes.deleted))
        ])
        for part, keys in touched(old, small, scratch).items():
            if keys is not None:
                before = _scope(part, old, small, keys, scratch)
                after = small.applied(before)
                changed = [t for t in SCOPE[part] if small.keys(t) is not None]
                after = after.with_tables(**{t: _stored(_scoped(part, t, after, keys), f"{scratch}/{part}_{t}_after") for t in changed})
                change = _typed(_SUMS[part](before, keys), part, -1).unionByName(_typed(_SUMS[part](after, keys), part))
                added = change.groupBy(*GRAINS[part]).agg(*[F.sum(m).alias(m) for m in MEASURES[part]])
                _typed(added, part).write.mode("overwrite").parquet(f"{self.root}/{part}/refresh={number}")

    def compacted(self, root: str) -> "Summaries":
        """The same sums as one refresh below another folder."""
        for part in _SUMS:
            self.sums(part).withColumn("refresh", F.lit(0)).write.mode("overwrite").partitionBy("refresh").parquet(f"{root}/{part}")
        return Summaries(self.spark, root)

    def sums(self, part: str) -> DataFrame:
        """The current sums; groups that nothing is left of are gone."""
        stored = self.spark.read.parquet(f"{self.root}/{part}")
        summed = _typed(stored.groupBy(*GRAINS[part]).agg(*[F.sum(m).alias(m) for m in MEASURES[part]]), part)
        return summed.filter(reduce(lambda a, b: a | b, [F.col(m) != 0 for m in MEASURES[part]]))

    def views(self, silver: Silver, as_of: str | None = None) -> dict[str, DataFrame]:
        """The five views from the sums; of the tables only the payers are read."""
        claims, encounters, denials = (self.sums(p) for p in _SUMS)
        amounts = [F.sum("charges").cast("double").alias("total_charges"), F.sum("paid").cast("double").alias("total_payments")]
        counts = [F.sum("claims").alias("total_claims")]
        denied = ratio(F.sum(F.when(F.col("claim_status") == "Denied", F.col("weight")).otherwise(0)), F.sum("weight"))
        clean = ratio(F.sum("clean"), F.sum("weight"))
        gcr = ratio(F.col("total_payments"), F.col("total_charges"))
        monthly = claims.groupBy(period("date_of_service").alias("period")).agg(
            *counts, *amounts, clean.alias("clean_claim_rate"), denied.alias("denial_rate")
        ).withColumn("gross_collection_rate", gcr)
        per_payer = claims.groupBy("payer_id").agg(*counts, *amounts, denied.alias("denial_rate"))
        payers = silver.payers.select("payer_id", "payer_name", "payer_type").join(per_payer, "payer_id", "left").withColumns({
            "total_claims": F.coalesce("total_claims", F.lit(0)),
            "total_payments": F.coalesce("total_payments", F.lit(0.0)),
            "gross_collection_rate": ratio(F.coalesce("total_payments", F.lit(0.0)), F.col("total_charges")),
        })
        departments = encounters.select(
            "department", F.col("encounters").alias("total_encounters"), F.col("charges").cast("double").alias("total_charges"),
            F.col("paid").cast("double").alias("total_payments"),
        ).withColumn("revenue_per_encounter", ratio(F.col("total_payments"), F.col("total_encounters")))
        today = F.lit(as_of).cast("date") if as_of else F.current_date()
        age = F.datediff(today, iso_date("date_of_service"))
        aging = claims.filter(F.col("claim_status") != "Paid").groupBy(aging_bucket(age, " days").alias("aging_bucket")).agg(
            F.sum("weight").alias("claim_count"), F.sum("charges").cast("double").alias("total_billed"),
            F.sum("paid").cast("double").alias("total_collected"),
        ).withColumn("outstanding_balance", F.col("total_billed") - F.col("total_collected"))
        reasons = denials.select(
            *GRAINS["denials"], F.col("denials").alias("denial_count"),
            F.when(F.col("known_denied") > 0, F.col("denied").cast("double")).alias("total_denied"),
            F.col("recovered").cast("double").alias("total_recovered"),
            ratio(F.col("won"), F.col("denials")).alias("appeal_success_rate"),
        )
        return {
            "monthly_kpis": monthly.orderBy(F.col("period").asc_nulls_last()),
            "payer_performance": payers.orderBy(F.col("total_payments").desc()),
            "department_performance": departments.orderBy(F.col("total_payments").desc()),
            "ar_aging": aging,
            "denial_analysis": reasons.orderBy(F.col("denial_count").desc()),
        }
