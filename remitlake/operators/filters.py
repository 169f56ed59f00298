"""The shared filter set: claims in scope, the cascade over related tables, filter options."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlake.functions.columns import count_when, iso_date
from remitlake.sources.silver import Silver


@dataclass(frozen=True)
class FilterParams:
    """Inclusive date-of-service range, and optional payer, department and encounter type."""

    start_date: str
    end_date: str
    payer_id: str | None = None
    department: str | None = None
    encounter_type: str | None = None


#: A claim's encounter department and type where they are stored with it.
STORED_DEPARTMENT, STORED_TYPE = "_department", "_encounter_type"


def _of_encounter(claims: DataFrame, p: FilterParams) -> DataFrame:
    """Claims whose stored department and type are those asked for, without the stored columns."""
    if STORED_DEPARTMENT not in claims.columns:
        return claims
    if p.department:
        claims = claims.filter(F.col(STORED_DEPARTMENT) == p.department)
    if p.encounter_type:
        claims = claims.filter(F.col(STORED_TYPE) == p.encounter_type)
    return claims.drop(STORED_DEPARTMENT, STORED_TYPE)


def filtered_claims(silver: Silver, p: FilterParams) -> DataFrame:
    """Claims in scope, with claim columns only.

    Dates compare as text, so the range reaches the scan as a pushed filter. Encounters
    are joined only if one of their columns is asked for and not stored with the claims:
    encounter_id is the key of encounters, so the join could neither add nor drop a claim
    otherwise. With such a filter a claim without an encounter drops out.
    """
    claims = silver.claims.filter(F.col("date_of_service").between(p.start_date, p.end_date))
    if p.payer_id:
        claims = claims.filter(F.col("payer_id") == p.payer_id)
    stored = STORED_DEPARTMENT in claims.columns
    claims = _of_encounter(claims, p)
    if not stored and (p.department or p.encounter_type):
        encounters = silver.encounters
        if p.department:
            encounters = encounters.filter(F.col("department") == p.department)
        if p.encounter_type:
            encounters = encounters.filter(F.col("encounter_type") == p.encounter_type)
        claims = claims.join(encounters.select("encounter_id"), "encounter_id", "left_semi")
    return claims


def _scope(silver: Silver, p: FilterParams) -> tuple[DataFrame, DataFrame]:
    """Claims and encounters of the cascade."""
    start, end = F.lit(p.start_date).cast("date"), F.lit(p.end_date).cast("date")
    # A date that parses is equal to its text, so comparing the text as well changes nothing but reaches the scan.
    as_text = F.col("date_of_service").between(p.start_date, p.end_date)
    in_range = as_text & iso_date("date_of_service").between(start, end)
    claims = silver.claims.filter(in_range)
    if p.payer_id:
        claims = claims.filter(F.col("payer_id") == p.payer_id)
    claims = _of_encounter(claims, p)
    encounters = silver.encounters.filter(in_range)
    if p.department:
        encounters = encounters.filter(F.col("department") == p.department)
    if p.encounter_type:
        encounters = encounters.filter(F.col("encounter_type") == p.encounter_type)
    if p.department or p.encounter_type:
        claims = claims.join(encounters.select("encounter_id"), "encounter_id", "left_semi")
    return claims, encounters


def cascade(silver: Silver, p: FilterParams) -> Silver:
    """Filter every table outward from claims.

    Not the same as :func:`filtered_claims`: encounters are filtered by their own date
    (and not by payer), and a department or type keeps only claims whose encounter passes
    that date filter as well. Charges follow the encounters, the rest follow the claims.
    """
    claims, encounters = _scope(silver, p)
    claim_ids, encounter_ids = claims.select("claim_id"), encounters.select("encounter_id")
    return silver.with_tables(
        claims=claims,
        encounters=encounters,
        payments=silver.payments.join(claim_ids, "claim_id", "left_semi"),
        denials=silver.denials.join(claim_ids, "claim_id", "left_semi"),
        adjustments=silver.adjustments.join(claim_ids, "claim_id", "left_semi"),
        charges=silver.charges.join(encounter_ids, "encounter_id", "left_semi"),
    )


def cascade_sizes(silver: Silver, p: FilterParams) -> DataFrame:
    """Rows per table of the cascade, without its joins: the scope is derived once, and the tables that follow it are
    counted per key together with it. The counts combine map-side, so a hot claim is a few rows by then."""
    claims, encounters = _scope(silver, p)

    def counted(scope: DataFrame, key: str, name: str, **followers: DataFrame) -> DataFrame:
        tables = {name: scope, **followers}
        tagged = reduce(DataFrame.unionByName, [
            f.filter(F.col(key).isNotNull()).select(key, F.lit(t).alias("of")) for t, f in followers.items()
        ] + [scope.select(key, F.lit(name).alias("of"))])
        keys = tagged.groupBy(key).agg(*[count_when(F.col("of") == t).alias(t) for t in tables])
        sums = keys.filter(F.col(name) > 0).agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in tables])
        rows = F.array(*[F.struct(F.lit(t).alias("table"), F.col(t).alias("n")) for t in tables])
        return sums.select(F.inline(rows))

    per_claim = counted(
        claims, "claim_id", "claims", payments=silver.payments, denials=silver.denials, adjustments=silver.adjustments
    )
    return per_claim.unionByName(counted(encounters, "encounter_id", "encounters", charges=silver.charges))


def date_bounds(silver: Silver) -> DataFrame:
    """First and last service date of the claims."""
    day = iso_date("date_of_service")
    return silver.claims.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))


def options(silver: Silver, which: str) -> DataFrame:
    """Sorted choices of one filter: ``payer_name``, ``department`` or ``encounter_type``.

    Payer names are listed as they are; departments and types are the distinct ones.
    """
    if which == "payer_name":
        return silver.payers.select(which).orderBy(which)
    return silver.encounters.select(which).distinct().orderBy(which)


def payer_id_of(silver: Silver, payer_name: str) -> DataFrame:
    """Key for a payer name; the smallest if the name is used twice, no row if it is not used."""
    named = silver.payers.filter(F.col("payer_name") == payer_name)
    return named.agg(F.min("payer_id").alias("payer_id")).filter("payer_id IS NOT NULL")


def searched(df: DataFrame) -> Column:
    """The text that a row is searched in: all its columns, in lower case."""
    return F.lower(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]))


def search(df: DataFrame, text: str = "", **equal: str) -> DataFrame:
    """Rows with the text in any column, ignoring case, and the given column values."""
    if text:
        df = df.filter(F.contains(searched(df), F.lit(text.lower())))
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df
