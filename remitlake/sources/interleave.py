"""Claims stored in an interleaved order of date, payer and department, so that a filter on any of them skips files.

Each of the three is cut into ranges that hold about equally many rows; the bits of the ranges' numbers are interleaved to
one number, by which the claims are range-partitioned. A file then covers a small range of each. The department and the
type of a claim's encounter are stored with the claim, which also saves the join that a filter on them needs otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.functions.columns import iso_date
from remitlake.operators.filters import STORED_DEPARTMENT, STORED_TYPE
from remitlake.sources.records import drop_folder, work_folder
from remitlake.sources.schemas import typed_schema
from remitlake.sources.silver import Silver

#: Ranges per column: two to this power.
BITS = 5


def text_rank(column: str, length: int = 6) -> Column:
    """A number in the order of a text's first bytes; the text in a file's statistics has the same order."""
    head = F.substring(F.rpad(F.coalesce(F.col(column), F.lit("")), length, "\0"), 1, length)
    return F.conv(F.substring(F.hex(head.cast("binary")), 1, 2 * length), 16, 10).cast("double")


def interleaved(frame: DataFrame, ranks: list[Column], bits: int = BITS) -> Column:
    """The interleaved range numbers of ``ranks``; the bounds of the ranges are found in one pass over ``frame``."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = frame.agg(*[F.percentile_approx(r, shares, 1000).alias(f"r{i}") for i, r in enumerate(ranks)]).first()
    bounds = [sorted(set(b or [])) for b in found]  # at most 2^bits - 1 numbers each

    def place(rank: Column, limits: list[float]) -> Column:
        known = F.array(*map(F.lit, limits)) if limits else F.array().cast("array<double>")
        number = F.coalesce(F.size(F.filter(known, lambda b: b < rank)), F.lit(0))
        # Few different values are few ranges: spread, so that their numbers use the high bits as well.
        return F.floor(number * ((1 << bits) / (len(limits) + 1))).cast("long")

    places = [place(r, b) for r, b in zip(ranks, bounds)]
    pieces = [
        F.shiftleft(F.shiftright(p, k).bitwiseAND(F.lit(1)), k * len(places) + d) for d, p in enumerate(places) for k in range(bits)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), pieces)


def write_interleaved(silver: Silver, root: str, files: int | None = None, bits: int = BITS) -> None:
    """Full refresh of ``root/claims`` in about ``files`` files."""
    encounters = silver.encounters.select(
        "encounter_id", F.col("department").alias(STORED_DEPARTMENT), F.col("encounter_type").alias(STORED_TYPE)
    )
    claims = silver.claims.join(encounters, "encounter_id", "left").select(*silver.claims.columns, STORED_DEPARTMENT, STORED_TYPE)
    scratch = work_folder(root)
    try:
        claims.write.parquet(scratch)  # put together once: the bounds, the sample of the ranges and the rows are read from it
        claims = silver.claims.sparkSession.read.schema(claims.schema).parquet(scratch)
        day = F.datediff(iso_date("date_of_service"), F.lit("1970-01-01").cast("date")).cast("double")
        order = interleaved(claims, [day, text_rank("payer_id"), text_rank(STORED_DEPARTMENT)], bits)
        placed = claims.withColumn("_order", order)
        ranged = placed.repartitionByRange(files, "_order", "claim_id") if files else placed.repartitionByRange("_order", "claim_id")
        ranged.sortWithinPartitions("_order", "date_of_service").drop("_order").write.mode("overwrite").parquet(f"{root}/claims")
    finally:
        drop_folder(silver.claims.sparkSession, scratch)


def with_interleaved(spark: SparkSession, silver: Silver, root: str) -> Silver:
    """The tables with the claims stored below ``root``."""
    schema = typed_schema("claims").add(STORED_DEPARTMENT, "string").add(STORED_TYPE, "string")
    return silver.with_tables(claims=lambda: spark.read.schema(schema).parquet(f"{root}/claims"))
