"""CSV files to the raw text layer, raw to typed layer, and the load log."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.sources.records import drop_folder, lines_stand_alone, records, stored_lines, work_folder
from remitlake.sources.schemas import KEYS, TABLES, raw_schema
from remitlake.sources.silver import Silver

# Texts that stand for a missing value, and flag texts that mean true.
NULL_TEXTS = ("", "NULL", "null")
TRUE_TEXTS = ("TRUE", "1", "YES")


# ---------------------------------------------------------------- raw layer

CSV_OPTIONS = {
    "sep": ",", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
    "mode": "PERMISSIVE",
}


def read_csv(spark: SparkSession, path: str, table: str, multi_line: bool = False) -> DataFrame:
    """Read one raw file by column position, with Spark's own reader.

    The header names are ignored, short rows are padded with NULL and surplus fields dropped. With ``multi_line`` line
    breaks may stand inside quotes, and one file is one task; without, every line is a record.
    """
    reader = spark.read.schema(raw_schema(table)).options(**CSV_OPTIONS)
    return null_texts(reader.options(header=True, enforceSchema=True, multiLine=multi_line).csv(path))


def parsed(lines: DataFrame, table: str, scratch: str) -> DataFrame:
    """The raw rows of stored lines, as ``read_csv`` with ``multi_line`` reads them, but in as many tasks as there are splits."""
    names = ", ".join(f"`{c}` string" for c, _ in TABLES[table])
    row = F.from_csv("value", names, CSV_OPTIONS)
    return null_texts(records(lines, scratch).select(row.alias("row")).select("row.*"))


def null_texts(df: DataFrame) -> DataFrame:
    """Trim every field and map the null texts to NULL."""
    return df.select(*[
        F.when(~F.trim(c).isin(*NULL_TEXTS), F.trim(c)).alias(c) for c in df.columns
    ])


def load_raw(spark: SparkSession, source: str, target: str, tables: list[str] | None = None) -> None:
    """Full reload of ``source/<table>.csv`` into ``target/<table>``, stamped with the load time.

    Files are split by size; line breaks inside quoted fields are allowed. A first pass looks for lines that end inside a
    quoted field: without any, Spark's reader takes every line as a record and nothing is kept in between. With some, the
    lines lie below ``target`` until the table is written. A file that ends inside a quoted field is refused before anything
    of it is written.
    """
    for table in tables or TABLES:
        scratch = work_folder(target)
        try:
            path = f"{source}/{table}.csv"
            if lines_stand_alone(spark, path, scratch):
                frame = read_csv(spark, path, table)
            else:
                frame = parsed(stored_lines(spark, path, scratch), table, scratch)
            stamped = frame.withColumn("_loaded_at", F.current_timestamp())
            stamped.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/{table}")
        finally:
            drop_folder(spark, scratch)


def read_raw(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{root}/{t}") for t in TABLES}


# ---------------------------------------------------------------- typed layer

def number(c: str) -> Column:
    return F.col(c).try_cast("double")


def whole_number(c: str) -> Column:
    """Text to integer, half away from zero for a fraction, NULL for anything else."""
    rounded = F.round(F.col(c).try_cast("decimal(38,18)"), 0).try_cast("int")
    return F.when(F.col(c).rlike(r"\A[0-9]{1,9}\z"), F.col(c).try_cast("int")).otherwise(rounded)  # digits need no decimal


def flag(c: str) -> Column:
    """1 for a true text, 0 for everything else, also for NULL."""
    return F.when(F.upper(F.trim(c)).isin(*TRUE_TEXTS), 1).otherwise(0)


def text_or_null(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def number_or_zero(c: str) -> Column:
    """A blank counts as zero, but text that is no number is NULL."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("0")).try_cast("double")


# Column rules that differ from a plain pass-through; everything else is text.
RULES: dict[str, dict[str, Callable[[str], Column]]] = {
    "payers": {"avg_reimbursement_pct": number},
    "charges": {"units": whole_number, "charge_amount": number},
    "claims": {"total_charge_amount": number, "is_clean_claim": flag, "fail_reason": text_or_null},
    "payments": {"payment_amount": number, "allowed_amount": number, "is_accurate_payment": flag},
    "denials": {"denied_amount": number, "recovered_amount": number_or_zero},
    "adjustments": {"adjustment_amount": number},
    "operating_costs": {
        c: number
        for c in ("billing_staff_cost", "software_cost", "outsourcing_cost", "supplies_overhead", "total_rcm_cost")
    },
}


def to_typed(raw: DataFrame, table: str) -> DataFrame:
    """One raw table to its typed form; rows without a key are left out."""
    rules = RULES.get(table, {})
    key = F.col(KEYS[table])
    columns = [rules.get(name, F.col)(name).alias(name) for name, _ in TABLES[table]]
    return raw.filter(key.isNotNull() & (key != "")).select(*columns)


def typed_silver(raw: dict[str, DataFrame]) -> Silver:
    """All ten tables, lazily."""
    return Silver({t: lambda t=t: to_typed(raw[t], t) for t in TABLES})


# Tables filtered by date of service are laid out by it, so that a date range prunes
# files and row groups. The key behind the date splits a day that holds too many rows.
CLUSTER_BY = {
    "claims": ["date_of_service", "claim_id"],
    "encounters": ["date_of_service", "encounter_id"],
}


def write_typed(silver: Silver, target: str, clustered: bool = True, tables: Iterable[str] = TABLES) -> None:
    """Full refresh of ``target/<table>``."""
    for table in tables:
        frame = getattr(silver, table)
        order = CLUSTER_BY.get(table)
        if clustered and order:
            frame = frame.repartitionByRange(*order).sortWithinPartitions(*order)
        frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/{table}")


# ---------------------------------------------------------------- load log

def log_row(frame: DataFrame, table: str, loaded_at: Column | None = None) -> DataFrame:
    """Domain, load time, row count and file of one table."""
    when = (loaded_at if loaded_at is not None else F.current_timestamp()).cast("timestamp_ntz")
    return frame.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table).alias("domain"), when.alias("last_loaded_at"), "row_count", F.lit(f"{table}.csv").alias("source_file")
    )


def load_log_rows(silver: Silver, loaded_at: Column | None = None, tables: Iterable[str] = TABLES) -> DataFrame:
    """One row per table. One union, so one job."""
    return reduce(DataFrame.unionByName, [log_row(getattr(silver, t), t, loaded_at) for t in tables])


LOG_SCHEMA = "domain string, last_loaded_at timestamp_ntz, row_count bigint, source_file string"


def upsert_log(new: DataFrame, path: str) -> None:
    """Update or insert: the rows replace those of the same domain, other domains stay. One folder per domain, so
    nothing is read for it and the log does not grow with the runs."""
    writer = new.repartition(1, "domain").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("domain").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The latest run of every domain."""
    return spark.read.schema(LOG_SCHEMA).parquet(path).select("domain", "last_loaded_at", "row_count", "source_file")


def run_pipeline(
    spark: SparkSession, source: str, target: str, clustered: bool = True, tables: Iterable[str] = TABLES,
    loaded_at: Column | None = None,
) -> Silver:
    """Raw files to raw layer to typed layer to load log, in that order; all tables, or only those named."""
    tables = list(tables)
    load_raw(spark, source, f"{target}/bronze", tables)
    raw = {t: spark.read.parquet(f"{target}/bronze/{t}") for t in tables}
    write_typed(typed_silver(raw), f"{target}/silver", clustered, tables)
    silver = Silver.from_parquet(spark, f"{target}/silver")
    upsert_log(load_log_rows(silver, loaded_at, tables), f"{target}/metadata/pipeline_runs")
    return silver
