"""Changed rows of the typed tables: as a view of the new state, and written to the partitions that hold their keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.functions.columns import period
from remitlake.sources.records import drop_folder, work_folder
from remitlake.sources.schemas import KEYS, TABLES, typed_schema
from remitlake.sources.silver import Silver


@dataclass(frozen=True)
class Changes:
    """Per table the rows that are new or replace the row of the same key, and the keys of rows that go."""

    rows: dict[str, DataFrame] = field(default_factory=dict)
    deleted: dict[str, DataFrame] = field(default_factory=dict)

    def keys(self, table: str) -> DataFrame | None:
        """Keys that are touched in a table, each once; None if there are none."""
        key = KEYS[table]
        parts = [d[table].select(key) for d in (self.rows, self.deleted) if table in d]
        return parts[0].unionByName(parts[1]).distinct() if len(parts) == 2 else parts[0].distinct() if parts else None

    def applied(self, silver: Silver) -> Silver:
        """The tables after the changes. Rows without a key are never replaced."""
        return silver.with_tables(**{
            t: merged(getattr(silver, t), self.rows.get(t), self.keys(t), KEYS[t]) for t in {*self.rows, *self.deleted}
        })


def merged(frame: DataFrame, rows: DataFrame | None, keys: DataFrame, key: str) -> DataFrame:
    kept = frame.join(keys, key, "left_anti").select(*frame.columns)
    return kept.unionByName(rows.select(*frame.columns)) if rows is not None else kept


#: Column that says in which partition a row is stored: the month it belongs to, or a hash of its key.
PARTITION = "_part"
MONTH_OF = {
    "claims": "date_of_service", "encounters": "date_of_service", "charges": "service_date", "payments": "payment_date",
    "denials": "denial_date", "adjustments": "adjustment_date",
}


def partition_of(table: str, parts: int) -> Column:
    hashed = F.pmod(F.hash(KEYS[table]), F.lit(parts)).cast("string")
    return F.coalesce(period(MONTH_OF[table]), F.lit("none")) if table in MONTH_OF else hashed


def write_partitioned(frame: DataFrame, root: str, table: str, parts: int = 16) -> None:
    """Full refresh of ``root/<table>`` by partition; a large month is several files, split by key."""
    placed = frame.withColumn(PARTITION, partition_of(table, parts))
    placed.repartition(PARTITION, F.pmod(F.hash(KEYS[table]), F.lit(parts))).write.mode("overwrite").partitionBy(PARTITION).parquet(f"{root}/{table}")


def read_partitioned(spark: SparkSession, root: str, table: str) -> DataFrame:
    schema = typed_schema(table).add(PARTITION, "string")
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def touched_partitions(stored: DataFrame, table: str, changes: Changes, parts: int) -> list[str]:
    """Partitions that hold a touched key or get a row: of the stored rows only keys and partitions are read."""
    held = stored.select(KEYS[table], PARTITION).join(changes.keys(table), KEYS[table], "left_semi").select(PARTITION)
    if table in changes.rows:
        held = held.unionByName(changes.rows[table].select(partition_of(table, parts).alias(PARTITION)))
    return sorted(r[0] for r in held.distinct().collect())  # names of partitions, one per month or hash


def replace_rows(spark: SparkSession, root: str, table: str, changes: Changes, parts: int = 16) -> list[str]:
    """Apply the changes of one table to ``root/<table>``; returns the partitions that were written anew.

    Files of all other partitions stay as they are. A key that moves to another month leaves the old one. Partitions are
    swapped when all of them are written, so a run that is cut short before changes nothing, and one that is repeated
    gives the same rows. A partition that loses all its rows keeps an empty file.
    """
    if changes.keys(table) is None:
        return []
    stored = read_partitioned(spark, root, table)
    names = touched_partitions(stored, table, changes, parts)
    if not names:
        return []
    columns = [c for c, _ in TABLES[table]]
    old = stored.filter(F.col(PARTITION).isin(names)).select(*columns)
    new = merged(old, changes.rows.get(table), changes.keys(table), KEYS[table])
    scratch = work_folder(root)
    placed = new.withColumn(PARTITION, partition_of(table, parts))
    placed.write.mode("overwrite").parquet(scratch)  # computed once, before anything of the table goes
    ready = spark.read.schema(placed.schema).parquet(scratch)
    ready.repartition(PARTITION, F.pmod(F.hash(KEYS[table]), F.lit(parts))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(PARTITION).parquet(f"{root}/{table}")
    left = {r[0] for r in ready.select(PARTITION).distinct().collect()}
    for name in set(names) - left:
        ready.filter(F.lit(False)).drop(PARTITION).coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}/{PARTITION}={name}")
    drop_folder(spark, scratch)
    return names
