"""The typed layer stored by key: tables that meet claim by claim or encounter by encounter lie in equal buckets.

A sum per claim, a join of such sums with the claims and a semi join by claim then read matching buckets and shuffle
nothing. Within a bucket, claims and encounters are sorted by date of service, so that a range of dates skips row groups.
Buckets are a property of a catalog table; ``open_bucketed`` declares the stored tables in a session that lacks them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.sources.ingest import CLUSTER_BY
from remitlake.sources.schemas import KEYS, TABLES, typed_schema
from remitlake.sources.silver import Silver

BUCKET_BY = {
    "claims": "claim_id", "payments": "claim_id", "denials": "claim_id", "adjustments": "claim_id",
    "encounters": "encounter_id", "charges": "encounter_id",
}
#: A table whose fullest bucket holds this many times the mean is stored without buckets: one task reads a bucket, and
#: a key that owns a large share of the rows could not be split. Results are the same; its sums then shuffle per key.
UNEVEN = 8.0
LAYOUT = "table string, key string, buckets int"


def _sorted_by(table: str) -> list[str]:
    return CLUSTER_BY.get(table, [BUCKET_BY[table], KEYS[table]])


def fullest_bucket(frame: DataFrame, key: str, buckets: int) -> float:
    """Rows of the fullest bucket over the mean of all buckets."""
    sizes = frame.groupBy(F.pmod(F.hash(key), F.lit(buckets))).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n"), F.sum("n")).first()
    return row[0] * buckets / row[1] if row[1] else 0.0


def write_bucketed(silver: Silver, root: str, buckets: int, uneven: float = UNEVEN) -> None:
    """Full refresh of ``root/<table>`` with one file per bucket, and of ``root/_layout``, which says how they lie.

    Choose ``buckets`` so that a bucket of the largest table fits a task (some hundred MB). Small tables without a key
    here are written as they are.
    """
    layout = []
    for table, frame in silver.tables().items():
        key = BUCKET_BY.get(table)
        if not key:
            frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{table}")
        elif fullest_bucket(frame, key, buckets) > max(uneven, 1.0) and frame.count() > buckets:
            order = _sorted_by(table)
            frame.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{table}")
        else:
            name = f"writing_{uuid.uuid4().hex}"
            writer = frame.repartition(buckets, key).write.mode("overwrite").option("compression", "zstd").option("path", f"{root}/{table}")
            writer.bucketBy(buckets, key).sortBy(*_sorted_by(table)).saveAsTable(name)
            frame.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay
            layout.append((table, key, buckets))
    spark = frame.sparkSession
    spark.createDataFrame(layout, LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{root}/_layout")


def open_bucketed(spark: SparkSession, root: str, database: str) -> Silver:
    """The stored tables as tables of ``database``, declared anew; tables without buckets are opened as files."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}/_catalog'")
    found = {r.table: r for r in spark.read.schema(LAYOUT).parquet(f"{root}/_layout").collect()}  # at most one row a table
    opened = {}
    for table in TABLES:
        if table in found:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in typed_schema(table))
            r = found[table]
            spark.sql(f"DROP TABLE IF EXISTS {database}.{table}")
            spark.sql(
                f"CREATE TABLE {database}.{table} ({columns}) USING parquet CLUSTERED BY ({r.key}) "
                f"SORTED BY ({', '.join(_sorted_by(table))}) INTO {r.buckets} BUCKETS LOCATION '{root}/{table}'"
            )
            opened[table] = lambda table=table: spark.table(f"{database}.{table}")
        else:
            opened[table] = lambda table=table: spark.read.schema(typed_schema(table)).parquet(f"{root}/{table}")
    return Silver(opened)
