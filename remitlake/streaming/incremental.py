"""Incremental forms of the load: only files that have not been loaded yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from remitlake.sources.ingest import log_row, null_texts, parsed, to_typed, upsert_log
from remitlake.sources.records import drop_folder, numbered_lines, work_folder
from remitlake.sources.schemas import raw_schema, typed_schema


def load_new_files(spark: SparkSession, source: str, target: str, state: str, table: str) -> StreamingQuery:
    """Append the new ``source/<table>/*.csv`` files to ``target/<table>`` and stop.

    The same reading rules as the full reload. ``state`` must lie on storage that all
    executors share: it records the files already taken, so that a run that is cut short
    and started again loads every file exactly once.
    """
    files = (
        spark.readStream.schema(raw_schema(table))
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(f"{source}/{table}")
    )
    return (
        null_texts(files)
        .withColumn("_loaded_at", F.current_timestamp())
        .writeStream.format("parquet")
        .option("path", f"{target}/{table}")
        .option("checkpointLocation", f"{state}/{table}")
        .trigger(availableNow=True)
        .start()
    )


def load_new_files_typed(
    spark: SparkSession, source: str, target: str, state: str, table: str, files_per_batch: int = 1000,
    after_raw: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Take the new ``source/<table>/*.csv`` files through the raw and the typed layer to the load log, and stop.

    Same rules as the full reload, line breaks inside quotes included. Every batch of files has a number that a restart
    repeats, and writes the folder of its number in either layer, ``target/{bronze,silver}/<table>/batch=<number>``: a batch
    that was cut short anywhere and runs again replaces what it had written, so each file counts once. ``state`` must lie
    on storage that all executors share and belongs to ``target``: with a new state, numbers begin again. ``after_raw`` is
    called between the layers.
    """

    def load(batch: DataFrame, number: int) -> None:
        raw, typed = (f"{target}/{layer}/{table}" for layer in ("bronze", "silver"))
        scratch = work_folder(f"{state}/{table}")
        session = batch.sparkSession
        try:
            numbered_lines(batch).write.parquet(f"{scratch}/lines")
            rows = parsed(session.read.parquet(f"{scratch}/lines"), table, scratch)
            rows.withColumn("_loaded_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{raw}/batch={number}")
        finally:
            drop_folder(session, scratch)
        if after_raw:
            after_raw(number)
        rows = session.read.schema(raw_schema(table)).parquet(f"{raw}/batch={number}")
        to_typed(rows, table).write.mode("overwrite").parquet(f"{typed}/batch={number}")
        stored = session.read.schema(typed_schema(table)).parquet(typed)
        upsert_log(log_row(stored, table), f"{target}/metadata/pipeline_runs")

    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(f"{source}/{table}").select("value", "_metadata")
    return (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", f"{state}/{table}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
