"""Session settings the library is tested and benchmarked with."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings that matter at scale. Adaptive execution re-plans joins from the
# measured shuffle sizes: it broadcasts a side only when its real size is below the
# threshold, and splits a partition that one hot key has blown up.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins whose build side is small per partition hash it instead of sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # A task holds what it shuffles and sorts: with parts of this size that fits its share of the memory at any input.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
}

# Taken only when a session starts. Column expressions then do not record the Python line they were written on.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def set_scale_conf(spark: SparkSession) -> None:
    """Put the runtime settings on a running session where its owner has not chosen a value."""
    for key, value in SCALE_CONF.items():
        if spark.conf.get(key, None) is None and spark.conf.isModifiable(key):
            spark.conf.set(key, value)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_with_write(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write within go when it is done, not when the driver next collects its garbage. A frame that is
    run again after it shuffles again. A value of the session's owner stays."""
    owned = spark.conf.get(CLEANUP, None) is not None
    if not owned:
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if not owned:
            spark.conf.unset(CLEANUP)


#: Stored bytes of input per shuffle partition: some 180,000 lines of a star, so that a task sorts them without spilling.
INPUT_PER_PARTITION = 4 << 20
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_chosen: dict[str, str] = {}


def stored_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes that lie below the paths; 0 for a path that is not there."""
    total = 0
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        total += files.getContentSummary(where).getLength() if files.exists(where) else 0
    return total


def partitions_for(spark: SparkSession, paths: list[str]) -> int:
    """Partitions that grow with the input, never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(spark, paths) // INPUT_PER_PARTITION))


def set_partitions_for(spark: SparkSession, paths: list[str]) -> None:
    """Let shuffles begin with so many partitions, which adaptive execution merges again where they turn out small. A
    value of the session's owner stays."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(INITIAL, None) in (None, _chosen.get(app)):
        _chosen[app] = str(partitions_for(spark, paths))
        spark.conf.set(INITIAL, _chosen[app])


def local_session(cores: int | None = None, app: str = "remitlake", **conf: str) -> SparkSession:
    """Single-JVM session for tests and benchmarks (no web page, no open port)."""
    n = str(cores) if cores else os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.checkpoint.dir", os.environ.get("REMITLAKE_CHECKPOINTS", "/tmp/remitlake-checkpoints"))
        .config("spark.sql.warehouse.dir", os.environ.get("REMITLAKE_WAREHOUSE", "/tmp/remitlake-warehouse"))
    )
    for key, value in {**STATIC_CONF, **SCALE_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
