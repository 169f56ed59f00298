"""Shared pieces of the operators: intermediate tables in the shared folder, size-checked joins, hashing of words.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, a folder that all executors and the
driver share, so that a lost executor only costs the tasks that ran on it.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only if its measured size is at most this; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20

_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without that setting, one folder per application."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="llm-")
    return _local_folder[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(side: DataFrame, size: int) -> DataFrame:
    """``side`` marked for broadcast if its measured ``size`` in bytes is within the bound, else as it is."""
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row by its content, so null and repeated ids need no special path: equal rows have equal results."""
    return F.xxhash64(F.col(id_col), whole_text(text_col))


U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(1 << 15, 1 << int(n).bit_length())
        up, down = np.full(size, _BASE, dtype=U64), np.full(size, _INVERSE, dtype=U64)
        up[0] = down[0] = 1
        _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[0]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash, mixed, of every ``width`` consecutive 64-bit values."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=U64)
    up, down = _tables(n + 1)
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[width:] - total[: n + 1 - width]) * down[: n + 1 - width])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))


def spans_union(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over ``n`` places of all that windows of ``width`` at ``starts`` cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every run of consecutive integers in an ascending array without repeats."""
    if not len(sorted_values):
        return sorted_values, sorted_values
    cut = np.flatnonzero(np.diff(sorted_values) != 1)
    return sorted_values[np.r_[0, cut + 1]], sorted_values[np.r_[cut, len(sorted_values) - 1]]
