"""Text search by an index of short character runs, with the same rows as ``filters.search``.

Every row's searched text is listed under each of its runs of one, two and three characters, sorted by run. A text is looked
up by its runs of three (by itself if it is shorter): rows that have all of them are candidates, and only these are read
from the table, which is stored by key, and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.operators.filters import search, searched

#: With at most so many candidates, their keys are a filter that reaches the scan; with more they are joined.
PUSHED = 1000


def grams(text: Column, n: int) -> Column:
    """The different runs of ``n`` characters."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def write_indexed(frame: DataFrame, root: str, key: str) -> None:
    """Store ``frame`` by ``key`` and the index of its rows. Rows without a key are stored but not listed."""
    frame.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{root}/rows")
    text = searched(frame)
    runs = F.concat(*[grams(text, n) for n in (1, 2, 3)])
    listed = frame.filter(F.col(key).isNotNull()).select(F.explode(runs).alias("gram"), F.col(key).alias("key")).distinct()
    listed.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{root}/grams")


def candidates(spark: SparkSession, root: str, text: str) -> DataFrame:
    """Keys of the rows that hold every run of ``text``, which is in lower case."""
    runs = sorted({text[i : i + 3] for i in range(len(text) - 2)}) or [text]
    listed = spark.read.parquet(f"{root}/grams").filter(F.col("gram").isin(runs))
    return listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(runs)).select("key")


def indexed_search(spark: SparkSession, root: str, key: str, text: str = "", **equal: str) -> DataFrame:
    """The rows that ``filters.search`` finds in the stored table."""
    rows = spark.read.parquet(f"{root}/rows")
    if not text:
        return search(rows, text, **equal)
    found = candidates(spark, root, text.lower())
    few = [r[0] for r in found.limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:
        rows = rows.filter(F.col(key).isNull() | F.col(key).isin(few))
    else:
        rows = rows.filter(F.col(key).isNull()).unionByName(rows.join(found.withColumnRenamed("key", key), key, "left_semi").select(*rows.columns))
    return search(rows, text, **equal)
