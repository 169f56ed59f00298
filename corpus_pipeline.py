"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's
``docs``. All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.llm.common import bounded, stored
from remitlake.llm.minhash import near_duplicates
from remitlake.llm.packing import pack
from remitlake.llm.pii import sanitised
from remitlake.llm.quality import keep_good
from remitlake.llm.substring_dedup import substring_dedup


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, null last. Rows are compared by a stored
    number of their own, so rows that repeat an id and rows without id are documents like all others."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("node"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")
    found = near_duplicates(rows.select("node", F.col("row.text").alias("text")), "node")
    ids = rows.select("node", F.col("row.doc_id").alias("id"))
    found = stored(found.join(ids, "node").select("node", "component_id", "id"), "groups")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    stay = found.groupBy("component_id").agg(first.alias("first")).select("first.node")
    gone = stored(found.join(stay, "node", "left_anti").select("node"), "gone")
    return rows.join(bounded(gone, 16 * gone.count()), "node", "left_anti").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without words in 35-word windows that occur elsewhere; null texts stay null."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.col("text").isNull().alias("_null"), *[F.col(f"`{c}`") for c in others])
    cut = substring_dedup(docs.select("doc_id", "text", row.alias("_row")), columns=("_row",))
    text = F.when(~F.col("_row._null"), F.col("kept"))

    def column(name: str) -> Column:
        return text.alias(name) if name == "text" else F.col(f"_row.`{name}`")

    return _measured(cut.select(*[column(c) for c in docs.columns]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with personal data replaced by its kind, and terms that reveal it generalised or removed."""
    return _measured(sanitised(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in training sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("minhash_near_duplicates", near_duplicate),
    ("substring_dedup", repeated_passages),
    ("personal_data", personal_data),
    ("best_fit_packing", packing),
]

#: The stages hold an estimation, a graph iteration and a tokenizer, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
