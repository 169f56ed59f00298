"""Catalog of tables, columns and measures, with descriptions and sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlake.functions import metadata_values as values
from remitlake.sources.schemas import SENSITIVITY

LAYERS = ("BRONZE", "SILVER", "GOLD", "METADATA")
NO_VALUE = "—"

DESCRIPTIONS = {
    "payer_id": "Payer key", "payer_name": "Name of the insurer", "payer_type": "Commercial, Government or Self-Pay",
    "avg_reimbursement_pct": "Contracted mean reimbursement share", "contract_id": "Payer contract on file",
    "patient_id": "Patient key", "first_name": "Given name", "last_name": "Family name",
    "date_of_birth": "Birth date, ISO text", "gender": "M or F", "primary_payer_id": "The patient's main payer",
    "member_id": "Member number at the payer", "zip_code": "Postal code",
    "provider_id": "Provider key", "provider_name": "Name of the clinician", "npi": "National provider number",
    "department": "Clinical department", "specialty": "Medical specialty",
    "encounter_id": "Encounter key", "date_of_service": "Service date, ISO text",
    "discharge_date": "End of stay, ISO text", "encounter_type": "Outpatient, Inpatient, Emergency or Telehealth",
    "charge_id": "Charge line key", "cpt_code": "Procedure code", "cpt_description": "Procedure name",
    "units": "Units billed", "charge_amount": "Line amount in USD", "service_date": "Service date, ISO text",
    "post_date": "Posting date, ISO text", "icd10_code": "Diagnosis code",
    "claim_id": "Claim key", "submission_date": "Date sent to the payer, ISO text",
    "total_charge_amount": "Billed amount in USD", "claim_status": "State of the claim",
    "is_clean_claim": "1 if accepted without edits", "submission_method": "How the claim was sent",
    "fail_reason": "Scrubbing failure of a claim that is not clean",
    "payment_id": "Payment key", "payment_amount": "Amount received in USD",
    "allowed_amount": "Contracted amount in USD", "payment_date": "Date received, ISO text",
    "payment_method": "How it was paid", "is_accurate_payment": "1 if paid as contracted",
    "denial_id": "Denial key", "denial_reason_code": "Reason code", "denial_reason_description": "Reason text",
    "denial_date": "Date of the denial, ISO text", "denied_amount": "Amount denied in USD",
    "appeal_status": "Outcome of the appeal", "appeal_date": "Date of the appeal, ISO text",
    "recovered_amount": "Amount won back in USD",
    "adjustment_id": "Adjustment key", "adjustment_type_code": "Kind of adjustment",
    "adjustment_type_description": "Name of the kind", "adjustment_amount": "Adjusted amount in USD",
    "adjustment_date": "Date of the adjustment, ISO text",
    "period": "Month as yyyy-MM", "billing_staff_cost": "Staff cost in USD", "software_cost": "Software cost in USD",
    "outsourcing_cost": "Cost of outside billing in USD", "supplies_overhead": "Supplies and overhead in USD",
    "total_rcm_cost": "All costs of the month in USD", "_loaded_at": "When the row was loaded",
}


# ------------------------------------------------------------------ descriptions on schemas

def described(df: DataFrame, table: str, layer: str = "SILVER") -> DataFrame:
    """The frame with comment, layer, domain and sensitivity attached to its columns."""
    comments = {c: text for view, c, text in values.GOLD_COMMENTS if view == table} if layer == "GOLD" else DESCRIPTIONS
    tagged = {} if layer == "GOLD" else SENSITIVITY.get(table, {})
    tagged = {} if (layer, table) == ("BRONZE", "providers") else tagged
    for c in df.columns:
        meta = {"comment": comments.get(c, ""), "data_layer": layer.lower(), "data_domain": table}
        if c in tagged:
            meta["sensitivity"] = tagged[c]
        df = df.withMetadata(c, meta)
    return df


def column_catalog(spark: SparkSession, layers: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Columns of described frames (layer -> table -> frame), by layer, table and position."""
    rows = [
        (
            layer, table, i, f.name, f.dataType.simpleString(), f.metadata.get("comment", ""),
            f.metadata.get("sensitivity"),
        )
        for layer, frames in layers.items()
        for table, frame in frames.items()
        for i, f in enumerate(described(frame, table, layer).schema.fields, 1)
    ]
    schema = (
        "layer string, table_name string, position int, column_name string, data_type string, "
        "description string, sensitivity string"
    )
    return spark.createDataFrame(rows, schema).orderBy(layer_rank("layer"), "table_name", "position")


def layer_rank(c: str) -> Column:
    chain = None
    for i, layer in enumerate(LAYERS, 1):
        hit = F.upper(F.col(c)) == layer
        chain = F.when(hit, i) if chain is None else chain.when(hit, i)
    return chain


def _tables(spark: SparkSession, database: str) -> list:
    """Tables and views of a database; the session's temporary views belong to none."""
    return [t for t in spark.catalog.listTables(database) if not t.isTemporary]


def table_catalog(spark: SparkSession, databases: dict[str, str]) -> DataFrame:
    """Tables of the catalog databases that hold the layers (layer -> database)."""
    rows = [
        (layer.upper(), t.name, t.tableType, t.description or "")
        for layer, database in databases.items()
        for t in _tables(spark, database)
    ]
    schema = "table_schema string, table_name string, table_type string, comment string"
    frame = spark.createDataFrame(rows, schema)
    return frame.orderBy(layer_rank("table_schema"), "table_name").select(
        F.initcap(F.lower("table_schema")).alias("layer"), "table_name", "table_type", "comment"
    )


def database_columns(spark: SparkSession, database: str) -> DataFrame:
    """Columns of every table of one catalog database, by table and position."""
    rows = [
        (t.name, i, c.name, c.dataType, c.description or "")
        for t in _tables(spark, database)
        for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"), 1)
    ]
    schema = "table_name string, position int, column_name string, data_type string, description string"
    return spark.createDataFrame(rows, schema).orderBy("table_name", "position").drop("position")


# ------------------------------------------------------------------ seeded metadata

_SEEDS = {
    "kpi_catalog": (values.KPI_CATALOG, "metric_name category definition formula data_sources dashboard_tab benchmark"),
    "semantic_layer": (values.CONCEPTS, "business_concept kpi_name silver_columns formula business_rule"),
    "kg_nodes": (values.ENTITIES, "entity_id entity_name entity_group silver_table description source_system"),
    "kg_edges": (values.EDGES, "parent_entity child_entity join_column cardinality business_meaning"),
}


def seed_frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The four metadata tables."""
    return {
        name: spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in columns.split()]))
        for name, (rows, columns) in _SEEDS.items()
    }


def write_seeds(spark: SparkSession, root: str) -> None:
    """Replace the seeded tables; running it again changes nothing."""
    for name, frame in seed_frames(spark).items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")


def insert_absent(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Existing rows plus those whose key is new."""
    return existing.unionByName(rows.join(existing, key, "left_anti").select(*existing.columns))


def kpi_catalog(spark: SparkSession) -> DataFrame:
    """Measures by category and name, a dash where there is no benchmark."""
    frame = seed_frames(spark)["kpi_catalog"]
    return frame.select(
        "metric_name", "category", "definition", "formula", F.coalesce("benchmark", F.lit(NO_VALUE)).alias("benchmark")
    ).orderBy("category", "metric_name")


def relationships(spark: SparkSession) -> DataFrame:
    return seed_frames(spark)["kg_edges"].orderBy("parent_entity", "child_entity")


def semantic_mapping(spark: SparkSession) -> DataFrame:
    return seed_frames(spark)["semantic_layer"].orderBy("business_concept", "kpi_name")


def gold_comments(spark: SparkSession) -> DataFrame:
    rows = [(view, i, column, text) for i, (view, column, text) in enumerate(values.GOLD_COMMENTS)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, comment string")


def parse_kpi_comments(columns: DataFrame) -> DataFrame:
    """Split ``[Category] Definition. Formula: X. Benchmark: Y.`` comments into columns.

    Input: table_name, column_name, comment. Other comments are ignored.
    """

    def clean(c: Column) -> Column:
        """Without outer blanks and closing full stops."""
        return F.regexp_replace(F.trim(c), r"\.+$", "")

    def before(c: Column, mark: str) -> Column:
        return F.when(F.contains(c, F.lit(mark)), F.substring_index(c, mark, 1))

    def after(c: Column, mark: str) -> Column:
        at = F.locate(mark, c)
        return F.when(at > 0, F.substr(c, at + len(mark)))

    comment = F.col("comment")
    has_category = F.contains(comment, F.lit("]"))
    rest = F.when(has_category, F.trim(after(comment, "]"))).otherwise(comment)
    tagged = columns.filter(F.startswith(comment, F.lit("["))).withColumns({
        "category": F.when(has_category, F.substr(F.substring_index(comment, "]", 1), F.lit(2))).otherwise(""),
        "rest": rest,
    }).withColumn("tail", F.trim(after(F.col("rest"), "Formula:")))
    tail = F.col("tail")
    benchmark = clean(after(tail, "Benchmark:"))
    return tagged.select(
        F.initcap(F.replace(F.col("column_name"), F.lit("_"), F.lit(" "))).alias("metric_name"),
        "category",
        F.coalesce(clean(before(F.col("rest"), "Formula:")), F.col("rest")).alias("definition"),
        F.coalesce(clean(before(tail, "Benchmark:")), F.regexp_replace(tail, r"\.+$", ""), F.lit("")).alias("formula"),
        F.coalesce(F.nullif(benchmark, F.lit("")), F.lit(NO_VALUE)).alias("benchmark"),
        F.col("table_name").alias("gold_view"),
    )
