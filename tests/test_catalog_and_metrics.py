import pytest
from conftest import PAYER_A, PAYER_B, PROVIDER, claim, encounter, one, payment, rows

from remitlake.operators import gold, semantic, views
from remitlake.operators.filters import FilterParams, search
from remitlake.sources import catalog, export

YEAR = FilterParams("2024-01-01", "2024-12-31")


def test_seeds(spark, folder):
    sizes = {n: f.count() for n, f in catalog.seed_frames(spark).items()}
    assert sizes == {"kpi_catalog": 23, "semantic_layer": 21, "kg_nodes": 10, "kg_edges": 11}
    for _ in range(2):
        catalog.write_seeds(spark, folder)
    assert spark.read.parquet(f"{folder}/kg_edges").count() == 11


def test_kpi_catalog_order_and_search(spark):
    frame = catalog.kpi_catalog(spark)
    found = rows(frame)
    assert [(r["category"], r["metric_name"]) for r in found] == sorted((r["category"], r["metric_name"]) for r in found)
    assert {r["benchmark"] for r in found if r["metric_name"] == "Denial Reasons"} == {"—"}
    assert {r["metric_name"] for r in rows(search(frame, "DENIAL", category="Segmentation"))} >= {"Denial Rate by Payer"}
    edges = rows(catalog.relationships(spark))
    assert [(e["parent_entity"], e["child_entity"]) for e in edges][:2] == [("claims", "adjustments"), ("claims", "denials")]
    assert rows(catalog.semantic_mapping(spark))[0]["business_concept"] == "A/R Health"


def test_comment_parsing(spark):
    comments = [
        ("v", "denial_rate", "[Quality] Share denied. Formula: a / b * 100. Benchmark: <= 10%."),
        ("v", "no_benchmark", "[Quality] Words. Formula: a / b."),
        ("v", "no_formula", "[Quality] Just words."),
        ("v", "open", "[Broken"),
        ("v", "plain", "Plain text."),
    ]
    found = {r["metric_name"]: r for r in rows(catalog.parse_kpi_comments(
        spark.createDataFrame(comments, "table_name string, column_name string, comment string")))}
    assert set(found) == {"Denial Rate", "No Benchmark", "No Formula", "Open"}
    r = found["Denial Rate"]
    assert (r["category"], r["definition"], r["formula"], r["benchmark"]) == ("Quality", "Share denied", "a / b * 100", "<= 10%")
    assert (found["No Benchmark"]["formula"], found["No Benchmark"]["benchmark"]) == ("a / b", "—")
    assert (found["No Formula"]["definition"], found["No Formula"]["formula"]) == ("Just words.", "")
    assert (found["Open"]["category"], found["Open"]["definition"]) == ("", "[Broken")


def test_column_catalog(spark, make_silver):
    silver = make_silver()
    found = rows(catalog.column_catalog(spark, {"GOLD": gold.load_gold(silver), "SILVER": silver.tables()}))
    assert [r["layer"] for r in found] == sorted((r["layer"] for r in found), key=catalog.LAYERS.index)
    pii = {r["column_name"] for r in found if r["sensitivity"] == "PII"}
    assert pii == {"first_name", "last_name", "date_of_birth", "zip_code", "member_id"}
    assert {r["column_name"] for r in found if r["sensitivity"] == "public"} == {"npi"}
    assert all(r["description"] for r in found)


def test_table_catalog(spark, make_silver):
    for name, table in (("zz_silver", "claims"), ("aa_gold", "monthly")):
        spark.sql(f"create database if not exists {name}")
        make_silver().claims.write.mode("overwrite").saveAsTable(f"{name}.{table}")
    found = rows(catalog.table_catalog(spark, {"GOLD": "aa_gold", "SILVER": "zz_silver"}))
    assert [(r["layer"], r["table_name"]) for r in found] == [("Silver", "claims"), ("Gold", "monthly")]
    assert rows(catalog.database_columns(spark, "zz_silver"))[0]["column_name"] == "claim_id"


def test_insert_absent(spark):
    old = spark.createDataFrame([("a", 1)], "title string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 2)], "title string, n int")
    assert sorted(tuple(r.values()) for r in rows(catalog.insert_absent(old, new, "title"))) == [("a", 1), ("b", 2)]


DATA = dict(
    payers=[PAYER_A, PAYER_B], providers=[PROVIDER], encounters=[encounter(1), encounter(2, department="Skin")],
    patients=[{"patient_id": "p1", "primary_payer_id": "B", "gender": "F"}],
    claims=[claim(1), claim(2, payer_id="B", claim_status="Denied", date_of_service="2024-02-10")],
    payments=[payment(1, "c1", 60.0), payment(2, "c1", 5.0, payer_id="PATIENT"), payment(3, "c2", 1.0, payer_id="B")],
)


def test_paths_and_dimensions(make_silver):
    s = make_silver(**DATA)
    direct = {r["payer_name"]: r["total_payments"] for r in rows(
        semantic.metric_query(s, ["payments.total_payments"], ["payers.payer_name"]))}
    assert direct == {"Alpha": 60.0, "Beta": 1.0, None: 5.0}
    by_claim = {r["payer_name"]: r["total_payments"] for r in rows(
        semantic.metric_query(s, ["payments.total_payments"], ["payers!claims.payer_name"]))}
    assert by_claim == {"Alpha": 65.0, "Beta": 1.0}
    main = one(semantic.metric_query(s, ["encounters.total_encounters"], ["payers!patients.payer_name"]))
    assert main == {"payer_name": "Beta", "total_encounters": 2}
    assert "date_of_service_time" in semantic.dimensions("claims") and "units" not in semantic.dimensions("charges")


def test_several_tables_and_filters(make_silver):
    s = make_silver(**DATA)
    both = {r["department"]: r for r in rows(semantic.metric_query(
        s, ["claims.total_charges", "payments.payment_amount"], ["encounters.department"]))}
    assert both["Heart"] == {"department": "Heart", "total_charges": 100.0, "payment_amount": 65.0}
    kept = one(semantic.metric_query(
        s, ["claims.total_claims"], ["claims.date_of_service_time@month=m"], [("claims.claim_status", "!=", "Paid")]))
    assert kept == {"m": "2024-02", "total_claims": 1}
    assert one(semantic.metric_query(
        s, ["claims.total_claims"], [], [("claims.date_of_service_time", "between", ("2024-01-01", "2024-01-31"))]
    ))["total_claims"] == 1


def test_unknown_names(make_silver):
    with pytest.raises(ValueError, match="Unknown metric"):
        semantic.metric_query(make_silver(), ["claims.nothing"])
    with pytest.raises(ValueError, match="No many-to-one path"):
        semantic.join_path("payers", "claims")


def test_exports(spark, make_silver, folder):
    s = make_silver(**DATA)
    sets = views.export_sets(s, YEAR, payer_id="A", department="Heart")
    assert len(sets) == 12
    small = {k: sets[k] for k in ("payer_analysis", "ar_aging_cashflow", "payer_drilldown_A")}
    folders = export.write_sets(small, folder)
    assert f"{folder}/payer_analysis/Payer_Mix" in folders
    back = spark.read.option("header", True).csv(f"{folder}/payer_analysis/Payer_Mix")
    assert back.count() == 2 and "collection_rate" in back.columns
    assert rows(views.aging_detail(s, YEAR))[4]["total_ar"].startswith("$")
    with pytest.raises(ValueError):
        views.detail_table(s, YEAR, "nothing")
