"""Raw files with every kind of blemish, through the whole pipeline."""

import os

import pytest
from conftest import claim, one, rows

from pyspark.sql import functions as F

from remitlake.sources import ingest
from remitlake.sources.schemas import TABLES, raw_schema
from remitlake.sources.silver import Silver, checked, dashboard_types
from remitlake.streaming.incremental import load_new_files

FILES = {
    "payers": 'payer_id,payer_name,payer_type,avg_reimbursement_pct,contract_id\n'
              'A, "Alpha, Inc." ,Commercial,0.8,K1\nB,Beta,Self-Pay,n/a,NULL\n,Nobody,x,1,y\n"",No,x,1,y\n',
    "patients": "patient_id,first_name,last_name,date_of_birth,gender,primary_payer_id,member_id,zip_code\n"
                "p1,Ann,O'Hara,1980-02-30,F,A,m1,01234\n",
    "providers": "provider_id,provider_name,npi,department,specialty\nd1,\"Dr \"\"X\"\" One\",123,Heart,Heart\n",
    "encounters": "h1,h2,h3,h4,h5,h6,h7\ne1,p1,d1,2024-01-10,,Outpatient,Heart\n",
    "charges": "charge_id,encounter_id,cpt_code,cpt_description,units,charge_amount,service_date,post_date,icd10_code\n"
               "h1,e1,99213,Visit,2.5,10.5,2024-01-10,2024-01-12,X\nh2,e1,99213,Visit,abc,abc,2024-01-10,2024-01-12,X\n"
               "h3,e1\nh4,e1,1,Long,1,1,2024-01-10,2024-01-12,X,extra,more\nh5,e1,1,Neg,-2.5, 7 ,2024-01-10,null,X\n",
    "claims": "claim_id,encounter_id,patient_id,payer_id,date_of_service,submission_date,total_charge_amount,"
              "claim_status,is_clean_claim,submission_method,fail_reason\n"
              + "".join(f"c{i},e1,p1,A,2024-01-10,2024-01-20,100,Paid,{f},Electronic,{r}\n" for i, (f, r) in enumerate([
                  ("TRUE", ""), ("yes", "  "), ("1", "X"), ("0", "MISSING_AUTH"), ("", "null"), ("False", "Y"), (" True ", "")])),
    "payments": "payment_id,claim_id,payer_id,payment_amount,allowed_amount,payment_date,payment_method,is_accurate_payment\n"
                "y1,c0,A,60,70,2024-02-01,EFT,True\ny2,c0,PATIENT,x,70,2024-02-01,Cash,no\n",
    "denials": "denial_id,claim_id,denial_reason_code,denial_reason_description,denial_date,denied_amount,appeal_status,"
               "appeal_date,recovered_amount\nn1,c3,AUTH,Auth,2024-02-01,10,Won,,5\nn2,c3,AUTH,Auth,2024-02-01,10,Lost,,\n"
               "n3,c3,AUTH,Auth,2024-02-01,,Lost,,oops\n",
    "adjustments": "adjustment_id,claim_id,adjustment_type_code,adjustment_type_description,adjustment_amount,adjustment_date\n"
                   "j1,c0,WRITEOFF,Off,3,2024-03-01\n",
    "operating_costs": "period,billing_staff_cost,software_cost,outsourcing_cost,supplies_overhead,total_rcm_cost\n"
                       "2024-01,1,2,3,4,10\n",
}


@pytest.fixture
def source(folder):
    for table, text in FILES.items():
        with open(os.path.join(folder, f"{table}.csv"), "w") as f:
            f.write(text)
    return folder


def test_pipeline(spark, source):
    target = source + "/lake"
    silver = ingest.run_pipeline(spark, source, target)
    payers = {r["payer_id"]: r for r in rows(silver.payers)}
    assert set(payers) == {"A", "B"}
    assert payers["A"]["payer_name"].strip() == "Alpha, Inc." and payers["B"]["avg_reimbursement_pct"] is None
    assert payers["B"]["contract_id"] is None
    assert one(silver.providers)["provider_name"] == 'Dr "X" One'
    assert one(silver.encounters)["discharge_date"] is None
    charges = {r["charge_id"]: r for r in rows(silver.charges)}
    assert [charges[h]["units"] for h in ("h1", "h2", "h3", "h4", "h5")] == [3, None, None, 1, -3]
    assert [charges[h]["charge_amount"] for h in ("h1", "h2", "h3", "h4", "h5")] == [10.5, None, None, 1.0, 7.0]
    assert charges["h5"]["post_date"] is None
    claims = sorted(rows(silver.claims), key=lambda r: r["claim_id"])
    assert [r["is_clean_claim"] for r in claims] == [1, 1, 1, 0, 0, 0, 1]
    assert [r["fail_reason"] for r in claims] == [None, None, "X", "MISSING_AUTH", None, "Y", None]
    payments = {r["payment_id"]: r for r in rows(silver.payments)}
    assert payments["y2"]["payment_amount"] is None and payments["y2"]["is_accurate_payment"] == 0
    assert [r["recovered_amount"] for r in sorted(rows(silver.denials), key=lambda r: r["denial_id"])] == [5.0, 0.0, None]
    bronze = ingest.read_raw(spark, f"{target}/bronze")
    assert bronze["payers"].count() == 4 and "_loaded_at" in bronze["claims"].columns
    log = {r["domain"]: r for r in rows(ingest.read_log(spark, f"{target}/metadata/pipeline_runs"))}
    assert len(log) == 10 and log["claims"]["row_count"] == 7 and log["claims"]["source_file"] == "claims.csv"

    # A second run replaces the rows and the log entries.
    with open(os.path.join(source, "payers.csv"), "a") as f:
        f.write("C,Gamma,Commercial,0.5,K3\n")
    silver = ingest.run_pipeline(spark, source, target)
    assert silver.payers.count() == 3 and silver.claims.count() == 7
    again = {r["domain"]: r for r in rows(ingest.read_log(spark, f"{target}/metadata/pipeline_runs"))}
    assert len(again) == 10 and again["payers"]["row_count"] == 3
    assert again["claims"]["last_loaded_at"] > log["claims"]["last_loaded_at"]


def test_blank_key_that_survived_the_raw_layer_is_dropped(spark):
    raw = spark.createDataFrame([("", "a", "", "", ""), (None, "b", "", "", ""), ("P", "c", "", "", "")], raw_schema("payers"))
    assert [r["payer_id"] for r in rows(ingest.to_typed(raw, "payers"))] == ["P"]


def test_whole_numbers_of_digits_are_cast_without_decimals(spark):
    texts = ["13", "0012", "0", "999999999", "1234567890", "2147483647", "2147483648", "-3", "2.5", "-2.5", " 7 ", "1e2", "12a", "", None, "7\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.round(F.col("t").try_cast("decimal(38,18)"), 0).try_cast("int")
    found = frame.select("t", ingest.whole_number("t").alias("n"), plain.alias("p")).collect()
    assert [r["n"] for r in found] == [r["p"] for r in found] and [r["n"] for r in found][:5] == [13, 12, 0, 999999999, 1234567890]
    assert "RLIKE" in str(ingest.whole_number("t")) or "rlike" in str(ingest.whole_number("t"))


def test_typed_silver_is_lazy_per_table(spark):
    raw = {t: spark.createDataFrame([], raw_schema(t)) for t in TABLES}
    silver = ingest.typed_silver(raw)
    assert silver._opened == {}
    assert silver.claims.count() == 0 and list(silver._opened) == ["claims"]


def test_upsert_log(spark, folder):
    """Rows of the same domain are replaced, others stay, and the log keeps one file per domain."""
    def run(*counts):
        log = spark.createDataFrame(counts, "domain string, row_count long").selectExpr(
            "domain", "timestamp_ntz'2024-01-01' + make_dt_interval(row_count) as last_loaded_at", "row_count", "'f' as source_file"
        )
        ingest.upsert_log(log, f"{folder}/log")

    run(("a", 1), ("b", 1))
    run(("b", 2), ("c", 2))
    assert sorted((r["domain"], r["row_count"]) for r in rows(ingest.read_log(spark, f"{folder}/log"))) == [("a", 1), ("b", 2), ("c", 2)]
    assert len([f for _, _, files in os.walk(f"{folder}/log") for f in files if f.endswith(".parquet")]) == 3


def test_missing_columns_are_named(spark):
    frame = spark.createDataFrame([("x",)], "PAYER_ID string")
    with pytest.raises(ValueError, match=r"'payers'.*\['payer_name', 'payer_type'\]"):
        checked("payers", frame)
    upper = spark.createDataFrame([("x", "y", "z")], "PAYER_ID string, PAYER_NAME string, PAYER_TYPE string")
    assert checked("payers", upper).columns == ["payer_id", "payer_name", "payer_type"]


def test_dashboard_types(make_silver):
    s = dashboard_types(make_silver(
        claims=[claim(1, submission_date="soon", is_clean_claim=0)], operating_costs=[{"period": "2024-03", "total_rcm_cost": 1.0}],
    ))
    r = one(s.claims)
    assert str(r["date_of_service"]) == "2024-01-10" and r["submission_date"] is None and r["is_clean_claim"] is False
    assert str(one(s.operating_costs)["period"]) == "2024-03-01"


def test_dates_must_have_the_full_shape(spark):
    texts = ["2024-01-10", "2024-1-10", "2024-01-1 ", "2024-01-1T", "2024", "2024-02-30", " 2024-01-10", "2024-01-10 ", "", None]
    from remitlake.functions.columns import iso_date, period

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = frame.select(iso_date("t").cast("string").alias("d"), period("t").alias("p")).collect()
    assert [r["d"] for r in found] == ["2024-01-10"] + [None] * 9
    assert [r["p"] for r in found] == ["2024-01"] + [None] * 9
    strict = frame.select(F.try_to_date("t", "yyyy-MM-dd").cast("string").alias("d")).collect()
    assert [r["d"] for r in strict] == [r["d"] for r in found]


def test_incremental_load_takes_every_file_once(spark, folder):
    os.makedirs(f"{folder}/in/payers")
    for name, key in (("one", "A"), ("two", "B")):
        with open(f"{folder}/in/payers/{name}.csv", "w") as f:
            f.write(f"payer_id,payer_name,payer_type,avg_reimbursement_pct,contract_id\n{key}, x ,null,1,\n")
        load_new_files(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", "payers").awaitTermination()
    found = rows(spark.read.parquet(f"{folder}/out/payers").orderBy("payer_id"))
    assert [(r["payer_id"], r["payer_name"], r["payer_type"]) for r in found] == [("A", "x", None), ("B", "x", None)]


def test_silver_from_parquet_reads_only_used_tables(spark, make_silver, folder):
    make_silver(claims=[claim(1)]).claims.write.parquet(f"{folder}/claims")
    assert Silver.from_parquet(spark, folder).claims.count() == 1
