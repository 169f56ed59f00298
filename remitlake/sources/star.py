"""The ten claim tables derived from a TPC-H-like star (orders as claims, line items as payments).

Used to run every operator on given data of any size. Joins are on the text keys of the
result, so that the operators downstream find the rows already partitioned by them. Each
table is put together only when an operator uses it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlake.session import set_partitions_for
from remitlake.sources.schemas import TABLES
from remitlake.sources.silver import Silver

# Declared, so that opening a table needs no job to read its footers.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}

LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
DEPARTMENT = "concat('DEPT_', s_nationkey % 10)"


#: The tables that grow; how many partitions shuffles get follows their size.
LARGE = ("orders", "lineitem")


def large_paths(root: str) -> list[str]:
    return [f"{root}/{t}.parquet" for t in LARGE]


def star_silver(spark: SparkSession, root: str) -> Silver:
    set_partitions_for(spark, large_paths(root))

    @cache
    def read(name: str) -> DataFrame:
        return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{root}/{name}.parquet")

    def payers() -> DataFrame:
        return read("nation").join(read("region"), F.expr("n_regionkey = r_regionkey")).selectExpr(
            "cast(n_nationkey as string) as payer_id",
            "n_name as payer_name",
            "case r_name when 'AFRICA' then 'Government' when 'MIDDLE EAST' then 'Self-Pay' else 'Commercial' end "
            "as payer_type",
            "0.70D + n_nationkey % 20 / 100.0D as avg_reimbursement_pct",
            "concat('CON-', n_nationkey) as contract_id",
        )

    def patients() -> DataFrame:
        return read("customer").selectExpr(
            "cast(c_custkey as string) as patient_id",
            "c_name as first_name",
            "c_name as last_name",
            "cast(null as string) as date_of_birth",
            "if(c_custkey % 2 = 0, 'M', 'F') as gender",
            "cast(c_nationkey as string) as primary_payer_id",
            "concat('MEM', c_custkey) as member_id",
            "cast(c_custkey % 90000 + 10000 as string) as zip_code",
        )

    def providers() -> DataFrame:
        return read("supplier").selectExpr(
            "cast(s_suppkey as string) as provider_id",
            "s_name as provider_name",
            "cast(1000000000 + s_suppkey as string) as npi",
            f"{DEPARTMENT} as department",
            f"{DEPARTMENT} as specialty",
        )

    def encounters() -> DataFrame:
        first_supplier = read("lineitem").groupBy(F.expr("cast(l_orderkey as string)").alias("encounter_id")).agg(
            F.min("l_suppkey").alias("s_suppkey")
        )
        visits = read("orders").selectExpr(
            "cast(o_orderkey as string) as encounter_id",
            "cast(o_custkey as string) as patient_id",
            "cast(cast(o_orderdate as date) as string) as date_of_service",
            "cast(date_add(cast(o_orderdate as date), cast(o_orderkey % 6 as int)) as string) as discharge_date",
            "o_orderpriority as encounter_type",
        )
        suppliers = read("supplier").select("s_suppkey", "s_nationkey")
        return visits.join(first_supplier, "encounter_id", "left").join(suppliers, "s_suppkey", "left").selectExpr(
            "encounter_id", "patient_id", "cast(s_suppkey as string) as provider_id", "date_of_service",
            "discharge_date", "encounter_type", f"{DEPARTMENT} as department",
        )

    def charges() -> DataFrame:
        dated = read("lineitem").join(read("orders"), F.expr("l_orderkey = o_orderkey"))
        return dated.join(read("part"), F.expr("l_partkey = p_partkey")).selectExpr(
            f"{LINE_ID} as charge_id",
            "cast(l_orderkey as string) as encounter_id",
            "p_brand as cpt_code",
            "concat('Procedure ', p_brand) as cpt_description",
            "cast(l_quantity as int) as units",
            "l_extendedprice as charge_amount",
            "cast(cast(o_orderdate as date) as string) as service_date",
            "cast(date_add(cast(o_orderdate as date), l_linenumber - 1 + if(l_returnflag = 'R', 14, 0)) as string) "
            "as post_date",
            "cast(null as string) as icd10_code",
        )

    @cache
    def claims() -> DataFrame:
        patients_of = read("customer").select("c_custkey", "c_nationkey")
        billed = read("orders").filter("o_orderkey % 15 <> 0").join(patients_of, F.expr("o_custkey = c_custkey"))
        share, dirt = "(o_orderkey * 37) % 100", "(o_orderkey * 53) % 100"
        return billed.selectExpr(
            "cast(o_orderkey as string) as claim_id",
            "cast(o_orderkey as string) as encounter_id",
            "cast(o_custkey as string) as patient_id",
            "cast(c_nationkey as string) as payer_id",
            "cast(cast(o_orderdate as date) as string) as date_of_service",
            "cast(date_add(cast(o_orderdate as date), cast(o_orderkey % 46 as int)) as string) as submission_date",
            "o_totalprice as total_charge_amount",
            f"case when {share} < 68 then 'Paid' when {share} < 76 then 'Denied' when {share} < 84 then 'Pending' "
            f"when {share} < 96 then 'Partially Paid' else 'Appealed' end as claim_status",
            f"if({dirt} < 88, 1, 0) as is_clean_claim",
            "'Electronic' as submission_method",
            f"case when {dirt} < 88 then null else case o_orderkey % 6 when 0 then 'MISSING_AUTH' "
            "when 1 then 'ELIGIBILITY_FAIL' when 2 then 'CODING_ERROR' when 3 then 'DUPLICATE_SUBMISSION' "
            "when 4 then 'TIMELY_FILING' else 'MISSING_INFO' end end as fail_reason",
        )

    def payments() -> DataFrame:
        paid = claims().filter("claim_status in ('Paid', 'Partially Paid', 'Appealed')").select(
            "claim_id", "payer_id", "total_charge_amount", "submission_date"
        )
        lines = read("lineitem").filter("l_linestatus = 'F'").withColumn("claim_id", F.expr("cast(l_orderkey as string)"))
        return lines.join(paid, "claim_id").selectExpr(
            f"{LINE_ID} as payment_id",
            "claim_id",
            "if(l_linenumber = 7, 'PATIENT', payer_id) as payer_id",
            "total_charge_amount * (0.30D + 2 * l_discount) as payment_amount",
            "total_charge_amount * (0.28D + 2 * l_discount + l_tax) as allowed_amount",
            "cast(date_add(cast(submission_date as date), cast(14 + l_quantity as int)) as string) as payment_date",
            "if(l_linenumber = 7, 'Cash', 'EFT') as payment_method",
            "if(l_tax > 0.005D, 1, 0) as is_accurate_payment",
        )

    def denials() -> DataFrame:
        n = "cast(claim_id as bigint)"
        refused = claims().filter(
            f"claim_status in ('Denied', 'Appealed') or (claim_status = 'Partially Paid' and {n} % 4 = 0)"
        )
        return refused.selectExpr(
            "concat('DEN', claim_id) as denial_id",
            "claim_id",
            f"case {n} % 7 when 0 then 'AUTH' when 1 then 'DUP' when 2 then 'ELIG' when 3 then 'COD' when 4 then 'TMF' "
            "when 5 then 'MED' else 'INFO' end as denial_reason_code",
            f"case {n} % 7 when 0 then 'Prior Authorization Required' when 1 then 'Duplicate Claim' "
            "when 2 then 'Patient Not Eligible' when 3 then 'Coding Error' when 4 then 'Timely Filing Limit Exceeded' "
            "when 5 then 'Medical Necessity Not Met' else 'Missing/Invalid Information' end as denial_reason_description",
            "cast(date_add(cast(submission_date as date), 10) as string) as denial_date",
            "total_charge_amount * 0.6D as denied_amount",
            f"case when {n} % 11 < 5 then 'Not Appealed' when {n} % 11 < 7 then 'Won' when {n} % 11 < 9 then 'Lost' "
            "else 'In Progress' end as appeal_status",
            f"if({n} % 11 < 5, null, cast(date_add(cast(submission_date as date), 25) as string)) as appeal_date",
            f"if({n} % 11 in (5, 6), total_charge_amount * 0.45D, 0.0D) as recovered_amount",
        )

    def adjustments() -> DataFrame:
        n = "cast(claim_id as bigint)"
        return claims().filter(f"{n} % 5 = 1").selectExpr(
            "concat('ADJ', claim_id) as adjustment_id",
            "claim_id",
            f"case when {n} % 13 < 6 then 'CONTRACTUAL' when {n} % 13 < 9 then 'WRITEOFF' when {n} % 13 < 10 then 'CHARITY' "
            f"when {n} % 13 < 11 then 'ADMIN' when {n} % 13 < 12 then 'PROMPT_PAY' else 'SMALL_BAL' end "
            "as adjustment_type_code",
            "'Adjustment' as adjustment_type_description",
            "total_charge_amount * 0.2D as adjustment_amount",
            "cast(date_add(cast(submission_date as date), 30) as string) as adjustment_date",
        )

    def operating_costs() -> DataFrame:
        months = read("orders").groupBy(F.expr("date_format(o_orderdate, 'yyyy-MM')").alias("period"))
        return months.agg(F.sum("o_totalprice").alias("t")).selectExpr(
            "period", "t * 0.0325D as billing_staff_cost", "t * 0.01D as software_cost", "t * 0.005D as outsourcing_cost",
            "t * 0.0025D as supplies_overhead", "t * 0.05D as total_rcm_cost",
        )

    return Silver({
        "payers": payers, "patients": patients, "providers": providers, "encounters": encounters,
        "charges": charges, "claims": claims, "payments": payments, "denials": denials,
        "adjustments": adjustments, "operating_costs": operating_costs,
    })


# Blemishes of raw files, as expressions over the all-text copy of a table.
_BLEMISHES = {
    "payers": {"avg_reimbursement_pct": "if(payer_id = '7', 'n/a', avg_reimbursement_pct)"},
    "charges": {
        "units": "if(units = '13', '', units)",
        "charge_id": "if(post_date <> service_date and units = '50', '', charge_id)",
    },
    "claims": {
        "is_clean_claim": "case when claim_id % 3 = 0 then if(is_clean_claim = '1', ' true ', 'False') "
        "when claim_id % 3 = 1 then if(is_clean_claim = '1', 'YES', 'no') else if(is_clean_claim = '1', '1', null) end",
        "fail_reason": "if(fail_reason is null and claim_id % 2 = 0, '  ', fail_reason)",
    },
    "payments": {"is_accurate_payment": "if(is_accurate_payment = '1', 'True', '0')"},
    "denials": {
        "recovered_amount": "case when recovered_amount = '0.0' then if(claim_id % 2 = 0, '', null) "
        "when denial_reason_code = 'DUP' then 'pending' else recovered_amount end",
    },
}


def star_raw(silver: Silver, table: str) -> DataFrame:
    """All-text copy of a table with such blemishes, as input for the typing step."""
    text = getattr(silver, table).selectExpr(*[f"cast({c} as string) as {c}" for c, _ in TABLES[table]])
    marks = _BLEMISHES.get(table, {})
    return text.selectExpr(*[f"{marks[c]} as {c}" if c in marks else c for c, _ in TABLES[table]])
