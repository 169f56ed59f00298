"""The ten claim tables over the star schema as SQL text, for checking results with another engine."""

TABLES_SQL = {
    "payers": """
SELECT
  CAST(n_nationkey AS STRING) AS payer_id,
  n_name AS payer_name,
  CASE r_name WHEN 'AFRICA' THEN 'Government' WHEN 'MIDDLE EAST' THEN 'Self-Pay' ELSE 'Commercial' END AS payer_type,
  CAST(0.70 + (n_nationkey % 20) / 100.0 AS DOUBLE) AS avg_reimbursement_pct,
  'CON-' || CAST(n_nationkey AS STRING) AS contract_id
FROM nation
JOIN region ON n_regionkey = r_regionkey
""",
    "patients": """
SELECT
  CAST(c_custkey AS STRING) AS patient_id,
  c_name AS first_name,
  c_name AS last_name,
  CAST(NULL AS STRING) AS date_of_birth,
  CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
  CAST(c_nationkey AS STRING) AS primary_payer_id,
  'MEM' || CAST(c_custkey AS STRING) AS member_id,
  CAST(c_custkey % 90000 + 10000 AS STRING) AS zip_code
FROM customer
""",
    "providers": """
SELECT
  CAST(s_suppkey AS STRING) AS provider_id,
  s_name AS provider_name,
  CAST(1000000000 + s_suppkey AS STRING) AS npi,
  'DEPT_' || CAST(s_nationkey % 10 AS STRING) AS department,
  'DEPT_' || CAST(s_nationkey % 10 AS STRING) AS specialty
FROM supplier
""",
    "encounters": """
SELECT
  CAST(o.o_orderkey AS STRING) AS encounter_id,
  CAST(o.o_custkey AS STRING) AS patient_id,
  CAST(x.provider_id AS STRING) AS provider_id,
  CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS date_of_service,
  CAST(CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 6 AS INT) AS STRING) AS discharge_date,
  o.o_orderpriority AS encounter_type,
  'DEPT_' || CAST(s.s_nationkey % 10 AS STRING) AS department
FROM orders o
LEFT JOIN (SELECT l_orderkey, MIN(l_suppkey) AS provider_id FROM lineitem GROUP BY l_orderkey) x ON o.o_orderkey = x.l_orderkey
LEFT JOIN supplier s ON x.provider_id = s.s_suppkey
""",
    "charges": """
SELECT
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS charge_id,
  CAST(l_orderkey AS STRING) AS encounter_id,
  p_brand AS cpt_code,
  'Procedure ' || p_brand AS cpt_description,
  CAST(l_quantity AS INT) AS units,
  l_extendedprice AS charge_amount,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS service_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(l_linenumber - 1 + CASE WHEN l_returnflag = 'R' THEN 14 ELSE 0 END AS INT) AS STRING) AS post_date,
  CAST(NULL AS STRING) AS icd10_code
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
""",
    "claims": """
SELECT
  CAST(o_orderkey AS STRING) AS claim_id,
  CAST(o_orderkey AS STRING) AS encounter_id,
  CAST(o_custkey AS STRING) AS patient_id,
  CAST(c_nationkey AS STRING) AS payer_id,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_of_service,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 46 AS INT) AS STRING) AS submission_date,
  o_totalprice AS total_charge_amount,
  CASE WHEN (o_orderkey * 37) % 100 < 68 THEN 'Paid' WHEN (o_orderkey * 37) % 100 < 76 THEN 'Denied' WHEN (o_orderkey * 37) % 100 < 84 THEN 'Pending' WHEN (o_orderkey * 37) % 100 < 96 THEN 'Partially Paid' ELSE 'Appealed' END AS claim_status,
  CASE WHEN (o_orderkey * 53) % 100 < 88 THEN 1 ELSE 0 END AS is_clean_claim,
  'Electronic' AS submission_method,
  CASE WHEN (o_orderkey * 53) % 100 < 88 THEN NULL WHEN o_orderkey % 6 = 0 THEN 'MISSING_AUTH' WHEN o_orderkey % 6 = 1 THEN 'ELIGIBILITY_FAIL' WHEN o_orderkey % 6 = 2 THEN 'CODING_ERROR' WHEN o_orderkey % 6 = 3 THEN 'DUPLICATE_SUBMISSION' WHEN o_orderkey % 6 = 4 THEN 'TIMELY_FILING' ELSE 'MISSING_INFO' END AS fail_reason
FROM orders
JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 15 <> 0
""",
    "payments": """
SELECT
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS payment_id,
  c.claim_id,
  CASE WHEN l_linenumber = 7 THEN 'PATIENT' ELSE c.payer_id END AS payer_id,
  c.total_charge_amount * (0.30 + 2 * l_discount) AS payment_amount,
  c.total_charge_amount * (0.28 + 2 * l_discount + l_tax) AS allowed_amount,
  CAST(CAST(c.submission_date AS DATE) + CAST(14 + l_quantity AS INT) AS STRING) AS payment_date,
  CASE WHEN l_linenumber = 7 THEN 'Cash' ELSE 'EFT' END AS payment_method,
  CASE WHEN l_tax > 0.005 THEN 1 ELSE 0 END AS is_accurate_payment
FROM lineitem
JOIN claims c ON CAST(l_orderkey AS STRING) = c.claim_id
WHERE l_linestatus = 'F' AND c.claim_status IN ('Paid', 'Partially Paid', 'Appealed')
""",
    "denials": """
SELECT
  'DEN' || claim_id AS denial_id,
  claim_id,
  CASE CAST(claim_id AS BIGINT) % 7 WHEN 0 THEN 'AUTH' WHEN 1 THEN 'DUP' WHEN 2 THEN 'ELIG' WHEN 3 THEN 'COD' WHEN 4 THEN 'TMF' WHEN 5 THEN 'MED' ELSE 'INFO' END AS denial_reason_code,
  CASE CAST(claim_id AS BIGINT) % 7 WHEN 0 THEN 'Prior Authorization Required' WHEN 1 THEN 'Duplicate Claim' WHEN 2 THEN 'Patient Not Eligible' WHEN 3 THEN 'Coding Error' WHEN 4 THEN 'Timely Filing Limit Exceeded' WHEN 5 THEN 'Medical Necessity Not Met' ELSE 'Missing/Invalid Information' END AS denial_reason_description,
  CAST(CAST(submission_date AS DATE) + 10 AS STRING) AS denial_date,
  total_charge_amount * 0.6 AS denied_amount,
  CASE WHEN CAST(claim_id AS BIGINT) % 11 < 5 THEN 'Not Appealed' WHEN CAST(claim_id AS BIGINT) % 11 < 7 THEN 'Won' WHEN CAST(claim_id AS BIGINT) % 11 < 9 THEN 'Lost' ELSE 'In Progress' END AS appeal_status,
  CASE WHEN CAST(claim_id AS BIGINT) % 11 < 5 THEN NULL ELSE CAST(CAST(submission_date AS DATE) + 25 AS STRING) END AS appeal_date,
  CASE WHEN CAST(claim_id AS BIGINT) % 11 >= 5 AND CAST(claim_id AS BIGINT) % 11 < 7 THEN total_charge_amount * 0.45 ELSE 0.0 END AS recovered_amount
FROM claims
WHERE claim_status IN ('Denied', 'Appealed') OR (claim_status = 'Partially Paid' AND CAST(claim_id AS BIGINT) % 4 = 0)
""",
    "adjustments": """
SELECT
  'ADJ' || claim_id AS adjustment_id,
  claim_id,
  CASE WHEN CAST(claim_id AS BIGINT) % 13 < 6 THEN 'CONTRACTUAL' WHEN CAST(claim_id AS BIGINT) % 13 < 9 THEN 'WRITEOFF' WHEN CAST(claim_id AS BIGINT) % 13 < 10 THEN 'CHARITY' WHEN CAST(claim_id AS BIGINT) % 13 < 11 THEN 'ADMIN' WHEN CAST(claim_id AS BIGINT) % 13 < 12 THEN 'PROMPT_PAY' ELSE 'SMALL_BAL' END AS adjustment_type_code,
  'Adjustment' AS adjustment_type_description,
  total_charge_amount * 0.2 AS adjustment_amount,
  CAST(CAST(submission_date AS DATE) + 30 AS STRING) AS adjustment_date
FROM claims
WHERE CAST(claim_id AS BIGINT) % 5 = 1
""",
    "operating_costs": """
SELECT
  substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS period,
  SUM(o_totalprice) * 0.0325 AS billing_staff_cost,
  SUM(o_totalprice) * 0.01 AS software_cost,
  SUM(o_totalprice) * 0.005 AS outsourcing_cost,
  SUM(o_totalprice) * 0.0025 AS supplies_overhead,
  SUM(o_totalprice) * 0.05 AS total_rcm_cost
FROM orders
GROUP BY substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)
""",
}
