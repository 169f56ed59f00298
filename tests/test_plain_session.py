"""The registered queries in a session that the library did not build."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", sys.argv[2] + "/checkpoints").config("spark.sql.warehouse.dir", sys.argv[2] + "/warehouse")
    .config("spark.sql.shuffle.partitions", "4").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry

queries = entry.queries()
for name in sys.argv[3:]:
    rows = queries[name](spark, "/root/testdata/sf0.001").collect()
    print("ran", name, len(rows))
print("ran entry", len(entry.entry(spark).collect()))
"""

FAMILIES = [
    "kpi_payer_mix", "gold_monthly_kpis", "proc_all", "diag_silver_counts", "dq_all", "view_kpi_alerts", "ts_what_if",
    "metric_claims", "etl_claims", "etl_files_payers", "lake_kpi_core_kpis", "loader_claims", "export_payer_analysis_payer_mix",
]


def test_one_query_of_each_family():
    """A running session refuses static settings; none may be asked of it."""
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, ROOT, scratch, *FAMILIES], capture_output=True, text=True, timeout=900, check=False,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran")] == [*FAMILIES, "entry"]
