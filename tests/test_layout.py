"""Tables stored by key: what needs no exchange, what is kept, and what is stored otherwise."""

import re

import pytest
from conftest import claim, encounter, payment

from remitlake.operators import gold, kpis
from remitlake.operators.filters import FilterParams
from remitlake.sources import layout

YEAR = FilterParams("2024-01-01", "2024-12-31")


def silver_of(make_silver, hot=0):
    claims = [claim(i, date_of_service=f"2024-{i % 12 + 1:02}-10") for i in range(60)]
    payments = [payment(i, f"c{i % 60}", 5.0 + i) for i in range(150)] + [payment(1000 + i, "c1", 0.5) for i in range(hot)]
    return make_silver(
        claims=claims, encounters=[encounter(i) for i in range(60)], payments=payments,
        adjustments=[{"adjustment_id": f"a{i}", "claim_id": f"c{i}", "adjustment_type_code": "WRITEOFF", "adjustment_amount": 1.0} for i in range(9)],
        denials=[{"denial_id": f"n{i}", "claim_id": f"c{i}", "denied_amount": 2.0, "appeal_status": "Won"} for i in range(7)],
        charges=[{"charge_id": f"h{i}", "encounter_id": f"e{i % 60}", "charge_amount": 3.0, "units": 1} for i in range(99)],
    )


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


PER_CLAIM = {
    "days_in_ar": lambda s: kpis.days_in_ar_trend(s, YEAR),
    "ar_aging": lambda s: kpis.ar_aging(s, YEAR),
    "net_collection": lambda s: kpis.net_collection_rate_trend(s, YEAR),
    "core": lambda s: kpis.core_kpis(s, YEAR),
    "payer_mix": lambda s: kpis.payer_mix(s, YEAR),
    "gold_ar": lambda s: gold.load_gold(s, "2024-12-31")["ar_aging"],
}


def exchanged(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", PER_CLAIM)
def test_no_exchange_per_claim(spark, make_silver, folder, no_broadcast, name):
    silver = silver_of(make_silver)
    layout.write_bucketed(silver, folder, 4)
    stored = layout.open_bucketed(spark, folder, f"t_{folder.rsplit('-', 1)[-1]}")
    found = PER_CLAIM[name](stored)
    assert not [e for e in exchanged(found) if e.startswith("claim_id")]
    assert [e for e in exchanged(PER_CLAIM[name](silver)) if e.startswith("claim_id")]
    assert sorted(map(str, found.collect())) == sorted(map(str, PER_CLAIM[name](silver).collect()))


def test_encounters_and_charges_meet_in_buckets(spark, make_silver, folder, no_broadcast):
    layout.write_bucketed(silver_of(make_silver), folder, 4)
    stored = layout.open_bucketed(spark, folder, f"t_{folder.rsplit('-', 1)[-1]}")
    joined = stored.charges.groupBy("encounter_id").count().join(stored.encounters, "encounter_id")
    assert exchanged(joined) == [] and joined.count() == 60


def test_files_are_those_of_the_plain_layout_and_sorted_by_date(spark, make_silver, folder):
    from remitlake.sources.silver import Silver

    silver = silver_of(make_silver)
    layout.write_bucketed(silver, folder, 4)
    plain = Silver.from_parquet(spark, folder)
    for table in ("claims", "payments", "charges", "payers"):
        assert sorted(map(str, getattr(plain, table).collect())) == sorted(map(str, getattr(silver, table).collect()))
    files = {}
    for r in plain.claims.selectExpr("_metadata.file_name f", "date_of_service d").collect():
        files.setdefault(r.f, []).append(r.d)
    assert 1 < len(files) <= 4 and all(d == sorted(d) for d in files.values())


def test_hot_claim_is_stored_without_buckets(spark, make_silver, folder):
    silver = silver_of(make_silver, hot=600)
    assert layout.fullest_bucket(silver.payments, "claim_id", 4) > 2.0
    layout.write_bucketed(silver, folder, 4, uneven=2.0)
    assert {r.table for r in spark.read.parquet(f"{folder}/_layout").collect()} == set(layout.BUCKET_BY) - {"payments"}
    stored = layout.open_bucketed(spark, folder, f"t_{folder.rsplit('-', 1)[-1]}")
    assert stored.payments.count() == 750
    for build in PER_CLAIM.values():
        assert sorted(map(str, build(stored).collect())) == sorted(map(str, build(silver).collect()))


def test_a_second_write_replaces_the_first(spark, make_silver, folder):
    layout.write_bucketed(silver_of(make_silver), folder, 4)
    layout.write_bucketed(make_silver(claims=[claim(1)]), folder, 2)
    stored = layout.open_bucketed(spark, folder, f"t_{folder.rsplit('-', 1)[-1]}")
    assert stored.claims.count() == 1 and stored.payments.count() == 0


def test_stored_tables_are_zstd_and_tasks_small(spark, make_silver, folder):
    """What a task shuffles and sorts follows these sizes; a value of the session's owner stays."""
    import os

    from remitlake.session import set_scale_conf

    layout.write_bucketed(silver_of(make_silver), folder, 4)
    names = [n for t in ("claims", "charges", "payers") for n in os.listdir(f"{folder}/{t}") if n.startswith("part-")]
    assert names and all(".zstd." in n for n in names)
    own, other = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    session = spark.newSession()
    session.conf.set(own, "7m")
    set_scale_conf(session)
    assert (session.conf.get(own), session.conf.get(other)) == ("7m", "16m")
