"""Changed rows: views from retracted sums against views computed anew, and which files a change writes."""

import os
import random

import pytest
from conftest import PAYER_A, PAYER_B, claim, encounter, payment

from remitlake.operators import gold
from remitlake.operators.summaries import Summaries
from remitlake.sources import changes as ch
from remitlake.sources.schemas import typed_schema, TABLES

AS_OF = "2024-12-31"
R = random.Random(7)


def table(spark, name, rows):
    return spark.createDataFrame([tuple(r.get(c) for c, _ in TABLES[name]) for r in rows], typed_schema(name))


def charge(i, e, amount=1.1):
    return {"charge_id": f"h{i}", "encounter_id": e, "charge_amount": amount, "units": 1, "service_date": f"2024-{i % 12 + 1:02}-03"}


def denial(i, c, **more):
    return {"denial_id": f"n{i}", "claim_id": c, "denial_reason_code": "AD"[i % 2], "denial_reason_description": "x",
            "denied_amount": None if i % 5 == 0 else 0.7 * i, "appeal_status": "Won" if i % 3 else "Lost", "recovered_amount": 0.1} | more


def silver_of(make_silver):
    return make_silver(
        payers=[PAYER_A, PAYER_B],
        claims=[claim(i, payer_id="AB"[i % 2], date_of_service=f"2024-{i % 12 + 1:02}-10", total_charge_amount=0.1 * i,
                      claim_status=("Paid", "Denied", "Pending")[i % 3], is_clean_claim=i % 2, encounter_id=f"e{i % 20}") for i in range(120)],
        encounters=[encounter(i, department=("Heart", "Skin", None)[i % 3]) for i in range(22)],
        payments=[payment(i, f"c{R.randrange(100)}", 0.1 * i) for i in range(200)],
        charges=[charge(i, f"e{i % 21}") for i in range(60)], denials=[denial(i, f"c{i}") for i in range(30)],
    )


def rounds(spark):
    """Rows that change, move, appear and go, in every table."""
    yield ch.Changes(
        {"claims": table(spark, "claims", [
            claim(3, payer_id="B", claim_status="Denied", date_of_service="2023-02-01", encounter_id="e5", total_charge_amount=9.9),
            claim(500, payer_id="Z", date_of_service="bad", encounter_id="e1")]),
         "payments": table(spark, "payments", [payment(7, "c1", 3.3), payment(900, "c500", 4.4), payment(901, "c119", None)]),
         "denials": table(spark, "denials", [denial(2, "c9", denial_reason_code="NEW"), denial(77, "c1")])},
        {"claims": table(spark, "claims", [claim(10)]).select("claim_id")},
    )
    yield ch.Changes(
        {"encounters": table(spark, "encounters", [encounter(5, department="Skin"), encounter(99, department="Eye")]),
         "charges": table(spark, "charges", [charge(1, "e99", 5.5), charge(300, "e5", 6.6)])},
        {"payments": table(spark, "payments", [payment(i, "", 0.0) for i in range(40, 60)]).select("payment_id"),
         "denials": table(spark, "denials", [denial(77, "c1")]).select("denial_id")},
    )
    yield ch.Changes({}, {"encounters": table(spark, "encounters", [encounter(99)]).select("encounter_id")})


def rows_of(view):
    return sorted(
        [tuple(round(v, 8) + 0.0 if isinstance(v, float) else v for v in r) for r in view.collect()], key=str
    )


def test_views_after_changes_equal_views_computed_anew(spark, make_silver, folder):
    silver = silver_of(make_silver)
    kept = Summaries(spark, f"{folder}/sums")
    kept.build(silver)

    def compare(summaries):
        anew = gold.load_gold(silver, AS_OF)
        for name, view in summaries.views(silver, AS_OF).items():
            assert sorted(view.columns) == sorted(anew[name].columns)
            assert rows_of(view.select(*anew[name].columns)) == rows_of(anew[name]), name

    compare(kept)
    for number, changes in enumerate(rounds(spark), 1):
        before = silver
        silver = kept.refresh(number, before, changes)
        kept.refresh(number, before, changes)  # run again: replaces its own sums
        silver = silver.with_tables(**{t: spark.createDataFrame(getattr(silver, t).collect(), typed_schema(t)) for t in TABLES})
        compare(kept)
    compare(kept.compacted(f"{folder}/compacted"))
    with pytest.raises(ValueError):
        kept.refresh(0, silver, ch.Changes())


def test_a_refresh_writes_only_sums_of_touched_groups(spark, make_silver, folder):
    kept = Summaries(spark, f"{folder}/sums")
    silver = silver_of(make_silver)
    kept.build(silver)
    kept.refresh(1, silver, ch.Changes({"payments": table(spark, "payments", [payment(900, "c5", 1.0)])}))
    written = spark.read.parquet(f"{folder}/sums/claims/refresh=1")
    assert written.count() == 1 and not os.path.exists(f"{folder}/sums/denials/refresh=1")


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_a_change_writes_only_the_partitions_of_its_keys(spark, make_silver, folder):
    silver = silver_of(make_silver)
    ch.write_partitioned(silver.claims, folder, "claims", 4)
    before = files(f"{folder}/claims")
    moved = claim(3, date_of_service="2024-06-01")  # from 2024-04
    changes = ch.Changes({"claims": table(spark, "claims", [moved, claim(700, date_of_service="2030-01-01")])},
                         {"claims": table(spark, "claims", [claim(4)]).select("claim_id")})  # in 2024-05
    names = ch.replace_rows(spark, folder, "claims", changes, 4)
    assert names == ["2024-04", "2024-05", "2024-06", "2030-01"]
    after = files(f"{folder}/claims")
    untouched = {f: t for f, t in before.items() if not any(n in f for n in names)}
    assert untouched.items() <= after.items() and len(untouched) > 8
    columns = [c for c, _ in TABLES["claims"]]
    expected = changes.applied(silver).claims.select(*columns)
    found = ch.read_partitioned(spark, folder, "claims").select(*columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and found.count() == 120
    assert ch.replace_rows(spark, folder, "claims", changes, 4) == ["2024-06", "2030-01"]  # again: nothing left elsewhere
    assert sorted(map(str, ch.read_partitioned(spark, folder, "claims").select(*columns).collect())) == sorted(map(str, expected.collect()))


def test_a_partition_that_loses_all_rows_and_tables_without_a_month(spark, make_silver, folder):
    silver = silver_of(make_silver)
    ch.write_partitioned(silver.payers, folder, "payers", 4)
    gone = ch.Changes({}, {"payers": table(spark, "payers", [PAYER_A, PAYER_B]).select("payer_id")})
    assert ch.replace_rows(spark, folder, "payers", gone, 4) and ch.read_partitioned(spark, folder, "payers").count() == 0
    back = ch.Changes({"payers": table(spark, "payers", [PAYER_A])})
    ch.replace_rows(spark, folder, "payers", back, 4)
    assert [r.payer_id for r in ch.read_partitioned(spark, folder, "payers").collect()] == ["A"]
    assert ch.replace_rows(spark, folder, "payers", ch.Changes(), 4) == []


def test_sums_of_a_refresh_start_from_stored_rows(spark, make_silver, folder, monkeypatch):
    """However the tables were put together, the sums of the touched keys are a plan of a few joins."""
    from remitlake.operators import summaries

    silver = silver_of(make_silver)
    silver = next(rounds(spark)).applied(silver)
    joins = []

    def seen(of):
        def sums(tables, keys):
            frame = of(tables, keys)
            joins.append(frame._jdf.queryExecution().optimizedPlan().toString().count("Join "))
            return frame

        return sums

    kept = Summaries(spark, f"{folder}/sums")
    kept.build(silver)
    monkeypatch.setattr(summaries, "_SUMS", {part: seen(of) for part, of in summaries._SUMS.items()})
    changes = ch.Changes(next(rounds(spark)).rows)
    new = kept.refresh(1, silver, changes)
    assert len(joins) == 6 and max(joins) <= 12, joins
    assert not os.path.exists(f"{folder}/sums/_work") or not os.listdir(f"{folder}/sums/_work")
    anew = gold.load_gold(new, AS_OF)
    for name, view in kept.views(new, AS_OF).items():
        assert rows_of(view.select(*anew[name].columns)) == rows_of(anew[name]), name
