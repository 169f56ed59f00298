"""Claims in interleaved order: which files a filter has to read, and that results stay."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from conftest import claim, encounter

from remitlake.operators import kpis
from remitlake.operators.filters import FilterParams, cascade, filtered_claims
from remitlake.sources import interleave


@pytest.fixture
def wide(spark, make_silver):
    claims = spark.range(0, 24_000, 1, 4).selectExpr(
        "cast(id as string) claim_id", "concat('e', id % 900) encounter_id", "'p' patient_id",
        "if(id % 3 = 0, 'PYR000', concat('PYR', lpad(id * 7919 % 40, 3, '0'))) payer_id",
        "cast(date_add(date'2020-01-01', cast(id * 104729 % 1400 as int)) as string) date_of_service",
        "'2024-01-20' submission_date", "1.0D total_charge_amount", "if(id % 4 = 0, 'Denied', 'Paid') claim_status",
        "1 is_clean_claim", "'Electronic' submission_method", "cast(null as string) fail_reason",
    )
    encounters = spark.range(0, 890).selectExpr(
        "concat('e', id) encounter_id", "'p' patient_id", "'d1' provider_id", "'2021-01-10' date_of_service",
        "cast(null as string) discharge_date", "if(id % 2 = 0, 'In', 'Out') encounter_type", "concat('DEPT_', id * 31 % 8) department",
    )
    return make_silver().with_tables(claims=claims, encounters=encounters)


def read_share(root, **equal):
    """Share of the files whose statistics admit the values (for a pair, a range)."""
    admitted, files = 0, glob.glob(f"{root}/claims/*.parquet")
    for name in files:
        meta = pq.ParquetFile(name).metadata
        hit = False
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i).statistics for i in range(meta.num_columns)}
            low_high = {c: v if isinstance(v, tuple) else (v, v) for c, v in equal.items()}
            hit |= all(columns[c].min <= hi and columns[c].max >= lo for c, (lo, hi) in low_high.items())
        admitted += hit
    return admitted / len(files)


def test_each_filter_skips_files(spark, folder, wide):
    interleave.write_interleaved(wide, folder, 64)
    assert len(glob.glob(f"{folder}/claims/*.parquet")) > 40
    assert read_share(folder, payer_id="PYR020") <= 0.5
    assert read_share(folder, _department="DEPT_5") <= 0.5
    assert read_share(folder, date_of_service=("2021-03-01", "2021-03-31")) <= 0.5
    assert read_share(folder, payer_id="PYR020", date_of_service=("2021-03-01", "2021-03-31")) <= 0.25


PARAMS = [
    FilterParams("2020-06-01", "2021-06-30"), FilterParams("2020-01-01", "2024-12-31", payer_id="PYR000"),
    FilterParams("2020-01-01", "2024-12-31", department="DEPT_5"), FilterParams("2020-01-01", "2024-12-31", "PYR020", "DEPT_5", "In"),
]


@pytest.mark.parametrize("p", PARAMS)
def test_results_stay_and_the_join_goes(spark, folder, wide, p):
    interleave.write_interleaved(wide, folder, 8)
    stored = interleave.with_interleaved(spark, wide, folder)
    claims = filtered_claims(stored, p)
    plan = claims._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and claims.columns == wide.claims.columns
    assert all(f in plan for f, v in (("EqualTo(_department", p.department), ("EqualTo(payer_id", p.payer_id)) if v)
    assert sorted(map(str, claims.collect())) == sorted(map(str, filtered_claims(wide, p).select(*wide.claims.columns).collect()))
    assert set(cascade(stored, p).claims.columns) == set(wide.claims.columns)
    assert cascade(stored, p).claims.count() == cascade(wide, p).claims.count()
    assert sorted(map(str, kpis.payer_mix(stored, p).collect())) == sorted(map(str, kpis.payer_mix(wide, p).collect()))


def test_ranks_follow_the_texts(spark):
    texts = ["", "a", "ab", "abc", "abd", "b", "é", "日", "zzzzzzz", "0", "PYR001", "PYR010"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", interleave.text_rank("t").alias("r"))
    rows = sorted(frame.collect(), key=lambda r: r.t.encode())
    assert [r.r for r in rows] == sorted(r.r for r in rows) and len({r.r for r in rows}) == len(texts)


def test_claims_are_put_together_once(spark, make_silver, folder, monkeypatch):
    """Bounds, ranges and rows are read from stored claims; the work folder goes."""
    read = []
    plain = interleave.interleaved
    monkeypatch.setattr(interleave, "interleaved", lambda frame, *more: read.extend(frame.inputFiles()) or plain(frame, *more))
    silver = make_silver(claims=[claim(i) for i in range(20)], encounters=[encounter(i) for i in range(15)])
    interleave.write_interleaved(silver, folder, 2)
    assert read and all("/_work/" in f for f in read)
    assert interleave.with_interleaved(spark, silver, folder).claims.count() == 20 and not os.listdir(f"{folder}/_work")


def test_partitions_grow_with_the_input(spark, folder, monkeypatch):
    from remitlake import session

    spark.range(1000).write.parquet(f"{folder}/rows")
    paths = [f"{folder}/rows", f"{folder}/none"]
    assert session.partitions_for(spark, paths) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = session.stored_bytes(spark, paths)
    monkeypatch.setattr(session, "INPUT_PER_PARTITION", size // 50)
    assert 50 <= session.partitions_for(spark, paths) <= 52
    other = spark.newSession()
    other.conf.set(session.INITIAL, "7")  # its owner's choice
    session.set_partitions_for(other, paths)
    assert other.conf.get(session.INITIAL) == "7"
