"""New files to the typed layer in numbered batches, cut short and restarted."""

import os

import pytest

from remitlake.sources import ingest
from remitlake.sources.silver import Silver
from remitlake.streaming.incremental import load_new_files_typed

HEADER = "denial_id,claim_id,denial_reason_code,denial_reason_description,denial_date,denied_amount,appeal_status,appeal_date,recovered_amount\n"


def drop(folder, name, first, n):
    os.makedirs(f"{folder}/denials", exist_ok=True)
    with open(f"{folder}/denials/{name}.csv", "w") as f:
        f.write(HEADER)
        for i in range(first, first + n):
            f.write(f'n{i},c{i % 3},AUTH,"line one\nline, {i}",2024-02-01,{i}.5,Won,null,{"" if i % 2 else "oops"}\n,c,no key,,,,,,\n')


def counted(frame):
    return sorted(map(str, frame.collect()))


def test_two_drops_and_a_restart_equal_one_full_reload(spark, folder):
    source, target, state = f"{folder}/in", f"{folder}/lake", f"{folder}/state"

    def run(after_raw=None):
        load_new_files_typed(spark, source, target, state, "denials", 2, after_raw).awaitTermination()

    for k in range(3):
        drop(source, f"a{k}", 100 * k, 20)
    run()
    drop(source, "b0", 1000, 30)
    drop(source, "b1", 2000, 5)

    def cut(number):
        raise RuntimeError(f"lost after the raw layer of batch {number}")

    with pytest.raises(Exception, match="lost after the raw layer"):
        run(cut)
    raw = spark.read.parquet(f"{target}/bronze/denials")
    assert raw.count() > Silver.from_parquet(spark, f"{target}/silver").denials.count()  # the batch stopped between the layers
    run()
    run()  # nothing new
    os.makedirs(f"{folder}/stage")
    os.symlink(f"{source}/denials", f"{folder}/stage/denials.csv")
    ingest.load_raw(spark, f"{folder}/stage", f"{folder}/full", ["denials"])
    full = ingest.to_typed(spark.read.parquet(f"{folder}/full/denials"), "denials")
    typed = Silver.from_parquet(spark, f"{target}/silver").denials
    assert typed.count() == 95 and counted(typed) == counted(full)
    (log,) = ingest.read_log(spark, f"{target}/metadata/pipeline_runs").collect()
    assert (log.domain, log.row_count, log.source_file) == ("denials", 95, "denials.csv")
    assert len([d for d in os.listdir(f"{target}/silver/denials") if d.startswith("batch=")]) == 3
    assert not os.listdir(f"{state}/denials/_work")
