"""Records of split files against Spark's reader of whole files."""

import collections
import gzip
import os
import random

import pytest

from remitlake.session import CLEANUP, shuffles_end_with_write
from remitlake.sources import export, ingest
from remitlake.sources import records as rec
from remitlake.sources.schemas import TABLES

R = random.Random(21)
FIELDS = ["x", "", " y ", "5\" tube", "null", "a b", "ü", "1.5", "12' 6\" long", "it's"]
QUOTED = ["a,b", "say \"\"no\"\"", "one\ntwo", "one\n\ntwo,three", "\nfirst", "last\n", "\"\"", "", "a\n\"\"b\"\",\nc", " , ", "p\nq\nr\ns\nt"]


def field(quoted):
    if R.random() < quoted:
        return R.choice(["", " "]) + '"' + R.choice(QUOTED) + '"' + R.choice(["", " "])
    return R.choice(FIELDS)


def write_file(path, n, quoted, header="payer_id,payer_name,payer_type,avg_reimbursement_pct,contract_id"):
    with open(path, "w") as f:
        f.write(header + "\n")
        for i in range(n):
            f.write(f"k{i}," + ",".join(field(quoted) for _ in range(R.choice([4, 4, 4, 2, 6]))) + "\n" + "\n" * (R.random() < 0.05))


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "64", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def loaded(spark, folder):
    ingest.load_raw(spark, f"{folder}/stage", f"{folder}/raw", ["payers"])
    assert not os.listdir(f"{folder}/raw/_work")
    return counted(spark.read.parquet(f"{folder}/raw/payers").drop("_loaded_at"))


def counted(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("quoted", [0.0, 0.3, 0.9])
def test_split_files_load_as_whole_files(spark, folder, small_splits, quoted):
    """Two files of many splits, with line breaks inside quotes at any place, some records longer than a split."""
    os.makedirs(f"{folder}/stage/payers.csv")
    write_file(f"{folder}/stage/payers.csv/a.csv", 150, quoted)
    write_file(f"{folder}/stage/payers.csv/b.csv", 60, quoted, 'payer_id,"payer\nname",payer_type,avg,contract_id' if quoted else "a,b,c,d,e")
    if quoted:
        with open(f"{folder}/stage/payers.csv/b.csv", "a") as f:
            f.write('long,"' + "\n".join(f"line {i}, \"\"x\"\"" for i in range(300)) + '",t,1,c\nafter,x,y,1,c\n')
    lines = rec.stored_lines(spark, f"{folder}/stage/payers.csv", f"{folder}/lines")
    assert lines.select("file", "block").distinct().count() > 8
    whole = ingest.read_csv(spark, f"{folder}/stage/payers.csv", "payers", multi_line=True)
    expected = counted(whole)
    assert sum(expected.values()) == 210 + 2 * bool(quoted)
    assert loaded(spark, folder) == expected
    assert bool(rec.splits(lines).where("begins").count()) == bool(quoted)


def test_states_of_lines(spark):
    """Ends inside a quoted field, begun outside and begun inside one."""
    cases = {
        "a,b": (False, True), 'a,"b': (True, False), 'a,"b"': (False, False), 'a,"b""c': (True, False), 'x",y': (True, False),
        'x","y': (True, True), 'x",y': (False, False), '5" tube,b': (False, False), '""x': (False, True), ' "a" ,"b': (True, True), '"': (True, False),
        '""': (False, True), 'a,"x","y"z,"w': (True, True), '"' + '""' * 20000: (True, False), "": (False, True),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "value string").selectExpr(
        "value", f"rlike(value, r'{rec.ENDS_INSIDE_FROM_OUTSIDE}') o", f"rlike(value, r'{rec.ENDS_INSIDE_FROM_INSIDE}') i"
    )
    assert {r.value: (r.o, r.i) for r in frame.collect()} == cases


def test_file_that_stays_open_is_refused(spark, folder, small_splits):
    os.makedirs(f"{folder}/stage")
    names = [c for c, _ in TABLES["payers"]]
    with open(f"{folder}/stage/payers.csv", "w") as f:
        f.write(",".join(names) + "\n" + "".join(f'P{i},"a\nb",x,1,y\n' for i in range(200)) + 'Q,"open,x,1,y\n' + "r,s,t,1,u\n" * 50)
    with pytest.raises(ValueError, match="payers.csv: ends inside a quoted field"):
        ingest.load_raw(spark, f"{folder}/stage", f"{folder}/raw", ["payers"])
    assert not os.path.exists(f"{folder}/raw/payers") and not os.listdir(f"{folder}/raw/_work")


def test_lines_are_read_once_and_plain_files_need_no_shuffle_of_lines(spark, folder, small_splits):
    os.makedirs(f"{folder}/stage")
    write_file(f"{folder}/stage/payers.csv", 200, 0.0)
    lines = rec.stored_lines(spark, f"{folder}/stage/payers.csv", f"{folder}/lines")
    frame = ingest.parsed(lines, "payers", f"{folder}/scratch")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "SortMergeJoin" not in plan and "Window" not in plan
    assert frame.count() == 200


def test_lines_are_kept_only_if_some_are_broken(spark, folder, small_splits, monkeypatch):
    """Files whose lines are all records load without a copy of their lines, packed or not, as Spark's reader reads them."""
    os.makedirs(f"{folder}/stage/payers.csv")
    write_file(f"{folder}/stage/payers.csv/a.csv", 150, 0.0)
    with open(f"{folder}/stage/payers.csv/b.csv", "w") as f:
        f.write('a,b,c,d,e\nk,"x, ""y""",z,1,"c"\n  \n\nl," q ",z\n')
    kept = []
    monkeypatch.setattr(ingest, "stored_lines", lambda *args: kept.append(args) or rec.stored_lines(*args))
    expected = counted(ingest.read_csv(spark, f"{folder}/stage/payers.csv", "payers", multi_line=True))
    assert loaded(spark, folder) == expected and sum(expected.values()) == 152 and not kept
    with open(f"{folder}/stage/payers.csv/c.csv", "w") as f:
        f.write("a,b,c,d,e\nm,x,y,1,c\n \t \nn,x,y,1,c\n")
    assert loaded(spark, folder) - expected >= collections.Counter([("m", "x", "y", "1", "c"), ("n", "x", "y", "1", "c")])
    assert len(kept) == 1  # a line of blanks and a tab is a row of the raw layer, as before


def test_packed_files_load_as_plain_ones(spark, folder):
    rows = spark.createDataFrame([(f"P{i}", 'say "no", twice', "t", str(i), None) for i in range(50)], ingest.raw_schema("payers")).repartition(3)
    export.write_csv(rows, f"{folder}/stage/payers.csv", packed=True)
    assert all(n.endswith(".csv.gz") for n in os.listdir(f"{folder}/stage/payers.csv") if n.startswith("part-"))
    assert loaded(spark, folder) == counted(rows)
    assert all(".zstd." in n for n in os.listdir(f"{folder}/raw/payers") if n.startswith("part-"))


def shuffled_rows(frame):
    """Rows that the exchanges of a frame wrote when it ran."""

    def below(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return below(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return below(node.plan())
        own = node.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(below(node.children().apply(i)) for i in range(node.children().size()))

    frame.collect()
    return below(frame._jdf.queryExecution().executedPlan())


def test_lines_of_broken_records_stay_where_they_lie(spark, folder):
    """Every record is broken over two or three lines, but only a few rows per piece are shuffled, and nothing else is kept."""
    os.makedirs(f"{folder}/stage")
    with open(f"{folder}/stage/payers.csv", "w") as f:
        f.write("a,b,c,d,e\n" + "".join(f'P{i},"a\n""b"", x{chr(10) * (i % 2)}",t,1,c\n' for i in range(3000)))
    assert not rec.lines_stand_alone(spark, f"{folder}/stage/payers.csv", f"{folder}/first")
    assert spark.read.parquet(f"{folder}/first/open").count() == 1
    lines = rec.stored_lines(spark, f"{folder}/stage/payers.csv", f"{folder}/lines")
    frame = ingest.parsed(lines, "payers", f"{folder}/scratch")
    assert shuffled_rows(frame) + shuffled_rows(rec.splits(lines)) < 300
    assert counted(frame) == counted(ingest.read_csv(spark, f"{folder}/stage/payers.csv", "payers", multi_line=True))
    assert frame.count() == 3000 and not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


@pytest.mark.parametrize("split", [False, True])
def test_records_over_many_pieces(spark, folder, monkeypatch, request, split):
    """Pieces of four lines, so that records begin, end and lie within them in every way; one file is packed."""
    if split:
        request.getfixturevalue("small_splits")
    monkeypatch.setattr(rec, "PIECE_BITS", 2)
    monkeypatch.setattr(rec, "PART_BITS", 3)
    os.makedirs(f"{folder}/stage/payers.csv")
    write_file(f"{folder}/stage/payers.csv/a.csv", 300, 0.2)
    write_file(f"{folder}/stage/payers.csv/b.csv", 100, 0.9, 'payer_id,"payer\n\n\n\n\n\nname",payer_type,avg,contract_id')
    with open(f"{folder}/stage/payers.csv/b.csv", "a") as f:
        f.write('long,"' + "\n".join(["x", "", '""y""', ","] * 20) + '","\n",1,"\nc"\n\nafter,x,y,1,c\n')
    write_file(f"{folder}/plain.csv", 60, 0.4)
    with open(f"{folder}/plain.csv", "rb") as f, gzip.open(f"{folder}/stage/payers.csv/c.csv.gz", "wb") as g:
        g.write(f.read())
    lines = rec.stored_lines(spark, f"{folder}/stage/payers.csv", f"{folder}/lines")
    known = rec.splits(lines)
    assert known.where("begins AND closes IS NULL").count() and known.where("begins AND ends AND opened IS NOT NULL").count()
    expected = counted(ingest.read_csv(spark, f"{folder}/stage/payers.csv", "payers", multi_line=True))
    assert loaded(spark, folder) == expected and sum(expected.values()) == 462


def test_shuffles_end_with_the_write(spark, folder):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = kept()
    with shuffles_end_with_write(spark):
        spark.range(1000).repartition(3).write.parquet(f"{folder}/rows")
    assert not kept() - before and spark.conf.get(CLEANUP, None) is None
    assert spark.read.parquet(f"{folder}/rows").count() == 1000
