"""The indexed search against the plain one."""

import random

import pytest

from remitlake.operators.filters import search
from remitlake.sources import text_index

R = random.Random(9)
NAMES = ["Anna Müller", "ana", "Bo|b", "O'Hara", None, "", "X", "日本", "aaa", "aaaa", "Ann"]


@pytest.fixture
def people(spark):
    rows = [(f"k{i}" if i % 17 else None, R.choice(NAMES), R.choice("xyz") * R.randrange(4), i) for i in range(400)]
    return spark.createDataFrame(rows, "id string, name string, code string, n int")


@pytest.mark.parametrize("pushed", [text_index.PUSHED, 3])
def test_same_rows_as_the_plain_search(spark, folder, people, people_texts, pushed, monkeypatch):
    monkeypatch.setattr(text_index, "PUSHED", pushed)
    text_index.write_indexed(people, folder, "id")
    for text in people_texts:
        found = sorted(map(str, text_index.indexed_search(spark, folder, "id", text).collect()))
        assert found == sorted(map(str, search(people, text).collect())), text
    some = text_index.indexed_search(spark, folder, "id", "an", code="xx")
    assert sorted(map(str, some.collect())) == sorted(map(str, search(people, "an", code="xx").collect()))


@pytest.fixture
def people_texts():
    return ["", "a", "An", "ANN", "aaa", "aaaa", "müller", "o|b", "k12", "k12|", "|", "zz|", "日本", "日", "nothing", "xx|39", "a m"]


def test_few_rows_are_read(spark, folder):
    table = spark.range(0, 40_000, 1, 4).selectExpr("concat('k', lpad(id, 6, '0')) id", "concat('name ', md5(cast(id as string))) name")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2000")
    try:
        text_index.write_indexed(table, folder, "id")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    text = table.where("id = 'k012345'").first().name[5:17]
    found = text_index.indexed_search(spark, folder, "id", text)
    assert [r.id for r in found.collect()] == ["k012345"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "k012345" in plan.split("PushedFilters")[1]
    assert text_index.candidates(spark, folder, text).count() == 1
    one = text_index.candidates(spark, folder, text)._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in one or "gram" in one.split("PushedFilters")[1]
