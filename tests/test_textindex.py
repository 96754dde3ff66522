"""The full-text index gives what a scan gives."""

import pytest

from catalore.functions import fts
from catalore.functions.errors import QueryError
from catalore.operators.textindex import TextIndex

ROWS = [(1, "/vol/Winter Album.png", "Winter Album.png"), (2, "/vol/the winter", None), (3, "ab", "ab"), (4, None, None), (5, "", ""), (6, "ananas banana", "anana"), (7, "winter " * 40 + "album", "x"), (8, "a lantern near the lantern by the album", "winter lantern")]
QUERIES = ["winter", "WINTER album", "winter NOT album", "ab", "ana", "bum OR nana", "name: winter", "- name: winter", "{name} : (winter OR anana) album", "NEAR(lantern album)", "NEAR(lantern album, 7)", "NEAR(lantern lantern, 9)", "winter OR ab", "NEAR(winter album, 1) OR name: lantern", "zzz", '"the lantern by"', "the + ' ' + w"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, path string, name string").cache()


def found(df, key="id"):
    return sorted((r[key], round(r["rank"], 9)) for r in df.collect())


@pytest.mark.parametrize("query", QUERIES)
def test_same_as_a_scan(spark, rows, query):
    index = TextIndex.build(rows, "id", ["path", "name"])
    assert found(index.search(fts.parse(query)), "key") == found(fts.bm25(rows, fts.parse(query), ["path", "name"]))
    assert found(index.search(fts.parse(query), ["name"]), "key") == found(fts.bm25(rows, fts.parse(query), ["name"], ["path", "name"]))


def test_upkeep_and_storage(spark, rows, tmp_path):
    index = TextIndex.build(rows.where("id < 7"), "id", ["path", "name"])
    new = spark.createDataFrame([(2, "autumn", "autumn"), (9, "late winter", None), (9, "late winter", None), (None, "winter", None)], "id long, path string, name string")
    gone = spark.createDataFrame([(6,)], "key long")
    index.changed(new, "id", gone).save(str(tmp_path))
    again = TextIndex.load(spark, str(tmp_path), ["path", "name"])
    whole = rows.where("id < 7 and id not in (2, 6)").unionByName(new.where("id is not null").distinct())
    for query in ("winter", "autumn OR ana", "late winter"):
        assert found(again.search(fts.parse(query)), "key") == found(fts.bm25(whole, fts.parse(query), ["path", "name"]))
    plan = spark._jvm.PythonSQLUtils.explainString(again.search(fts.parse("winter"))._jdf.queryExecution(), "formatted")
    assert "In(gram, [" in plan or "Or(EqualTo(gram" in plan


def test_empty_and_unknown_columns(spark, rows):
    index = TextIndex.build(rows.limit(0), "id", ["path", "name"])
    assert index.search(fts.parse("winter")).count() == 0
    with pytest.raises(QueryError):
        index.search(fts.parse("text: winter"))
