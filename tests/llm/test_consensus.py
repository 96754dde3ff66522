from catalore.llm.consensus import Consensus, plain, votes
from pyspark.sql import functions as F

TI = "item_data_id long, tag_id long, item_id long, confidence double, name string"
ID = "id long, item_id long, job_id long, setter_id long, data_type string, confidence double"
TAGS = "id long, namespace string, name string, item_count long"


def tables(spark, rows, data, tags):
    return spark.createDataFrame(rows, TI), spark.createDataFrame(data, ID), spark.createDataFrame(tags, TAGS)


def test_spellings_become_one(spark):
    got = spark.createDataFrame([("Line Art",), ("line-art",), ("LINE_ART",), ("lineArt",), (" line  art ",), (None,)], "n string").select(plain(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == ["line_art"] * 5 + [None]


def test_votes_nulls_repeats_and_clashing_columns(spark):
    tags = [(1, "mini:Kind", "PHOTO", 0), (2, "kind", "line art", None), (3, None, "photo", 0), (4, "kind", None, 0), (5, "artist", "x", 0)]
    data = [(10, 100, 1, 7, "tags", 0.1), (11, 101, 1, 8, "tags", None), (12, None, 1, 8, "tags", None), (13, 100, 1, None, "tags", None)]
    rows = [(10, 1, None, 0.5, "x"), (10, 1, None, 0.5, "x"), (11, 2, 101, float("nan"), "y"), (12, 2, None, 0.1, "z"), (13, 1, 100, 1.0, None), (10, 3, 100, 1.0, None), (10, 4, 100, 1.0, None), (10, 5, 100, 1.0, None), (None, 1, 100, 1.0, None), (99, 1, 100, 1.0, None)]
    got = {tuple(r) for r in votes(*tables(spark, rows, data, tags)).collect()}
    assert got == {(100, "kind", "photo", 7, 0.5), (101, "kind", "line_art", 8, None)}


def test_good_annotators_win_over_a_crowd_of_copies(spark):
    import random

    random.seed(3)
    labels = ["a", "b", "c", "d", "e"]
    rows, truth = [], {}
    for item in range(600):
        truth[item] = random.choice(labels)
        wrong = lambda: random.choice([x for x in labels if x != truth[item]])
        for annotator, skill in ((1, 0.95), (2, 0.9), (3, 0.9)):
            rows.append((item, "kind", truth[item] if random.random() < skill else wrong(), annotator, 0.5))
        first = truth[item] if random.random() < 0.5 else wrong()
        for annotator in (4, 5, 6):  # two of them repeat the first
            rows.append((item, "kind", first, annotator, None))
    model = Consensus(spark.createDataFrame(rows, "item_id long, namespace string, name string, annotator long, confidence double"))
    got = {r.item_id: r for r in model.labels().collect()}
    assert len(got) == 600
    assert sum(got[i].name == truth[i] for i in truth) / 600 > 0.93
    quality = {r.annotator: r for r in model.annotators().collect()}
    assert quality[1].reliability > 0.85 > 0.7 > quality[4].reliability
    assert quality[5].errs_like in (4, 6)
    assert all(r.agreement is None or r.agreement <= 1 for r in got.values())


def test_empty_and_single_votes(spark):
    schema = "item_id long, namespace string, name string, annotator long, confidence double"
    empty = Consensus(spark.createDataFrame([], schema))
    assert empty.labels().count() == 0 and empty.annotators().count() == 0
    one = Consensus(spark.createDataFrame([(1, "kind", "photo", 3, None)], schema)).labels().collect()
    assert [(r.name, r.labels, r.agreement) for r in one] == [("photo", 1, None)]
