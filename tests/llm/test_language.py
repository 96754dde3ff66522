import pytest

from catalore.llm import language as lang
from pyspark.sql import functions as F

EN = ["The archivist describes the winter album near the window.", "Every visitor compares the old map with the new list.", "Our scanner lost the missing sheet after a short pause.", "The museum keeps the handwritten labels in the cellar."]
DE = ["Der Archivar beschreibt das Winteralbum nicht weit vom Fenster.", "Jeder Besucher vergleicht die alte Karte mit der neuen Liste.", "Unser Scanner verliert das fehlende Blatt nach einer kurzen Pause.", "Das Museum bewahrt die handschriftlichen Etiketten im Keller."]
SCHEMA = "id long, language string, language_confidence double, confidence double, text string, text_length long, label string"


@pytest.fixture(scope="module")
def texts(spark):
    rows = []
    for i in range(40):
        rows.append((i, ["en", "eng", "en_GB", "English"][i % 4], 1.0, 1.0, " ".join(EN[j % 4] for j in range(i, i + 3)), 1, "x"))
        rows.append((100 + i, ["de", "ger", "de-AT", "German"][i % 4], None, None, " ".join(DE[j % 4] for j in range(i, i + 3)), None, None))
    rows += [
        (500, "de", 1.0, 1.0, EN[0], 1, "x"),
        (501, None, 1.0, 1.0, DE[1], 1, "x"),
        (501, None, 1.0, 1.0, DE[1], 1, "x"),
        (502, "en", 1.0, 1.0, EN[1] + "\n\n" + DE[2], 1, "x"),
        (503, "en", 1.0, 1.0, None, 1, "x"),
        (504, "en", 1.0, 1.0, "12 45 -- ♪", 1, "x"),
        (505, "und", 1.0, 1.0, "", 1, "x"),
        (506, "en", 1.0, 1.0, EN[2].replace("sheet", "sheet (»Das alte Verzeichnis«)"), 1, "x"),
        (507, "en", 1.0, 1.0, " ".join(EN) * 300, 1, "x"),
        (508, "xx", 1.0, 1.0, "der archivar beschreibt das winteralbum nicht weit vom fenster das museum bewahrt die handschriftlichen etiketten im keller", 1, "x"),
        (None, "en", 1.0, 1.0, EN[0], 1, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_found(texts):
    got = sorted((r.id, r.language) for r in lang.p2_found(texts).collect())
    assert got == [(500, "en"), (501, "de"), (502, "de"), (502, "en"), (508, "de")]


def test_segments_cover_the_text(texts):
    rows = lang.segments(texts.where("id in (502, 507)"), lang.fit(texts)).orderBy("id", "part").collect()
    mixed = [r for r in rows if r.id == 502]
    assert [r.language for r in mixed] == ["en", "de"] and mixed[0].start == 0
    whole = [r for r in rows if r.id == 507]
    assert len(whole) == 1 and whole[0].confidence > 0.9


def test_codes(spark):
    given = {"en": "en", "EN": "en", "eng": "en", "en_GB": "en", "English": "en", "ger": "de", "de-AT": "de", "und": None, "": None, "n/a": None, "xx": None, "prompt:describe": None, None: None, "unknown": None, "la": "la", "et": "et", "Lithuanian": "lt", "fas": "fa", "per": "fa", "sq-AL": "sq", "Haitian Creole": "ht", "Norwegian (Bokmål)": "no", "Portuguese (Brazil)": "pt", "mul": None, "caption-long": None}
    got = spark.createDataFrame([(k,) for k in given], "l string").select("l", lang.code(F.col("l")).alias("c")).collect()
    assert {r.l: r.c for r in got} == given


def test_empty(spark, texts):
    assert lang.p2_found(texts.limit(0)).count() == 0
    assert lang.p2_labels(texts.where("text is null")).count() == 0


def test_narrow_margin_is_rejected(texts):
    c = lang.fit(texts)
    assert c.best("zzz qqq")[0] is None
    assert c.best(lang.fold(DE[0]))[0] == "de"


def test_heldout_accuracy(spark, small):
    texts = spark.read.parquet(f"{small.replace('0.001', '0.01')}/extracted_text.parquet")
    fitted = lang.fit(texts.where("id % 2 = 0"))
    rest = texts.where("id % 2 = 1 and language_confidence > 0.9 and text is not null").withColumn("right", lang.code(F.col("language"))).where("right is not null")
    by = lang.segments(rest, fitted).where("language is not null").groupBy("id").agg(F.max_by("language", "words").alias("language"))
    ok = by.join(rest.select("id", "right").distinct(), "id").agg(F.avg((F.col("language") == F.col("right")).cast("double")).alias("a")).first().a
    assert ok > 0.85  # some of the labels are wrong
