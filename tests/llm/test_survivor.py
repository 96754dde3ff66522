from catalore.llm.survivor import moment, p3_found, p3_survivors, place, source_trust, survivors, whole_hash
from pyspark.sql import functions as F

FILES = "id long, sha256 string, item_id long, path string, filename string, last_modified string, scan_id long, available boolean, field string, value string, records long"


def files(spark, rows):
    return spark.createDataFrame([(*r, "f", "v", 9) for r in rows], FILES)


def test_paths(spark):
    same = ["/library/vol1/Übungen/a b.jpg", " /library/vol1/Übungen/a b.jpg\n", '"/library/vol1/Übungen/a b.jpg"', "/library//vol1/./Übungen/a b.jpg", "/library/tmp/../vol1/Übungen/a b.jpg", "\\library\\vol1\\Übungen\\a b.jpg", "file:///library/vol1/%C3%9Cbungen/a%20b.jpg", "/library/vol1/%C3%9Cbungen/a%20b.jpg", "/library/x/y/../../vol1/Übungen/a b.jpg"]
    other = ["/library/vol1/Übungen/A b.jpg", "/library/vol1/Übungen/a b (1).jpg", "/library/vol1/a+b 100%.jpg", "", "  ", None]
    got = [r.p for r in spark.createDataFrame([(p,) for p in same + other], "p string").select(place(F.col("p")).alias("p")).collect()]
    assert set(got[: len(same)]) == {same[0]}
    assert got[len(same) :] == ["/library/vol1/Übungen/A b.jpg", "/library/vol1/Übungen/a b (1).jpg", "/library/vol1/a+b 100%.jpg", None, None, None]


def test_times(spark):
    given = {
        "2018-06-22T22:58:16Z": "2018-06-22 22:58:16", "2018-06-22T22:58:16": "2018-06-22 22:58:16", "2018/06/22 22:58:16": "2018-06-22 22:58:16", "2018-06-22 22:58:16.5": "2018-06-22 22:58:16.5",
        "2018-06-22T22:58:16-07:00": "2018-06-23 05:58:16", "2018-06-22T22:58:16+0300": "2018-06-22 19:58:16", "2018-06-22": "2018-06-22 00:00:00",
        "1970-01-01T00:00:00": None, "2107-02-06T06:28:15": None, "0001-01-01T00:00:00": None, "unknown": None, "": None, None: None, "2018-13-45T00:00:00": None, "10:00": None,
    }
    got = spark.createDataFrame([(k,) for k in given], "t string").select("t", moment(F.col("t")).cast("string").alias("m")).collect()
    assert {r.t: r.m for r in got} == given


def test_hashes(spark):
    h = "ab" * 32
    given = {h: h, h.upper(): h, h + " ": h, "sha256:" + h: h, "0" * 64: None, "f" * 64: None, h[:40]: None, "pending": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in given], "h string").select("h", whole_hash(F.col("h")).alias("w")).collect()
    assert {r.h: r.w for r in got} == given


def test_best_of_each_field(spark):
    a, b = "ab" * 32, "cd" * 32
    rows = [
        (7, a, 1, "/x/one.jpg", None, "2018-01-01T00:00:00Z", 1, True),
        (5, b, 1, "\\x\\one.jpg", "one.jpg", "2019-01-01 00:00:00.250", 1, None),
        (9, "pending", 1, "/x/./one.jpg", None, "2020-01-01T00:00:00", 1, False),
        (9, "pending", 1, "/x/./one.jpg", None, "2020-01-01T00:00:00", 1, False),
        (3, None, None, "/x/two.jpg", None, None, None, None),
        (4, None, None, "/x/two.jpg ", None, "unknown", None, None),
        (6, a, None, "/x/three.jpg", None, "2020-01-01T00:00:00", None, True),
        (8, a, None, None, None, "2020-01-01T00:00:00", None, True),
    ]
    found = {r.first_id: (r.sha256, r.last_modified) for r in p3_found(files(spark, rows)).collect()}
    assert found == {5: (b, "2020-01-01T00:00:00Z"), 3: (None, None)}
    every = {r.path: r for r in p3_survivors(files(spark, rows)).collect()}
    assert set(every) == {"/x/one.jpg", "/x/two.jpg", "/x/three.jpg"} and every["/x/one.jpg"].records == 4 and every["/x/one.jpg"].filename == "one.jpg"
    assert p3_found(files(spark, [])).count() == 0 and p3_survivors(files(spark, [])).count() == 0


def test_agreement_outvotes_with_a_long_half_life(spark):
    rows = spark.createDataFrame([(1, "k", "old", "2020-01-01"), (2, "k", "old", "2020-01-02"), (3, "k", "new", "2020-01-03"), (4, None, "x", "2020-01-03")], "id long, k string, v string, t string")
    pick = lambda half: [r.v for r in survivors(rows, F.col("k"), {"v": F.col("v")}, F.to_timestamp("t"), F.lit(1.0), half).collect()]
    assert pick(1e-3) == ["new"] and pick(1e9) == ["old"]


def test_survivors_are_voted(spark):
    a, b = "ab" * 32, "cd" * 32
    rows = [(i, h, 1, p, None, f"2020-01-0{i}T00:00:00Z", 1, True) for i, h, p in ((1, a, "/x/one.jpg"), (2, a, "\\x\\one.jpg"), (3, b, "/x/./one.jpg"))]
    assert [(r.sha256, r.path) for r in p3_survivors(files(spark, rows)).collect()] == [(a, "/x/one.jpg")]
    late = [(4, b, 1, "/x/one.jpg", None, "2026-01-01T00:00:00Z", 1, True)]
    assert [r.sha256 for r in p3_survivors(files(spark, rows[:2] + late)).collect()] == [b]
    assert [r.sha256 for r in p3_found(files(spark, rows)).collect()] == [b]


def test_trusted_sources_outvote_a_newer_record(spark):
    a, b = "ab" * 32, "cd" * 32
    rows = [(1, a, 1, "/x/one.jpg", None, "2020-01-01T00:00:00Z", 1, True), (2, a, 1, "/x/one.jpg", None, "2020-01-02T00:00:00Z", 2, True), (3, b, 1, "/x/one.jpg", None, "2020-06-01T00:00:00Z", 3, True)]
    trusts = lambda *t: spark.createDataFrame(list(zip((1, 2, 3), t)), "scan_id long, trust double")
    best = lambda t, half=365 * 86_400.0: [(r.first_id, r.records, r.sha256) for r in p3_survivors(files(spark, rows), half, t).collect()]
    assert best(trusts(0.9, 0.9, 0.9)) == [(1, 3, a)]
    assert best(trusts(0.2, 0.2, 0.9)) == [(1, 3, b)]  # untrusted ones don't, though they agree
    assert best(trusts(0.9, 0.9, 0.9), 86_400.0) == [(1, 3, b)]  # nor do old ones
    assert best(spark.createDataFrame([(3, 0.5)], "scan_id long, trust double")) == [(1, 3, b)]  # unnamed sources count nothing


def test_source_trust(spark):
    a = "ab" * 32
    rows = [(1, a, 1, "/a", None, "2020-01-01", 1, True), (2, "pending", 1, "/b", None, "2020-01-01", 1, True), (3, a, 1, "/c", None, None, 2, True), (4, a, 1, "/d", None, "2020-01-01", None, True)]
    assert {r.scan_id: round(r.trust, 6) for r in source_trust(files(spark, rows)).collect()} == {1: 0.5, 2: round(1 / 3, 6), None: round(2 / 3, 6)}


def test_export_time_is_an_argument(spark):
    rows = [(i, "ab" * 32, 1, "/x", None, "2031-01-01T00:00:00Z", 1, True) for i in (1, 2)]
    assert p3_found(files(spark, rows)).first().last_modified is None
    assert p3_found(files(spark, rows), "2031-12-31T00:00:00Z").first().last_modified == "2031-01-01T00:00:00Z"


def test_votes_across_buckets_equal_a_plain_sum(spark):
    import random

    draw = random.Random(5)
    rows = [(i, f"k{draw.randrange(40)}", f"v{draw.randrange(3)}", draw.randrange(0, 3_000_000), draw.choice([0.25, 0.5, 1.0])) for i in range(600)]
    half = 1000.0  # 3,000 half-lives: six buckets
    df = spark.createDataFrame(rows, "id long, k string, v string, t long, w double")
    got = {(r.first_id, r.v) for r in survivors(df, F.col("k"), {"v": F.col("v")}, F.timestamp_seconds("t"), F.col("w"), half).collect()}
    want = set()
    for k in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == k]
        newest = max(r[3] for r in own)
        votes = {}
        for _, _, v, t, w in own:
            votes[v] = votes.get(v, 0.0) + w * 2.0 ** ((t - newest) / half)
        want.add((min(r[0] for r in own), max(votes, key=votes.get)))
    assert got == want
