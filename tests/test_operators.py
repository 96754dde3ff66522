import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from catalore.functions import vectors
from catalore.operators import ingest, ledgers, media, outputs, quants, stats, user
from catalore.sources import files as media_files
from catalore.sources.catalog import SCHEMAS, Catalog
from catalore.streaming import changes
from pyspark.sql import functions as F


def made(spark, **tables):
    """A catalogue of small tables given as rows of leading columns."""
    out = {}
    for name, rows in tables.items():
        columns = SCHEMAS[name].split(", ")
        out[name] = spark.createDataFrame([tuple(r) + (None,) * (len(columns) - len(r)) for r in rows], SCHEMAS[name])
    return Catalog(spark, tables=out)


@pytest.fixture(scope="module")
def tags(spark):
    return made(
        spark,
        items=[(100, "a"), (101, "b")],
        setters=[(1, "alpha"), (2, "beta")],
        item_data=[(10, 100, 1, 1, "tags"), (11, 101, 1, 1, "tags"), (12, 100, 1, 2, "tags")],
        tags=[(1, "ns", "cat"), (2, "ns", "caterpillar"), (3, "ns", "dog")],
        tags_items=[(10, 1, 100, 0.9), (11, 1, 101, 0.7), (12, 1, 100, 0.8), (10, 2, 100, 0.6), (11, 3, 101, 0.5)],
    )


def test_tag_counts_follow_deletions(spark, tags):
    counts = lambda c: {r.name: r.item_count for r in stats.tag_recount(c).collect()}
    assert [(r.name, r.item_count) for r in stats.tag_autocomplete(tags, "cat", recount=True).collect()] == [("cat", 2), ("caterpillar", 1)]
    one = ingest.cascade(tags, data=spark.createDataFrame([(12,)], "id long"))
    assert counts(one) == {"cat": 2, "caterpillar": 1, "dog": 1}
    two = ingest.cascade(one, data=spark.createDataFrame([(11,)], "id long"))
    assert counts(two) == {"cat": 1, "caterpillar": 1, "dog": 0}


def test_top_tags_and_frequency(spark):
    c = made(spark, setters=[(1, "alpha")], item_data=[(10, 100, 1, 1, "tags"), (11, 101, 1, 1, "tags")], tags=[(1, "ns", "cat"), (2, "ns", "caterpillar")], tags_items=[(10, 2, 100, 0.6), (10, 1, 100, 0.9), (11, 1, 101, 0.8)])
    assert [(r.name, r["count"], r.frequency) for r in stats.tag_frequency(c).collect()] == [("cat", 2, 1.0), ("caterpillar", 1, 0.5)]
    assert stats.tag_frequency(Catalog(spark)).count() == 0


def test_search_stats(spark):
    c = made(
        spark, bookmarks=[("user", "fav", "a"), ("*", "shared", "a"), ("other", "skip", "a")], items=[(1, "a", None, "image/png"), (2, "b", None, "video/mp4")], files=[(1, "a", 1), (2, "a", 1), (3, "b", 2)],
        tags=[(1, "ns:sub", "cat"), (2, "other:tag", "dog")], tags_items=[(1, 1, 1, 0.4), (1, 2, 1, 0.8)], extracted_text=[(1, "en", 0.9, 0.5), (2, "fr", 0.7, 0.4)],
        folders=[(1, "t", "C:\\data", True), (2, "t", "C:\\skip", False)], setters=[(1, "alpha"), (2, "beta")], item_data=[(1, 1, 1, 1, "tags"), (2, 1, 1, 2, "clip"), (3, 2, 1, 1, "text")],
    )
    got = {k: [tuple(r) for r in df.collect()] for k, df in stats.search_stats(c).items()}
    assert got["bookmarks"] == [("fav",), ("shared",)] and got["files"] == [(3, 2)] and got["tags"] == [("ns",), ("ns:sub",), ("other",), ("other:tag",)]
    assert got["min_tag_confidence"] == [(0.4,)] and got["text_stats"] == [("en,fr", 0.7, 0.4)] and got["folders"] == [("C:\\data",)]
    assert got["setters"] == [("clip", "beta"), ("tags", "alpha"), ("text", "alpha")]
    assert stats.min_tag_confidence(Catalog(spark)).first()[0] == 0.0


def test_boards_follow_their_head(spark):
    c = made(spark, items=[(1, "a"), (2, "b"), (3, "c")], files=[(1, "a", 1), (2, "b", 2), (3, "c", 3)], pinboards=[(1, "user", "one", 11), (2, "user", "two", 20), (3, "else", "x", 30)], pinboard_versions=[(10, 1), (11, 1), (20, 2), (30, 3)], pinboard_version_items=[(10, "c"), (11, "a"), (20, "a"), (20, "b"), (30, "c")])
    from catalore.plans.compile import search

    ids = lambda q, cat=c: sorted(r.file_id for r in search(cat, {"query": q, "page_size": 0}).collect())
    assert ids({"in_pinboard": {}}) == [1, 2] and ids({"not_": {"in_pinboard": {}}}) == [3] and ids({"in_pinboard": {"pinboard_ids": [1]}}) == [1]
    assert ids({"in_pinboard": {"pinboard_ids": [1]}}, user.delete_version(c, 11)) == [3]
    listed = {r.id: (r.item_count, r.present_count, r.version_count) for r in user.boards(c).collect()}
    assert listed == {1: (1, 1, 2), 2: (2, 2, 1)}
    assert user.rename(c, 1, "new", "t")["pinboards"].where("id = 1").first().name == "new"


def test_activity(spark):
    c = made(spark, pinboards=[(i, "user", f"b{i}", i, "t", "t", None, 1000 + i, 0.0, None) for i in range(1, 8)] + [(8, "user", "habit", 8, "t", "t", None, 500, 50.0, 900)])
    order = [r.id for r in user.boards(c, now=2000).orderBy("at").collect()]
    assert order == [7, 6, 5, 4, 3, 8, 2, 1]
    after = user.opened(c["pinboards"], [1, 8], 900 + 7200).where("id in (1, 8)").orderBy("id").collect()
    assert after[0].frecency == 1.0 and 50 < after[1].frecency < 51.1
    assert user.opened(c["pinboards"], [8], 900 + 7199).where("id = 8").first().frecency == 50.0


def test_ledgers(spark):
    c = made(spark, scan_errors=[(1, "/a", "t1", 5, "hash", "x", None, None, "e", 2, 1, 7, "s", "s")], item_extraction_errors=[(1, 1, 1, "model", "x", None, None, "e", 2, 1, 7, "s", "s")])
    again = lambda run, time="t1": spark.createDataFrame([("/a", time, 5, "hash", "x", None, None, "e", 2, run, f"s{run}")] * 2, "path string, last_modified string, file_size long, stage string, error_class string, blocker string, mime_type string, error string, skip_after long, last_scan_id long, last_seen string")
    attempts = lambda df: [(r.id, r.attempts) for r in df.collect()]
    assert attempts(ledgers.record_scan_errors(c, again(7))) == [(1, 1)]  # the same run counts once
    assert attempts(ledgers.record_scan_errors(c, again(8))) == [(1, 2)]
    assert attempts(ledgers.record_scan_errors(c, again(8, "t2"))) == [(1, 1)]  # another state of the file
    later = c.but(scan_errors=ledgers.record_scan_errors(c, again(8)))
    stat = spark.createDataFrame([("/a", "t1", 5), ("/a", "t2", 5), ("/b", "t1", 5)], "path string, last_modified string, file_size long")
    assert [tuple(r) for r in ledgers.suppressed(later, stat).collect()] == [("/a", "t1", 5)] and ledgers.suppressed(c, stat).count() == 0
    tried = made(spark, visual_attempts=[("a", "thumb", None, 3, None, None, 1, 1)])
    wanted = spark.createDataFrame([("a", "thumb"), ("b", "thumb")], "item_sha256 string, kind string")
    assert ledgers.visuals_suppressed(tried, wanted, 3).count() == 1 and ledgers.visuals_suppressed(tried, wanted, 4).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [float("nan"), 1.0])], "id long, v array<float>")
    l2 = {r.id: r.d for r in rows.select("id", vectors.distance_to(F.col("v"), [1, 0]).alias("d")).collect()}
    assert l2[1] == 0 and abs(l2[2] - 5**0.5) < 1e-12 and l2[3] is None and l2[4] is None and l2[5] == 1 and l2[6] is None
    cos = {r.id: r.d for r in rows.select("id", vectors.distance_to(F.col("v"), [1, 0], vectors.COSINE).alias("d")).collect()}
    assert cos[1] == 0 and cos[2] == 1 and cos[5] is None
    both = rows.select("id", vectors.distance(F.col("v"), F.col("v")).alias("d")).collect()
    assert [r.d for r in both if r.id in (1, 2, 4)] == [0, 0, 0]
    assert vectors.scale_from_absmax(None) == 1.0 and vectors.scale_from_absmax(float("inf")) == 1.0 and vectors.scale_from_absmax(0.0) == 1.0
    coded = {r.id: r.q for r in rows.select("id", vectors.quantize(F.col("v"), vectors.scale_from_absmax(2.0)).alias("q")).collect()}
    assert coded[1] == [64, 0] and coded[2] == [0, 127] and coded[3] is None


def test_steps_row_by_row(spark):
    rows = spark.createDataFrame([(1, [1.0, -0.25], 0.5), (2, None, 2.0), (3, [float("nan"), 900.0, 3.0], 2.0), (4, [], 1.0)], "id long, v array<float>, s double")
    coded = {r.id: r.q for r in rows.coalesce(1).select("id", vectors.quantize(F.col("v"), F.col("s")).alias("q")).collect()}
    assert coded == {1: [2, 0], 2: None, 3: [0, 127, 2], 4: []}


def test_codes_joined_by_shuffles(spark):
    # tables too large for a broadcast: codes of several spaces are joined to the vectors by id
    ids = {i: 3 if i % 50 == 0 else 1 + i % 2 for i in range(1, 301)}
    c = made(spark, setters=[(1, "m"), (2, "n"), (3, "small")], item_data=[(i, i, 1, s, "clip") for i, s in ids.items()], embeddings=[(i, [float(i), -1.0][: 1 + s % 2]) for i, s in ids.items()])
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        codes, steps = quants.encode(c, least=100)
        assert set(steps) == {"m", "n"} and codes.count() == 294
        done = quants.finished(c.but(embedding_quants=codes.drop("setter")), 1, 1, least=6)
        assert sorted(map(tuple, done.collect())) == [("m", 144, 0, "ready"), ("n", 150, 0, "ready"), ("small", 6, 6, "building")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert quants.encode(c, least=1000)[0].count() == 0


def test_npy():
    import io

    def dump(x):
        buffer = io.BytesIO()
        np.save(buffer, x)
        return buffer.getvalue()

    assert vectors.load_npy(dump(np.array([1, 2], dtype=np.int8))).tolist() == [1, 2]
    assert vectors.load_npy(dump(np.asfortranarray([[1.5, 2], [3, 4]]))).tolist() == [1.5, 2]
    assert vectors.load_npy_rows(dump(np.array([[1, 2], [3, 4]], dtype=np.float16))) == [[1, 2], [3, 4]]
    for bad in (np.zeros((2, 2, 2)), np.zeros(0), np.array(["x"])):
        with pytest.raises(ValueError):
            vectors.load_npy(dump(bad))
    with pytest.raises(ValueError):
        vectors.load_npy_rows(dump(np.array([1, 2])))


def test_readiness_and_reconcile(spark):
    c = made(spark, setters=[(1, "m"), (2, "tm")], vector_quant_profiles=[(5, "int8", "int8", "{}", "active", True)], vector_quant_coverage=[(5, 1, True, 0.5, 1, 1, 4, "L2", "ready"), (5, 2, True, 0.5, 1, 1, 4, "L2", "building")])
    assert quants.ready(c, ["m"]) == (5, 0.5) and quants.ready(c, ["m", "tm"]) is None and quants.ready(c, ["m"], "other") is None
    want = {"int8": {"quantizer": "int8", "options": "{}", "is_default": True, "spaces": ["a", "b"]}}
    have = {"int8": want["int8"] | {"ready": ["a"]}, "old": {}}
    plan = quants.reconcile(want, have)
    assert plan == {"create": [], "update": [], "remove": ["old"], "build": [("int8", "b")]}
    assert quants.reconcile(want, {})["create"] == ["int8"]


def test_model_outputs(spark):
    scores = spark.createDataFrame([([0.9, 0.85, 0.3, 0.2],), ([0.5],), ([],), ([0.4, 0.4],)], "s array<double>")
    assert [round(r.m, 6) for r in scores.select(outputs.mcut(F.col("s")).alias("m")).collect()] == [0.575, 0.5, 0.0, 0.4]
    assert outputs.chunk_tokens(list(range(10)), 9) == [list(range(7)), [7, 8, 9]] and outputs.chunk_tokens(list(range(9)), 9) == [list(range(9))] and outputs.chunk_tokens([], 9) == [[]]
    assert outputs.combined([[1, 2], [3, 4]], 2)[-1] == [2, 3] and len(outputs.combined([[1], [2]], -1)) == 2
    texts = spark.createDataFrame([(1, 0, " Ok "), (1, 1, "日"), (1, 2, "Word"), (1, 3, "wORD"), (1, 4, None)], "item_id long, idx long, text string")
    assert sorted(r.text for r in outputs.clean_texts(texts).collect()) == ["Word", "日"]
    frames = spark.createDataFrame([(1, 0, "rating", "safe", 0.9), (1, 0, "rating", "mature", 0.2), (1, 1, "rating", "mature", 0.6), (1, 0, "general", "cat", 0.5), (1, 1, "general", "cat", 0.7), (1, 1, "general", "dog", 0.6)], "item_id long, frame long, namespace string, name string, score double")
    got = [(r.namespace, r.name, r.confidence) for r in outputs.aggregate_tags(frames, ["safe", "mature"]).orderBy("at").collect()]
    assert got == [("general", "cat", 0.7), ("general", "dog", 0.6), ("rating", "rating:mature", 0.6)]
    double = outputs.Extractor("text", "text", lambda f: pd.DataFrame({"n": f["n"] * 2}), "n long")
    assert [r.n for r in double.run(spark.createDataFrame([(1,), (2,)], "n long")).collect()] == [2, 4]


def test_media():
    dark = np.full((60, 96, 48, 3), (200, 100, 50), dtype=np.uint8)
    card = np.full((60, 96, 48, 3), media.CARD, dtype=np.uint8)
    card[:, 45:50, 10:30] = 255
    assert media.outro(np.concatenate([dark, card])) == (2.0, "card")
    assert media.outro(card)[1] == "no boundary" and media.outro(dark)[1] == "no run"
    assert media.outro(np.concatenate([dark, np.repeat(card, 3, axis=0)]))[1] == "too long"
    busy = card.copy()
    busy[:, :70, 0] = 255
    assert media.outro(np.concatenate([dark, busy]))[1] == "layout"
    code = media.blurhash(np.full((8, 8, 3), 255, dtype=np.uint8))
    assert len(code) == 6 + 2 * 11 and code[0] == "L" and media.blurhash(np.full((8, 8, 3), 255, dtype=np.uint8), 1, 1) == "00TSUA"


def test_folder_listing(spark, tmp_path):
    for name, data in (("a.PNG", b"one"), ("sub/b.mp4", b"two"), (".hidden.png", b"x"), ("__MACOSX/c.png", b"x"), ("note.xyz", b"x"), ("d.png.part", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in media_files.listing(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.PNG", "b.mp4"} and got["a.PNG"].type == "image/png" and got["b.mp4"].file_size == 3
    assert got["a.PNG"].md5 == "f97c5d29941bfb1b2fdab0874906ab82"
    heads = spark.createDataFrame([(bytearray(b"\x00\x05\x16\x07x"),), (bytearray(b" <!DOCTYPE HTML>"),), (bytearray(b"PNG"),)], "c binary")
    assert [r.s for r in heads.select(media_files.sniffed(F.col("c")).alias("s")).collect()] == ["apple-double", "html", None]


def test_ingest_helpers(spark):
    assert ingest.dedupe_roots(["/b/", "/a", "/a/x", "/ab", "", "C:\\d\\e", "C:\\d"]) == ["/a/", "/ab/", "/b/", "C:/d/"]
    now = spark.createDataFrame([("/a", True), ("/b", False)], "path string, included boolean")
    want = spark.createDataFrame([("/a", True), ("/c", True)], "path string, included boolean")
    assert {(r.path, r.change) for r in ingest.folder_changes(now, want).collect()} == {("/a", "keep"), ("/b", "remove"), ("/c", "add")}
    c = made(spark, data_jobs=[(1, 0), (2, 1)], data_log=[(1, 1), (2, 2)], item_data=[(1, 1, 1, 1, "text"), (2, 1, 2, 1, "text"), (3, 1, 2, 1, "text-embedding", 0, 1)])
    after = ingest.clean_incomplete(c)
    assert [r.id for r in after["item_data"].collect()] == [2] and after["data_jobs"].count() == 1
    assert {r.id: r.completed for r in ingest.clean_incomplete(c, drop=False)["data_jobs"].collect()} == {1: -1, 2: 1}


def test_change_events(spark):
    raw = spark.createDataFrame([(1, "create", "/a", None), (2, "rename", "/b", "/a"), (3, "overflow", "/", None), (4, "chmod", "/x", None)], "ts long, kind string, path string, old_path string")
    got = [(r.path, r.change) for r in changes.events(raw).orderBy("ts", "path").collect()]
    assert got == [("/a", "upsert"), ("/a", "remove"), ("/b", "upsert"), ("/", "rescan")]
    assert {(r.path, r.change) for r in changes.latest(changes.events(raw)).collect()} == {("/a", "remove"), ("/b", "upsert"), ("/", "rescan")}
    assert [changes.backoff(n) for n in (0, 1, 4, 9)] == [2, 4, 32, 60]
    dirs = spark.createDataFrame([("/a", 100), ("/b", 99)], "dir string, dir_modified long")
    assert {r.dir: r.dir_modified for r in changes.settled_dirs(dirs, 102).collect()} == {"/a": None, "/b": 99}


def _stream(spark, tmp_path, batches, schema):
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        part.rename(source / f"{i}.parquet")
        import os

        os.utime(source / f"{i}.parquet", (1000 + i, 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def test_stream_settles(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    batches = [[("/a", "upsert", at(0)), ("/b", "upsert", at(0))], [("/a", "remove", at(1))], [("/z", "upsert", at(30))], [("/z", "upsert", at(59))], [("/y", "upsert", at(59))]]
    stream = _stream(spark, tmp_path, batches, "path string, change string, ts timestamp")
    query = changes.settled(stream.withWatermark("ts", "1 second")).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.path, r.change) for r in spark.table("settled").collect()}
    assert {("/a", "remove"), ("/b", "upsert")} <= got and ("/a", "upsert") not in got


def test_stream_windows_drop_late_rows(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2026, 1, 1, h, m)
    batches = [[(1, at(0, 5), "a", 1.0), (1, at(0, 50), "a", 2.0)], [(2, at(3), "a", 1.0)], [(2, at(4), "b", 1.0)], [(3, at(0, 10), "a", 9.0), (3, at(6), "a", 1.0)], [(4, at(9), "b", 1.0)]]
    stream = _stream(spark, tmp_path, batches, "user_id long, ts timestamp, event_type string, value double")
    query = changes.tumbling(stream).writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.start.hour, r.n, r.total) for r in spark.table("hourly").collect()}
    assert (0, 2, 3.0) in got and (3, 1, 1.0) in got


def test_foreach_batch_upsert(spark):
    held = {"t": spark.createDataFrame([("/a", "old", 0)], "path string, change string, ts long")}
    sink = changes.upserting(lambda: held["t"], lambda df: held.update(t=spark.createDataFrame(df.collect(), df.schema)), "path")
    batch = spark.createDataFrame([("/a", "x", 1), ("/a", "y", 2), ("/b", "z", 1)], "path string, change string, ts long")
    for _ in range(2):  # a replay changes nothing
        sink(batch, 0)
        assert {tuple(r) for r in held["t"].collect()} == {("/a", "y", 2), ("/b", "z", 1)}


def test_save_and_inline_codes(spark, tmp_path):
    c = made(spark, setters=[(1, "m"), (2, "n")], vector_quant_coverage=[(5, 1, True, 0.5, 1, 1, 2, "L2", "ready")])
    c.save(str(tmp_path), "setters")
    again = Catalog(spark, str(tmp_path), absent=["tags"])
    assert again["setters"].count() == 2 and again["tags"].count() == 0
    with pytest.raises(AnalysisException):
        again["files"]
    again.but(setters=again["setters"].where("id = 1")).save(str(tmp_path), "setters")
    assert Catalog(spark, str(tmp_path))["setters"].count() == 1
    new = spark.createDataFrame([(1, 1, [1.0, -0.25]), (2, 2, [1.0, 1.0]), (3, 1, [1.0])], "id long, setter_id long, embedding array<float>")
    assert [(r.id, r.quant) for r in quants.inline(new, c, 5).collect()] == [(1, [2, 0])]
    assert quants.inline(new, c, 9).count() == 0
    with pytest.raises(ValueError):
        ingest.inputs(c, new.withColumn("item_id", F.lit(1)), "nope")
