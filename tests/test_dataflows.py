"""Registered data flows over tables of their own."""

import pytest

from catalore.operators import ingest
from catalore.registry import registered
from catalore.sources.catalog import Catalog

ROWS = [
    (1, 7, "A long opening, then one end"), (2, 7, "A long opening, then another"), (3, 7, "a LONG opening, then one end "),
    (4, 8, " " * 14 + "late words"), (5, 8, None), (6, 9, " " * 20), (7, None, "Of no item"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(ROWS, "doc_id long, item_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i,) for i in (7, 8, 9)], "id long").write.parquet(f"{path}/items.parquet")
    return path


def rows(spark, folder, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registered()[name][0](spark, folder).collect())


def test_whole_texts_are_compared(spark, folder):
    assert rows(spark, folder, "clean_texts", "item_id", "idx", "text") == [(7, 1, ROWS[0][2]), (7, 2, ROWS[1][2]), (8, 4, "late words")]
    assert rows(spark, folder, "item_data_rows", "id", "item_id", "idx", "source_id") == [(5000, 7, 1, 1), (5001, 7, 2, 2), (5002, 8, 4, 4)]
    assert [r for r in rows(spark, folder, "placeholders", "item_id", "is_placeholder") if r[1]] == [(9, True)]


def test_deletion_follows_sources_to_the_end(spark):
    chain = [(1, 7, None), *[(i, 8, i - 1) for i in range(2, 9)], (20, 8, 21), (21, 8, 20), (22, 8, 20), (30, 8, None), (31, 8, 30)]
    data = spark.createDataFrame(chain, "id long, item_id long, source_id long")
    c = Catalog(spark).but(item_data=data)
    gone = spark.createDataFrame([(1,), (20,)], "id long")
    assert sorted(r.id for r in ingest.cascade(c, data=gone)["item_data"].collect()) == [30, 31]
    assert 8 not in {r.id for r in ingest.cascade(c, items=spark.createDataFrame([(7,)], "id long"))["item_data"].collect()}


def test_chunks_like_the_plain_rule(spark):
    from catalore.operators import outputs

    cases = [[], [1], list(range(9)), list(range(10)), list(range(11)), list(range(21)), list(range(29)), list(range(300))]
    rows = spark.createDataFrame([*enumerate(cases), (99, None)], "source_id long, tokens array<int>")
    for size in (3, 10, 100):
        got = {}
        for r in outputs.chunks(rows, size).orderBy("source_id", "chunk").collect():
            got.setdefault(r.source_id, []).append(list(r.tokens))
        assert got == {i: outputs.chunk_tokens(t, size) for i, t in enumerate(cases)}


def test_combined_vectors_like_the_plain_rule(spark):
    from catalore.operators import outputs

    given = {1: [[1.0, 2.0]], 2: [[1.0, 0.0], [0.0, 1.0]], 3: [[3.0, 3.0], [0.0, 0.0], [6.0, 3.0]]}
    rows = spark.createDataFrame([(s, i, v) for s, vs in given.items() for i, v in enumerate(vs)], "source_id long, chunk int, embedding array<double>")
    for at in (-1, 1, 2, 3):
        got = {}
        for r in outputs.combined_vectors(rows, at).orderBy("source_id", "chunk").collect():
            got.setdefault(r.source_id, []).append(list(r.embedding))
        assert got == {s: outputs.combined(v, at) for s, v in given.items()}


def test_pictures_and_end_cards(spark):
    import numpy as np

    from catalore.operators import media

    white = bytearray(b"\xff" * 48)
    pictures = spark.createDataFrame([(1, white, 4, 4), (2, white, 5, 4), (3, None, 4, 4), (4, white, None, 4)], "item_id long, pixels binary, height int, width int")
    assert {r.item_id: r.blurhash for r in media.blurhashes(pictures, 1, 1).collect()} == {1: "00TSUA", 2: None, 3: None, 4: None}
    dark, card = np.zeros((30, 24, 24, 3), np.uint8) + 90, np.full((60, 24, 24, 3), media.CARD, np.uint8)
    clips = [(1, bytearray(np.concatenate([dark, card]).tobytes()), 24, 24, 10_000), (2, bytearray(dark.tobytes()), 24, 24, 10_000), (3, bytearray(b"x"), 24, 24, 1), (4, None, 24, 24, 1), (5, bytearray(np.concatenate([dark, card]).tobytes()), 24, 24, None)]
    rows = media.outros(spark.createDataFrame(clips, "item_id long, frames binary, height int, width int, duration_ms long")).collect()
    assert {r.item_id: (r.content_end_ms, r.outro_kind, r.reason) for r in rows} == {1: (8000, "card", "card"), 2: (None, None, "no run"), 3: (None, None, "no frames"), 4: (None, None, "no frames"), 5: (None, "card", "card")}


def test_second_look(spark):
    from catalore.operators import ingest

    rows = spark.createDataFrame([("/a", 800, "x"), ("/b", 100, "y"), ("/c", None, "x")], "path string, width long, sha256 string")
    ok = lambda rules: {r.path for r in ingest.media_allowed(rows, rules).collect() if r.allowed}
    assert ok(None) == {"/a", "/b", "/c"} and ok({"match": {"gt": {"width": 500}}}) == {"/a", "/c"} and ok({"match": {"eq": {"sha256": "x"}}}) == {"/a", "/c"}
    assert ok({"match": {"gt": {"height": 5}}}) == {"/a", "/b", "/c"}  # not delivered, so not judged
