import pytest

from catalore.functions import fts
from catalore.functions.mixing import MASK, mix64, pk_mix, signed
from catalore.functions.text import escape_like, hex_prefix, like, prefix_upper_bound, starts_in
from catalore.plans import ranks
from catalore.plans.compile import counted, search
from catalore.plans.match import condition, scanned
from catalore.plans.model import Group, Leaf, Match, QueryError, decode, element, prune
from catalore.plans.service import Cache, Engine, user_data
from catalore.sources.catalog import Catalog
from pyspark.sql import functions as F

LEAVES = [
    {"match": {"eq": {"type": "a"}}}, {"match_path": {"match": "x"}}, {"match_text": {"match": "x"}}, {"match_tags": {"tags": ["a"]}}, {"in_bookmarks": {}}, {"in_pinboard": {}},
    {"processed_by": "m"}, {"failed_for": "m"}, {"has_data_unprocessed": {"setter_name": "m", "data_types": ["text"]}}, {"text_embeddings": {"query": [1.0], "model": "m"}},
    {"image_embeddings": {"query": [1.0], "model": "m"}}, {"similar_to": {"target": "t", "model": "m"}},
]


@pytest.mark.parametrize("leaf", LEAVES, ids=lambda x: next(iter(x)))
def test_each_leaf_decodes_to_itself(leaf):
    node = element(leaf)
    assert isinstance(node, Match) if "match" in leaf else node.name == next(iter(leaf))
    assert prune(node) is not None


@pytest.mark.parametrize("bad", [{}, {"x": 1}, {"match": {"eq": {"nope": 1}}}, {"match": {"like": {"path": "x"}}}, {"match_path": {"match": "x", "y": 1}}, {"processed_by": "m", "order_by": True}, {"match_path": {"match": "x"}, "direction": "up"}, {"match_path": {"match": "x"}, "match_text": {"match": "y"}}, {"and_": [], "or_": []}])
def test_faulty_elements(bad):
    with pytest.raises(QueryError):
        element(bad)


@pytest.mark.parametrize("bad", [{"entity": "x"}, {"select": ["text"]}, {"order_by": [{"order_by": "setter_name"}]}, {"partition_by": ["data_id"]}, {"foo": 1}, {"order_by": [{"order_by": "nope"}]}])
def test_faulty_queries(bad):
    with pytest.raises(QueryError):
        decode(bad)


def test_defaults():
    q = decode({})
    assert q.order_by == [{"order_by": "last_modified", "order": "desc", "priority": 0}] and q.page_size == 10 and q.select == ["sha256", "path", "last_modified", "type"]
    assert decode({"order_by": [{"order_by": "size"}]}).order_by[0]["order"] == "asc" and decode({"page": -3}).page == 1
    assert element({"text_embeddings": {"query": [1], "model": "m"}}).sort["order_by"] and not element({"match_text": {"match": "x"}}).sort["order_by"]
    assert element({"match_tags": {"tags": ["x"]}}).sort["direction"] == "desc"


def test_pruning():
    empty = {"match_path": {"match": " "}}
    assert prune(element({"and_": [empty, {"or_": [empty]}]})) is None
    assert isinstance(prune(element({"and_": [empty, {"processed_by": "m"}]})), Leaf)
    assert prune(element({"not_": empty})) is None and isinstance(prune(element({"not_": {"processed_by": "m"}})), Group)
    assert prune(element({"match": {"and_": [{"eq": {}}, {"eq": {"size": 1}}]}})).kind == "ops"


def test_like_is_raw(spark):
    rows = spark.createDataFrame([("C:\\data\\x",), ("C:\\dataset",), ("c:\\data",), ("100%",), (None,)], "p string")
    assert [r.p for r in rows.where(like(F.col("p"), "C:\\data%")).collect()] == ["C:\\data\\x", "C:\\dataset"]
    assert rows.where(like(F.col("p"), "1_0%")).count() == 1


def test_three_valued_logic(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id long, width long")
    node = element({"match": {"not_": {"gt": {"width": 10}}}})
    assert [r.id for r in rows.where(condition(node, F.col)).collect()] == [1]
    node = element({"match": {"gt": {"width": 10}, "eq": {"md5": "x"}}})
    assert sorted(r.id for r in rows.where(scanned(node, {"width"})).collect()) == [2, 3]  # what a record lacks does not judge it
    with pytest.raises(QueryError):
        condition(element({"match": {"in_": {"width": []}}}), F.col)
    with pytest.raises(QueryError):
        condition(element({"match": {"eq": {"width": "wide"}}}), F.col)


def test_prefixes(spark):
    assert prefix_upper_bound("abc") == "abd" and prefix_upper_bound("a" + chr(0x10FFFF)) == "b" and prefix_upper_bound(chr(0x10FFFF)) is None and prefix_upper_bound("a\ud7ff") == "a\ue000"
    assert escape_like("50%_\\") == "50\\%\\_\\\\"
    rows = spark.createDataFrame([("abc1",), ("abd",), ("ABC1",), (None,)], "h string")
    assert [r.h for r in rows.where(starts_in(F.col("h"), "abc")).collect()] == ["abc1"]
    assert rows.where(hex_prefix(F.col("h"), "ABC")).count() == 1 and rows.where(hex_prefix(F.col("h"), "xyz")).count() == 0


def test_mixer(spark):
    assert signed(mix64(1 ^ mix64(42))) == -914255856146365723 and signed(mix64(2 ^ mix64(42))) == 8238092213399105094
    rows = spark.createDataFrame([(0,), (12345,), (2**63 - 1,), (None,)], "id long")
    assert [r.m for r in rows.select(pk_mix(F.col("id"), 0).alias("m")).collect()][0] == -6411193824288604561
    assert [r.m for r in rows.select(pk_mix(F.col("id"), -7).alias("m")).collect()][1] == 6563235708035645175
    assert [r.m for r in rows.select(pk_mix(F.col("id"), -(2**63)).alias("m")).collect()][2:] == [signed(mix64((2**63 - 1) ^ mix64(-(2**63) & MASK))), None]
    spread = spark.range(1, 100001).select(pk_mix(F.col("id"), 9).alias("m")).groupBy(F.pmod("m", F.lit(16))).count().collect()
    assert sum(r["count"] for r in spread) == 100000 and all(5600 < r["count"] < 6900 for r in spread)
    assert spark.range(1, 100001).select(pk_mix(F.col("id"), 9).alias("m")).distinct().count() == 100000


def test_fts_syntax():
    assert fts.parse("a OR b AND c NOT d") == fts.Either(fts.Phrase("a"), fts.Both(fts.Phrase("b"), fts.Without(fts.Phrase("c"), fts.Phrase("d"))))
    assert fts.parse('"two ""words""" (x OR y*)') == fts.Both(fts.Phrase('two "words"'), fts.Either(fts.Phrase("x"), fts.Phrase("y")))
    assert fts.parse("ab + cd") == fts.Phrase("abcd")
    for bad in ("(a", "AND a", "a OR", "NEAR()", "NEAR(a b, x)", "NEAR(a b", "{a b} c", "{} : c", "- a", "a:", '"open', ")", "a +"):
        with pytest.raises(fts.QueryError):
            fts.parse(bad)
    assert fts.parse("NEAR(a b, 5)") == fts.parse("NEAR(a b,5)") == fts.parse("NEAR(a b , 5)") == fts.Near((fts.Phrase("a"), fts.Phrase("b")), 5) and fts.parse('NEAR("a b" c)').most == 10
    assert fts.parse("path: a b") == fts.Both(fts.Phrase("a", ((("path",), False),)), fts.Phrase("b"))
    assert fts.parse("- {path name} : (a OR b)") == fts.Either(fts.Phrase("a", ((("path", "name"), True),)), fts.Phrase("b", ((("path", "name"), True),)))
    assert fts.parse("near AND NEAR") == fts.Both(fts.Phrase("near"), fts.Phrase("NEAR"))
    assert fts.escape('some "two words" more') == '"some" "two words" "more"' and fts.escape('odd " quote') == '"odd" " quote"' and fts.escape("it's") == '"it\'s"'


def test_fts_matching(spark):
    rows = spark.createDataFrame([(1, "Winter Album"), (2, "the winter"), (3, "ab"), (4, None), (5, ""), (6, "ananas banana")], "id long, t string")
    hit = lambda q: sorted(r.id for r in rows.where(fts.matches(fts.parse(q), ["t"])).collect())
    assert hit("WINTER") == [1, 2] and hit("winter album") == [1] and hit("winter NOT album") == [2] and hit("ab") == [] and hit("bum OR nana") == [1, 6]
    ranked = fts.bm25(rows, fts.parse("ana"), ["t"]).collect()
    assert [r.id for r in ranked] == [6] and ranked[0]["rank"] < 0
    assert hit("NEAR(winter album, 2)") == [] and hit("NEAR(winter album, 3)") == [1] and hit("NEAR(album winter)") == [1] and hit("t: winter NOT t: album") == [2]
    with pytest.raises(QueryError):
        fts.bm25(rows, fts.parse("u: winter"), ["t"])
    marked = rows.where("id = 1").select(fts.snippet(F.col("t"), fts.parse("album"), 30).alias("s")).first().s
    assert marked == "Winter <b>Album</b>"


def test_bm25_formula(spark):
    import math

    texts = ["lantern lantern on the quay", "a lantern in the cellar of the old museum", "nothing to see here", "other words", "more other words", "the last one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r["rank"] for r in fts.bm25(rows, fts.parse("lantern"), ["t"]).collect()}
    sizes = [max(len(t) - 2, 0) for t in texts]
    idf = math.log((6 - 2 + 0.5) / (2 + 0.5))
    want = {i: -idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes[i] / (sum(sizes) / 6))) for i, f in ((0, 2), (1, 1))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_order_merging():
    f = [{"column": "a", "priority": 0}, {"column": "b", "priority": 5}, {"column": "c", "priority": 5}]
    a = [{"order_by": "size", "priority": 5}, {"order_by": "path", "priority": 9}]
    assert [[e.get("column") or e["order_by"] for e in g] for g in ranks.merge(f, a)] == [["path"], ["b", "c"], ["size"], ["a"]]


def test_fusion(spark):
    rows = spark.createDataFrame([(1, 1, 3), (2, 2, None), (3, None, 1), (4, None, None)], "id long, a long, b long")
    group = [{"column": "a", "direction": "desc", "rrf": {"k": 10, "weight": 0.5}}, {"column": "b", "direction": "desc", "rrf": None}]
    value, direction = ranks.fused(group)
    got = {r.id: r.v for r in rows.select("id", value.alias("v")).collect()}
    assert direction == "desc" and abs(got[1] - (0.5 / 11 + 1 / 4)) < 1e-12 and abs(got[2] - 0.5 / 12) < 1e-12 and got[4] < 1e-15
    least, _ = ranks.fused([{"column": "a", "direction": "asc"}, {"column": "b", "direction": "asc"}])
    most, _ = ranks.fused([{"column": "a", "direction": "desc"}, {"column": "b", "direction": "desc"}])
    assert [r.v for r in rows.select(least.alias("v")).collect()][:3] == [1, 2, 1] and [r.v for r in rows.select(most.alias("v")).collect()][:3] == [3, 2, 1]


def test_row_numbers_with_ties(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("v"))
    got = ranks.row_numbers(rows, [F.col("v").desc(), F.col("id").asc()], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001)) and [(-r.v, r.id) for r in got] == sorted((-r.v, r.id) for r in got)
    assert ranks.row_numbers(rows.limit(0), [F.col("v")], "n").count() == 0


def test_empty_catalogue(spark):
    empty = Catalog(spark)
    for leaf in LEAVES:
        q = {"query": leaf, "page_size": 5}
        assert search(empty, q).count() == 0 and counted(empty, q).first().total == 0


def test_engine_cache_seed_and_bookmarks(spark, small):
    from catalore.registry.derived import catalog

    versions = {"index": 1, "user": 1}
    engine = Engine(catalog(spark, small), versions=lambda: dict(versions))
    first = engine.search({"page_size": 5, "prefetch_rows": 20})
    again = engine.search({"page_size": 5, "page": 2})
    assert first.count == again.count and again.metrics.get("cached") and len(again.results) == 5
    versions["user"] = 2
    assert engine.search({"page_size": 5}).metrics.get("cached")  # reads no bookmarks
    versions["index"] = 2
    assert not engine.search({"page_size": 5}).metrics.get("cached")
    shuffled = engine.search({"order_by": [{"order_by": "random"}], "page_size": 3})
    assert 0 <= shuffled.seed < 1 << 53 and not shuffled.metrics.get("cached")
    assert engine.search({"page_size": 0}).results.count() == first.count  # all rows stay a DataFrame
    marked = engine.search({"page_size": 5}, bookmarks=True)
    assert [r.file_id for r in marked.results] == [r.file_id for r in first.results] and all(r.bookmarked in (True, False, None) for r in marked.results)
    assert engine.search({"count": False, "results": False}) .results == []
    assert user_data(element({"and_": [{"not_": {"in_pinboard": {}}}]})) and not user_data(element({"processed_by": "x"}))


def test_cache_spans():
    cache = Cache(2)
    cache.put("k", 0, list(range(20)), 20)
    assert cache.rows("k", 5, 10) == list(range(5, 15)) and cache.rows("k", 15, 10) is None
    cache.put("k", 20, [20, 21], 10)
    assert cache.rows("k", 20, 10) == [20, 21] and cache.rows("other", 0, 1) is None
    cache.put("a", 0, [], 5), cache.put("b", 0, [], 5)
    assert cache.rows("k", 0, 1) is None
