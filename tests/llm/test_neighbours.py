import numpy as np

from catalore.llm.neighbours import Index, p5_found, p5_nearest
from catalore.llm.vptree import Tree, chord
from pyspark.sql import functions as F

SCHEMA = "id long, model string, profile_id long, embedding array<float>, query_quant array<tinyint>, size long, rep long"


def cloud(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dim)) * 0.08
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(x, ids, cosine):
    s = x @ x.T
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(*np.nonzero(s >= cosine)) if ids[a] != ids[b]}


def test_pairs_and_odd_rows(spark):
    x = cloud()
    rows = [(i, "m", 1, (v * (i % 3 + 1)).tolist(), None, 1, 1) for i, v in enumerate(x)]
    rows += [(1000, "m", 1, None, [int(round(c * 100)) for c in x[0]], 1, 1), (1001, "m", 1, [0.0] * 16, None, 1, 1), (1002, "m", 1, [1.0] * 8, None, 1, 1), (1003, "m", 1, [float("nan")] * 16, [1] * 16, 1, 1), (1004, "m", 1, None, None, 1, 1), (None, "m", 1, x[0].tolist(), None, 1, 1), (1005, None, 1, x[0].tolist(), None, 1, 1)]
    rows += [(5, "m", 1, (x[5] * (5 % 3 + 1)).tolist(), None, 1, 1), (1006, "n", 1, x[0].tolist(), None, 1, 1)]  # a repeated row, another model
    got = {(r.id_a, r.id_b) for r in p5_found(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(np.vstack([x, x[:1]]), [*range(len(x)), 1000], 0.9)
    assert len(got & want) / len(want) > 0.97 and got <= want


def test_exact_copies_are_one_class(spark):
    x = cloud(60)
    rows = [(i, "m", 1, x[0].tolist(), None, 1, 1) for i in range(300, 340)] + [(i, "m", 1, v.tolist(), None, 1, 1) for i, v in enumerate(x)]
    index = Index(spark.createDataFrame(rows, SCHEMA))
    assert index.members.where("rep = 0").count() == 41 and index.classes.count() == 60
    pairs = {(r.rep_a, r.rep_b) for r in index.similar(0.9, 1.0).collect()}
    assert pairs == brute(x, list(range(60)), 0.9)


def test_nearest_recall_and_ties(spark):
    x = cloud(1200, 24, 2)
    rows = [(i, "m", 1, v.tolist(), None, 1, 1) for i, v in enumerate(x)]
    got = p5_nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.id for r in got} == {i for i in range(1200) if i % 50 == 0} and all(1 <= r.rank <= 10 for r in got)
    hits = []
    for i in range(0, 1200, 50):
        s = x @ x[i]
        s[i] = -2
        hits.append(len({r.neighbour for r in got if r.id == i} & set(np.argsort(-s)[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert p5_found(none).count() == 0 and p5_nearest(none).count() == 0


def test_factor_one_is_exact():
    x = cloud(900, 12, 5).astype(np.float32)
    tree = Tree(x, leaf=16)
    q, p, _ = tree.within(x, x, 0.8, 1.0)
    assert {(a, b) for a, b in zip(q, p) if a < b} == {(a, b) for a, b in brute(x.astype(float), list(range(900)), 0.8)}
    ids, best = tree.nearest(x, x[:50], 5, 1.0)
    assert np.allclose(best, -np.sort(-(x[:50] @ x.T), axis=1)[:, :5], atol=1e-5)


def test_equal_points_end_in_one_leaf():
    assert len(Tree(np.ones((500, 4), np.float32) / 2, leaf=8).leaves) == 1 and len(Tree(np.zeros((0, 4), np.float32)).leaves) == 1
    assert chord(1.0) == 0


def test_recall_over_many_shards(spark):
    x = cloud(3000, 24, 4)
    df = spark.createDataFrame([(i, "m", 1, v.tolist(), None, 1, 1) for i, v in enumerate(x)], SCHEMA)
    index = Index(df, shard_rows=60)
    assert len(index.routes["m"].leaves) > 30
    got = index.nearest(F.col("id") % 50 == 0, 10, 2.5).collect()
    hits = []
    for i in range(0, 3000, 50):
        s = x @ x[i]
        s[i] = -2
        hits.append(len({r.neighbour for r in got if r.id == i} & set(np.argsort(-s)[:10].tolist())) / 10)
    assert len(hits) == 60 and np.mean(hits) >= 0.9
    pairs = {(r.rep_a, r.rep_b) for r in index.similar(0.9, 1.0).collect()}
    assert pairs == brute(x, list(range(3000)), 0.9)


def test_split_shards_lose_nothing(spark):
    x = cloud(800, 16, 6)
    df = spark.createDataFrame([(i, "m", 1, v.tolist(), None, 1, 1) for i, v in enumerate(x)], SCHEMA)
    # a sample too small for the shards wanted: every shard is cut into blocks
    index = Index(df, sample_rows=16, shard_rows=20, most_rows=16)
    assert index.blocks["m"].max() > 3
    assert {(r.rep_a, r.rep_b) for r in index.similar(0.9, 1.0).collect()} == brute(x, list(range(800)), 0.9)
    near = {}
    for r in index.nearest(F.col("id") % 50 == 0, 5, 1.0).collect():
        near.setdefault(r.id, set()).add(r.neighbour)
    for i in range(0, 800, 50):
        s = x @ x[i]
        s[i] = -2
        assert near[i] == set(np.argsort(-s)[:5].tolist())
    sizes = index._routed(index.classes.select("rep", "model", "vec", F.lit(False).alias("asks")), "radius", (0, 0.1)).groupBy("shard").count().collect()
    assert sum(r["count"] for r in sizes) == 800 and max(r["count"] for r in sizes) <= 120
