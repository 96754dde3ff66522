import random
from collections import Counter

from hypothesis import given, settings, strategies as st

from catalore.llm.packing import fill, pack, plan
from catalore.llm.tokens import encoding


def loads(sizes, capacity):
    rows, bins = plan(Counter(sizes), capacity)
    load, large, seen = Counter(), Counter(), Counter()
    for s, low, high, first, each in rows:
        for r in range(low, high):
            seen[s] += 1
            load[first + (r - low) // each] += s
            large[first + (r - low) // each] += 3 * s > capacity
    assert seen == Counter(sizes)
    return load, large, bins


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=200))))
def test_plan_places_each_once_within_capacity(case):
    capacity, sizes = case
    load, large, bins = loads(sizes, capacity)
    assert all(v <= capacity for v in load.values()) and all(v <= 2 for v in large.values())
    assert sorted(load) == list(range(bins))


def test_plan_is_no_worse_than_first_fit_decreasing():
    random.seed(2)
    for _ in range(30):
        sizes = [random.randint(1, 200) for _ in range(500)]
        gaps: list[int] = []
        for s in sorted(sizes, reverse=True):
            at = next((i for i, g in enumerate(gaps) if g >= s), None)
            if at is None:
                gaps.append(200 - s)
            else:
                gaps[at] -= s
        assert loads(sizes, 200)[2] <= len(gaps) + 1


def test_pack(spark):
    text = "word " * 30
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 5000, "x"), (None, "alone", "x")] + [(i, "word " * (i % 90), "x") for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = pack(docs, 100).collect()
    count = lambda t: len(encoding().encode_ordinary(t or ""))
    assert sum(r.n_tokens for r in got) == sum(count(t) for _, t, _ in rows)
    load = Counter()
    for r in got:
        load[r.container] += r.n_tokens
    assert max(load.values()) <= 100
    assert all(r.piece == 0 for r in got if r.doc_id != 4) and sorted(r.piece for r in got if r.doc_id == 4) == list(range(-(-count("word " * 5000) // 100)))
    assert {r.container for r in got if r.doc_id in (2, 3)} == {0} and sum(r.doc_id == 1 for r in got) == 2
    report = fill(pack(docs, 100), 100).first()
    assert report.fill > 0.97 and report.containers >= report.least


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs).count() == 0 and fill(pack(docs)).first().containers == 0
