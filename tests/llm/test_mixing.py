from collections import Counter

import pytest

from catalore.llm import mixing
from catalore.llm.mixing import mix, p7_found, segments, shares

DOCS = "doc_id long, text string, source string, n_tokens long, key string"


def tables(spark):
    rows = [(i, f"plain words number {i} here", ["alpha", " Alpha ", "ALPHA"][i % 3], 0, "k") for i in range(300)]
    rows += [(1000 + i, f"beta words number {i} in this", "beta-two", 0, "k") for i in range(60)]
    rows += [(2000, None, "alpha", 0, "k"), (2001, "", "alpha", 0, "k"), (2002, "stray words", None, 0, "k"), (2003, "other words", "gamma", 0, "k")]
    targets = [("alpha", 0.5, 1), ("beta_two", 0.4, 3), ("delta", 0.05, 5), ("gamma", 0.0, None), ("epsilon", None, 1), (None, 0.05, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_found_and_shares(spark):
    docs, targets = tables(spark)
    assert sorted(r.source for r in p7_found(docs, targets).collect()) == ["delta"]
    got = {r.source: r for r in shares(docs, targets).collect()}
    assert abs(got["alpha"].reached - 0.5) < 0.01 and abs(got["beta_two"].reached - 0.4) < 0.01
    assert got["beta_two"].most_repeats == 2 and got["alpha"].most_repeats == 1 and got["delta"].n_tokens == 0


def test_order_and_repeats(spark):
    docs, targets = tables(spark)
    rows = mix(docs, targets, {"alpha": (0.0, 1.0), "beta_two": (1.0, 0.0)}).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    assert max(Counter((r.doc_id, r.repeat) for r in rows).values()) == 1
    assert max(Counter(r.doc_id for r in rows if r.source == "beta_two").values()) <= 3
    early = Counter(r.source for r in rows[: len(rows) // 4])
    late = Counter(r.source for r in rows[-len(rows) // 4 :])
    assert early["beta_two"] > 2 * early["alpha"] and late["alpha"] > 2 * late["beta_two"]


def test_repeated_rows_and_empty(spark):
    docs, targets = tables(spark)
    twice = docs.unionByName(docs)
    assert sum(r.n_tokens for r in shares(twice, targets).collect()) > 0
    assert mix(docs.limit(0), targets).count() == 0 and p7_found(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0


def test_segments_integrate_to_one():
    s = segments((0.5, 1.5, 0.5))
    assert s[0][4] == 0 and s[-1][5] == 1 and abs(sum((a[2] + a[3]) / 2 * (a[1] - a[0]) for a in s) - 1) < 1e-12


def test_found_comes_from_the_mix(spark, monkeypatch):
    docs, targets = tables(spark)
    whole = mixing._mixed
    monkeypatch.setattr(mixing, "_mixed", lambda *args, **more: whole(*args, **more).where("source <> 'alpha'"))
    assert sorted(r.source for r in p7_found(docs, targets).collect()) == ["alpha", "delta"]


def test_sources_without_a_schedule_stay_flat(spark):
    docs, targets = tables(spark)
    rows = mix(docs, targets, {"beta_two": (0.0, 1.0)}).collect()
    early = Counter(r.source for r in rows if r.position < 0.5)
    whole = Counter(r.source for r in rows)
    assert abs(early["alpha"] / whole["alpha"] - 0.5) < 0.03 and abs(early["beta_two"] / whole["beta_two"] - 0.25) < 0.03
    for wrong in ((), (1.0,), (0.0, 0.0), (1.0, -1.0)):
        with pytest.raises(ValueError):
            segments(wrong)
