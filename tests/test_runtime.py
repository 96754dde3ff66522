"""Session facts, absent tables, blocks of a large target."""

import re

import pytest
from pyspark.errors import AnalysisException

from catalore.plans import filters, runtime
from catalore.plans.compile import search
from catalore.sources.catalog import SCHEMAS, Catalog


class _Cluster:
    """A session whose cluster names no shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class conf:  # noqa: N801
        get = staticmethod(lambda name, default=None: default)


def test_no_own_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(_Cluster)


def test_few(spark):
    assert runtime.few(spark.range(3), 3) and not runtime.few(spark.range(4), 3)


def test_tables_are_absent_only_if_named(spark, tmp_path):
    with pytest.raises(AnalysisException):
        Catalog(spark, str(tmp_path / "typo"))["files"]
    assert Catalog(spark, str(tmp_path), absent=["files"])["files"].count() == 0
    with pytest.raises(ValueError):
        Catalog(spark, absent=["filse"])
    spark.range(1).write.parquet(str(tmp_path / "files.parquet"))
    with pytest.raises(AnalysisException):
        Catalog(spark, str(tmp_path))["files"]  # columns are missing


def test_large_target_in_blocks(spark, monkeypatch):
    rows = {
        "files": [(i, f"h{i}", i, f"/{i}", f"{i}", None, 1, True) for i in (1, 2, 3)],
        "items": [(i, f"h{i}", *[None] * 15) for i in (1, 2, 3)],
        "setters": [(1, "m")],
        "item_data": [(10 * i + j, i, 1, 1, "clip", j, None, True, False) for i in (1, 2, 3) for j in range(5)],
        "embeddings": [(10 * i + j, [float(i), float(j)]) for i in (1, 2, 3) for j in range(5)],
    }
    cat = Catalog(spark, tables={n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()})
    query = {"query": {"similar_to": {"target": "h1", "model": "m", "index": "exact"}, "select_as": "d"}, "page_size": 0}
    whole = sorted((r.item_id, round(r.d, 9)) for r in search(cat, query).collect())
    monkeypatch.setattr(filters, "TARGET_ROWS", 2)
    assert sorted((r.item_id, round(r.d, 9)) for r in search(cat, query).collect()) == whole and len(whole) == 2


def test_no_exchange_carries_vectors(spark, small):
    from catalore.registry.searches import registered

    for name in ("text_embeddings", "similar_to_l2"):
        df = registered()[name][0](spark, small)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        inputs = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
        assert inputs and not any(re.search(r"(embedding|vec)#", columns) for columns in inputs), inputs
