import pytest

from arbordoc.plans.catalogue import ORACLES, QUERIES
from conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    plan = QUERIES["key_prefix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url,https://blog.)" in plan and "html" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["event_id", "v"]


def test_core_queries_without_the_packages_of_others(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("arbordoc.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("zstandard", "xxhash"):
        monkeypatch.setitem(sys.modules, name, None)  # importing it fails
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert set(importlib.reload(__spark_entry__).queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_written_rounds_need_a_shared_folder(monkeypatch, spark, tmp_path):
    from arbordoc.session import cut

    df = spark.range(3)
    assert sorted(r.id for r in cut(df).collect()) == [0, 1, 2]


@pytest.mark.parametrize("name", ["codec_lookup", "encoding_at", "size_stats", "codec_roundtrip_text", "codec_roundtrip_binary", "node_table_recursive"])
def test_rows_are_dealt_over_all_partitions(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "UnionLoop" not in plan


def test_a_lookup_encodes_once(spark):
    plan = QUERIES["codec_lookup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
